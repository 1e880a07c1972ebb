"""Series on a dense frame axis: windows over one exchange by the series' keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.session import ship_package


def dense_axis(observed: DataFrame, keys: list[str], last_frame: Column | None = None) -> DataFrame:
    """A row for each frame from 0 to each key's last frame (its last observed one by default), NULL where nothing was observed."""
    last = F.max("frame") if last_frame is None else F.max(last_frame)
    axis = observed.groupBy(*keys).agg(last.alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("frame"))
    return axis.join(observed, [*keys, "frame"], "left")


def smooth(series: DataFrame, keys: list[str], value: str, half: int, out: str | None = None) -> DataFrame:
    """Centred mean over 2 * half + 1 frames, cut at the ends; missing values are skipped. The axis has to be dense."""
    if half <= 0:
        return series.withColumn(out or value, F.col(value))
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)
    return series.withColumn(out or value, F.avg(value).over(w))


def smooth_per_clip(series: DataFrame, keys: list[str], value: str, half: str, halves: list[int]) -> DataFrame:
    """smooth() where each row's column `half` gives its width, in one pass; halves lists the widths, since a window's bounds are
    literals. A row of another width fails; one whose half is NULL, 0 or less stays as it is."""
    order = Window.partitionBy(*keys).orderBy("frame")
    out = F.when(F.coalesce(F.col(half), F.lit(0)) <= 0, F.col(value))
    for h in sorted({h for h in halves if h > 0}):
        out = out.when(F.col(half) == h, F.avg(value).over(order.rowsBetween(-h, h)))
    return series.withColumn(value, out.otherwise(F.raise_error(F.concat(F.lit("a width that isn't listed: "), F.col(half).cast("string")))))


def previous_visible(series: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<c> of the previous observed row of each key, whatever the gap; rows are observed ones."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return series.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def contact_spans(series: DataFrame, keys: list[str], value: str, enter: float | Column, leave: float | Column) -> DataFrame:
    """Spans of two-threshold hysteresis: (keys, sid, frame_start, frame_end, min_d).

    A span opens where value < enter and ends one frame before value > leave; between them, and where nothing is
    measured, it holds; one that never ends ends at the key's last measured frame. leave has to be above enter.
    """
    if not isinstance(enter, Column) and not isinstance(leave, Column) and leave <= enter:
        raise ValueError("leave has to be above enter")
    v = F.col(value)
    order = Window.partitionBy(*keys).orderBy("frame")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = series.withColumn("_m", F.when(v < enter, 1).when(v > leave, 0))
    held = marked.withColumn("_st", F.coalesce(F.last("_m", ignorenulls=True).over(upto), F.lit(0)))
    edges = held.withColumn("_ps", F.coalesce(F.lag("_st").over(order), F.lit(0)))
    last = F.max(F.when(v.isNotNull(), F.col("frame"))).over(Window.partitionBy(*keys))
    numbered = edges.withColumn("sid", F.sum(F.when((F.col("_st") == 1) & (F.col("_ps") == 0), 1).otherwise(0)).over(upto)).withColumn("_last", last)
    inside = numbered.where("_st = 1 or _ps = 1")
    on = F.col("_st") == 1
    return inside.groupBy(*keys, "sid").agg(
        F.min(F.when(on, F.col("frame"))).alias("frame_start"),
        F.coalesce(F.min(F.when(~on, F.col("frame"))) - 1, F.max("_last")).alias("frame_end"),
        F.min(F.when(on, v)).alias("min_d"),
    )


class _Grid:
    """The states of all settings while rows come by key and frame; between batches it holds one open span a setting.

    Of the rows of a batch, each setting's state is a row of a table (setting, row): 1 or 0 where the row decides, and else what
    the row before has.
    """

    def __init__(self, settings: list[tuple[int, float, float, float]]):
        self.pos, self.enter, self.leave, self.least = (np.array(x) for x in zip(*settings))
        n = len(settings)
        self.key: pa.Table | None = None
        self.state, self.number, self.start, self.last = (np.zeros(n, np.int64) for _ in range(4))
        self.low = np.full(n, np.inf)

    def _spans(self, keys: pa.Table, of, s, number, start, end, low) -> pa.Table:
        return pa.table([pa.array(self.pos[s], pa.int32()), *keys.take(pa.array(of, pa.int64())).columns, *map(pa.array, (number, start, end, low))], names=["pos", *keys.column_names, "sid", "frame_start", "frame_end", "min_d"])

    def close(self) -> pa.Table:
        """What is open at the key's end ends at its last measured frame."""
        s = np.flatnonzero(self.state)
        return self._spans(self.key, np.zeros(len(s), np.int64), s, self.number[s], self.start[s], self.last[s], self.low[s])

    def add(self, keys: pa.Table, frame: np.ndarray, v: np.ndarray, conf: np.ndarray, given: np.ndarray) -> Iterator[pa.Table]:
        """given: where both v and conf are. As Spark orders them, NaN is above every number."""
        n, rows = len(frame), np.arange(len(frame))
        begins = np.zeros(n, bool)
        joined = keys if self.key is None else pa.concat_tables([self.key, keys])
        begins[0] = self.key is None
        differs = np.zeros(len(joined) - 1, bool)
        for c in joined.columns:
            x, y = (c.slice(1), c.slice(0, len(c) - 1))
            differs |= pc.fill_null(pc.not_equal(x, y), False).to_numpy() | pc.not_equal(pc.is_null(x), pc.is_null(y)).to_numpy()
        begins[n - len(differs) :] |= differs
        if begins[0]:
            if self.key is not None:
                yield self.close()
            for x in (self.state, self.number, self.last):
                x[:] = 0
        seen = given & ((conf >= self.least[:, None]) | np.isnan(conf))
        with np.errstate(invalid="ignore"):
            decides = np.where(seen & (v < self.enter[:, None]), 1, np.where(seen & ((v > self.leave[:, None]) | np.isnan(v)), 0, -1)).astype(np.int8)
        decides[:, begins & (rows > 0)] = np.maximum(decides[:, begins & (rows > 0)], 0)
        decides[:, 0] = np.where(decides[:, 0] < 0, self.state, decides[:, 0])
        on = np.take_along_axis(decides, np.maximum.accumulate(np.where(decides >= 0, rows, 0), axis=1), 1) == 1
        before = np.concatenate([self.state[:, None] == 1, on[:, :-1]], 1)
        before[:, begins & (rows > 0)] = False
        opened = on & ~before
        # a span's number counts those that its key has opened
        count = np.cumsum(opened, axis=1)
        first = np.maximum.accumulate(np.where(begins, rows, 0))
        base = np.where(first > 0, count[:, first - 1], -self.number[:, None])
        measured = np.maximum.accumulate(np.where(seen, rows, -1), axis=1)
        # a piece begins where a span or a key does, and with the batch; a span is in one piece, or goes on from the batch before
        cut = opened | begins
        cut[:, 0] = True
        at = np.flatnonzero(cut)
        s, r = at // n, at % n
        low = np.minimum.reduceat(np.where(on & seen, v, np.inf).ravel(), at)
        start, goes_on = frame[r], (r == 0) & before[s, r]
        start[goes_on], low[goes_on] = self.start[s[goes_on]], np.minimum(low, self.low[s])[goes_on]
        number = (count - base)[s, r]
        ended = np.flatnonzero(before & ~on)
        piece = np.searchsorted(at, ended, "right") - 1
        end = np.full(len(at), -1)
        end[piece] = frame[ended % n] - 1
        live = on[s, r] | goes_on
        closed = np.zeros(len(at), bool)
        closed[piece] = True
        final = np.append(at[1:], on.size) - 1
        last = measured[s, final % n]
        last = np.where(last >= first[final % n], frame[np.maximum(last, 0)], self.last[s])
        open_end = live & ~closed
        end[open_end] = last[open_end]
        waits = open_end & (final % n == n - 1)
        told = live & ~waits
        yield self._spans(keys, r[told], s[told], number[told], start[told], end[told], low[told])
        last = np.where(measured[:, -1] >= first[-1], frame[np.maximum(measured[:, -1], 0)], 0 if begins[1:].any() else self.last)
        self.key, self.state, self.number, self.last = keys.slice(n - 1), on[:, -1].astype(np.int64), (count - base)[:, -1], last
        self.start[s[waits]], self.low[s[waits]] = start[waits], low[waits]


def contact_spans_grid(series: DataFrame, keys: list[str], value: str, settings: list[tuple[int, float, float, float]], conf: str) -> DataFrame:
    """contact_spans() for many settings (pos, enter, leave, least conf) in one pass: (pos, keys, sid, frame_start, frame_end,
    min_d). Under a setting, values whose column conf is below its least are missing.

    The series is dealt and sorted once; its rows go by in Arrow batches, in which all settings' states follow together. No key is
    held whole. Rows without a frame are left out.
    """
    ship_package(series.sparkSession)
    kinds = dict(series.dtypes)
    rows = series.where(F.col("frame").isNotNull()).select(*keys, F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("_v"), F.col(conf).cast("double").alias("_c"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _Grid(settings)
        for batch in batches:
            if len(batch):
                v, c = batch.column("_v"), batch.column("_c")
                given = pc.and_(pc.is_valid(v), pc.is_valid(c)).to_numpy(zero_copy_only=False)
                for spans in grid.add(pa.Table.from_batches([batch.select(keys)]), batch.column("frame").to_numpy(), v.to_numpy(zero_copy_only=False), c.to_numpy(zero_copy_only=False), given):
                    yield from spans.to_batches()
        if grid.key is not None:
            yield from grid.close().to_batches()

    columns = ", ".join(["pos int", *(f"`{k}` {kinds[k]}" for k in keys), "sid long, frame_start long, frame_end long, min_d double"])
    spans = rows.repartition(*keys).sortWithinPartitions(*keys, "frame").mapInArrow(follow, columns)
    return spans.withColumns({c: F.col(c).cast(kinds["frame"]) for c in ("frame_start", "frame_end")})


def merge_islands(spans: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Spans (frame_start, frame_end) of a key that overlap, touch or lie at most gap frames apart, as one: with island and n."""
    order = Window.partitionBy(*keys).orderBy("frame_start", "frame_end")
    reach = F.max("frame_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("_reach").isNull() | (F.col("frame_start") > F.col("_reach") + 1 + gap), 1).otherwise(0)
    marked = spans.withColumn("_reach", reach).withColumn("island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "island").agg(F.min("frame_start").alias("frame_start"), F.max("frame_end").alias("frame_end"), F.count("*").alias("n"))


def near_frames(spans: DataFrame, keys: list[str], pad_frames: Column | int, n_frames: Column) -> DataFrame:
    """Distinct frames of all spans, padded on both sides and cut to the clip."""
    pad = pad_frames if isinstance(pad_frames, Column) else F.lit(pad_frames)
    lo, hi = F.greatest(F.lit(0), F.col("frame_start") - pad), F.least(n_frames - 1, F.col("frame_end") + pad)
    return spans.where(lo <= hi).select(*keys, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("frame")).distinct()
