"""Contact spans of persons and vehicles that arrive as two streams.

The streams meet by a join within the watermark; each pair's smoothed distance and two-threshold state follow frame by frame, as far
as the watermark has passed, and an event-time timer closes what is open when a clip has ended. The spans are those of
series.contact_spans over proposal.pair_series of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.session import ship_package

BOX = ["x1", "y1", "x2", "y2"]
STATE = "frames array<int>, distances array<double>, following int, start int, last int, low double, epoch long"


def met(persons: DataFrame, vehicles: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(clip_id, p_id, v_id, frame, ts, fps, n_frames, d_norm) of persons and vehicles of one frame.

    Both streams: clip_id, track_id, frame, x1..y2, ts; persons also fps and n_frames. ts is the frame's time and the same on
    both sides, so that the join's state goes as the watermark passes.
    """
    side = lambda df, p, more=(): df.withWatermark("ts", delay).select("clip_id", F.col("track_id").alias(f"{p}id"), "frame", F.col("ts").alias(f"{p}ts"), *more, *[F.col(c).alias(f"{p}{c}") for c in BOX])
    p, v = side(persons, "p_", ("fps", "n_frames")).alias("p"), side(vehicles, "v_").alias("v")
    both = p.join(v, (F.col("p.clip_id") == F.col("v.clip_id")) & (F.col("p.frame") == F.col("v.frame")) & (F.col("p_ts") == F.col("v_ts")))
    return both.select("p.clip_id", "p_id", "v_id", "p.frame", F.col("p_ts").alias("ts"), "fps", "n_frames", B.d_norm(B.box("p_"), B.box("v_")).alias("d_norm"))


class Follower:
    """One pair: raw distances that a window may still need, the next frame to judge, and the open span.

    A frame is judged when all frames of its window have come. The mean skips frames without a distance, and is none where
    the window has none; between the thresholds, and where there is none, the state holds.
    """

    def __init__(self, enter: float, leave: float, half: int, n_frames: int, state: tuple | None = None):
        self.enter, self.leave, self.half, self.n_frames = enter, leave, half, n_frames
        frames, distances, self.following, self.start, self.last, self.low = state or ([], [], 0, None, None, None)
        self.raw = dict(zip(frames, distances))

    def state(self) -> tuple:
        return sorted(self.raw), [self.raw[f] for f in sorted(self.raw)], self.following, self.start, self.last, self.low

    def add(self, frame: int, d: float) -> None:
        self.raw[frame] = d

    def judge(self, complete: int) -> list[tuple[int, int, float]]:
        """The spans that end, once all frames up to `complete` have come."""
        out = []
        upto = min(complete - self.half, self.n_frames - 1) if complete < self.n_frames - 1 else self.n_frames - 1
        near = sorted({f for r in self.raw for f in range(max(r - self.half, self.following), min(r + self.half, upto) + 1)})
        for f in near:
            # the frames in order, as a window's sum takes them
            seen = [self.raw[k] for k in range(max(0, f - self.half), min(self.n_frames - 1, f + self.half) + 1) if k in self.raw]
            mean = sum(seen) / len(seen)
            if self.start is None and mean < self.enter:
                self.start, self.low = f, mean
            elif self.start is not None and mean > self.leave:
                out.append((self.start, f - 1, self.low))
                self.start = self.low = None
            elif self.start is not None:
                self.low = min(self.low, mean)
            self.last = f
        self.following = max(self.following, upto + 1)
        self.raw = {k: d for k, d in self.raw.items() if k >= self.following - self.half}
        return out

    def close(self) -> list[tuple[int, int, float]]:
        """What is open at the clip's end ends at the last frame that had a mean."""
        out = self.judge(self.n_frames - 1)
        return out if self.start is None else [*out, (self.start, self.last, self.low)]


def stream_pair_spans(persons: DataFrame, vehicles: DataFrame, enter: float, leave: float, window_s: float = 0.4, delay: str = "10 seconds") -> DataFrame:
    """(clip_id, p_id, v_id, frame_start, frame_end, min_d) of two streams (see met), each span once, when it is known to have ended.

    The result doesn't depend on the order in which rows arrive within `delay`; rows that come later are left out and counted by
    late.LateRows. A pair's state is the distances of one window and of what waits for the watermark; it goes when the
    watermark passes the clip's end (n_frames at fps, from the time of frame 0 that a row's frame and time give).
    """
    if leave <= enter:
        raise ValueError("leave has to be above enter")
    ship_package(persons.sparkSession)
    pairs = met(persons, vehicles, delay).where(F.col("d_norm").isNotNull() & F.col("frame").between(0, F.col("n_frames") - 1))
    half = F.floor(S.smooth_frames(window_s, F.col("fps")) / 2).cast("int")
    rows = pairs.select("clip_id", "p_id", "v_id", "frame", "ts", "fps", "n_frames", "d_norm", half.alias("half"), F.unix_micros("ts").alias("us"))
    kinds = dict(rows.dtypes)
    names = ["clip_id", "p_id", "v_id", "frame_start", "frame_end", "min_d"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        held, more = (state.get if state.exists else None), [] if state.hasTimedOut else list(batches)
        if held is None:
            one = more[0].iloc[0]
            begin, meta = int(one["us"] - round(one["frame"] * 1e6 / one["fps"])), (float(one["fps"]), int(one["n_frames"]), int(one["half"]))
            follower = Follower(enter, leave, meta[2], meta[1])
        else:
            meta, begin = (held[7], held[8], held[9]), held[6]
            follower = Follower(enter, leave, meta[2], meta[1], held[:6])
        fps, n_frames, half = meta
        for pdf in more:
            for f, d in zip(pdf["frame"], pdf["d_norm"]):
                follower.add(int(f), float(d))
        end = begin + round((n_frames - 1) * 1e6 / fps)
        if passed > end:
            spans = follower.close()
            state.remove()
        else:
            # the last frame whose time the watermark has reached (by a millisecond): nothing can come for it or those before
            spans = follower.judge(int((passed - begin - 1000) * fps // 1_000_000) if passed >= begin else -1)
            state.update((*follower.state(), begin, *meta))
            state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if spans:
            yield pd.DataFrame([(*key, *s) for s in spans], columns=names)

    out = f"clip_id {kinds['clip_id']}, p_id {kinds['p_id']}, v_id {kinds['v_id']}, frame_start int, frame_end int, min_d double"
    return rows.groupBy("clip_id", "p_id", "v_id").applyInPandasWithState(step, out, STATE + ", fps double, n_frames int, half int", "append", "EventTimeTimeout")
