"""Hard-negative mining by an exact search over a pivot table.

Scores are inner products of integer vectors. A row gets one more component that makes all rows equally long, an anchor gets a zero
there; then score = (|anchor|^2 + reach^2 - distance^2) / 2, where reach is the longest row's length. The table holds each row's
distances to some pivots: by the triangle inequality they bracket the distance of an anchor to a row, and so the score, for a region
of the table, a chunk of rows, or a row. Only rows whose bracket meets what an anchor looks for are scored exactly.

The table is dealt into parts of bounded size by nearest pivot and distance. Anchors first meet a bounded sample of the rows, which
raises the scores that they need, then go only to the parts whose bracket they need; a task holds one part, and anchors stream by.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import Tables
from kinograph.llm.vectors import SCALE, longest, rows_a_block, usable, whole_numbers
from kinograph.session import ship_package, table

PIVOTS = 16
#: Rows of a part that a task holds, fewer for long vectors: 2^21 components at most.
PART_ROWS, PART_VALUES = 1 << 15, 1 << 21
#: Rows of the sample that anchors meet first, and its components (4 MB): it sets where the search begins, never what it finds.
PROBE_ROWS, PROBE_VALUES = 1 << 14, 1 << 20
#: Parts are summed up in about so many regions, whose brackets every task has (0.5 MB).
REGIONS = 4096
CHUNK = 512
#: Anchors that meet a part, or the sample, at once.
TOGETHER = 64
NO_END = 1 << 62


class Space(NamedTuple):
    """What brackets scores: the pivots, the square of the longest row's length, and the regions' parts and pivot distances."""

    dim: int
    pivots: np.ndarray
    reach: int
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def kind(self):
        """Products of this type are exact: floats where every sum stays below 2^53."""
        return np.float64 if self.reach < 1 << 53 else np.int64

    @property
    def slack(self) -> float:
        """More than the rounding of 32-bit distances changes a score."""
        return 1 + 4e-6 * self.reach

    def row_distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots, all with their added component."""
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        nx, np_ = (x * x).sum(1), (p * p).sum(1)
        added, of_pivot = (np.sqrt(np.maximum(self.reach - n, 0)) for n in (nx, np_))
        square = nx[:, None] + np_[None, :] - 2 * x @ p.T + (added[:, None] - of_pivot[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0)).astype(np.float32)

    def anchor_distances(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose added component is zero, to the pivots."""
        q, p = q.astype(np.float64), self.pivots.astype(np.float64)
        square = (q * q).sum(1)[:, None] + self.reach - 2 * q @ p.T
        return np.sqrt(np.maximum(square, 0)).astype(np.float32)

    def bracket(self, q: np.ndarray, away: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of anchors q with rows whose pivot distances are from low to high."""
        near = np.zeros((len(q), len(low)), np.float32)
        far = np.full((len(q), len(low)), np.inf, np.float32)
        for k in range(len(self.pivots)):
            a = away[:, k][:, None]
            np.maximum(near, a - high[:, k][None, :], out=near)
            np.maximum(near, low[:, k][None, :] - a, out=near)
            np.minimum(far, a + high[:, k][None, :], out=far)
        middle = (q.astype(np.float64) ** 2).sum(1)[:, None] + self.reach
        return (middle - far.astype(np.float64) ** 2) / 2 - self.slack, (middle - near.astype(np.float64) ** 2) / 2 + self.slack


def spread(x: np.ndarray, reach: int, most: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each is the one farthest from those before it."""
    chosen = [0]
    least = np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)):
        least = np.minimum(least, Space(0, x[chosen[-1:]], reach, *[np.zeros(0)] * 4).row_distances(x)[:, 0])
        if least.max() <= 0:
            break
        chosen.append(int(least.argmax()))
    return x[chosen]


def _whole(dim: int):
    def whole(batches):
        for batch in batches:
            x = whole_numbers(batch.column("vector"), dim)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), v, pa.array((x * x).sum(1))], ["vec_id", "label", "anchor", "v", "norm"])

    return whole


def _matrix(column: pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def _located(space: Space):
    def locate(batches):
        for batch in batches:
            away = space.row_distances(_matrix(batch.column("v"), np.int64))
            home = away.argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1, dtype=np.int32) * away.shape[1]), pa.array(away.reshape(-1)))
            columns = [batch.column(c) for c in ("vec_id", "mixed", "label", "anchor", "v")]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(home.astype(np.int32)), pa.array(away[np.arange(len(home)), home])], ["vec_id", "mixed", "label", "anchor", "v", "away", "home", "near"])

    return locate


class Rows(NamedTuple):
    vec_id: np.ndarray
    mixed: np.ndarray
    label: np.ndarray
    v: np.ndarray
    away: np.ndarray


def _rows(batch, space: Space) -> Rows:
    return Rows(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "mixed", "label")), _matrix(batch.column("v"), space.kind), _matrix(batch.column("away"), np.float32))


def _best(hits, low: np.ndarray, high: np.ndarray, rows: Rows, k: int):
    """Of hits (anchor, row, score): for each interval of each anchor the k best, as (anchor, interval, row, score), best first."""
    anchor, row, score = hits
    for j in range(low.shape[1]):
        at = np.flatnonzero((score >= low[anchor, j]) & (score <= high[anchor, j]))
        at = at[np.lexsort((rows.mixed[row[at]], rows.vec_id[row[at]], -score[at], anchor[at]))]
        begins = np.searchsorted(anchor[at], np.arange(len(low)))
        at = at[np.arange(len(at)) - begins[anchor[at]] < k]
        yield anchor[at], j, row[at], score[at]


def _met(q: Rows, low: np.ndarray, high: np.ndarray, rows: Rows, space: Space, same: bool):
    """(anchor, row, score) of the pairs with the same label, or with different ones, whose score is within an anchor's outer bounds."""
    lowest, highest = low.min(1, initial=NO_END), high.max(1, initial=-NO_END)
    found = [(np.zeros(0, np.int64),) * 3]
    chunks = [slice(i, i + CHUNK) for i in range(0, len(rows.v), CHUNK)]
    least, most = space.bracket(q.v, q.away, np.stack([rows.away[c].min(0) for c in chunks]), np.stack([rows.away[c].max(0) for c in chunks]))
    wanted = (most >= lowest[:, None]) & (least <= highest[:, None])
    for k, c in enumerate(chunks):
        a = np.flatnonzero(wanted[:, k])
        if not len(a):
            continue
        least_row, most_row = space.bracket(q.v[a], q.away[a], rows.away[c], rows.away[c])
        may = (most_row >= lowest[a, None]) & (least_row <= highest[a, None]) & ((q.label[a, None] == rows.label[c][None, :]) == same)
        if same:
            may &= (q.vec_id[a, None] != rows.vec_id[c][None, :]) | (q.mixed[a, None] != rows.mixed[c][None, :])
        some, of = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(some):
            continue
        score = (q.v[a[some]] @ rows.v[c][of].T).astype(np.int64)
        hit = may[np.ix_(some, of)] & (score >= lowest[a[some], None]) & (score <= highest[a[some], None])
        i, r = np.nonzero(hit)
        found.append((a[some[i]], of[r] + c.start, score[i, r]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bounds(batch) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of each anchor, as many for each; those beyond an anchor's own hold nothing."""
    out = []
    for name, nothing in (("low", NO_END), ("high", -NO_END)):
        lists = batch.column(name).to_pylist()
        bounds = np.full((len(lists), max(map(len, lists), default=0)), nothing, np.int64)
        for i, x in enumerate(lists):
            bounds[i, : len(x)] = x
        out.append(bounds)
    return out[0], out[1]


ANCHOR = "vec_id long, mixed long, label long, v array<int>, away array<float>, low array<long>, high array<long>"


def _probe(shared, same: bool, k: int):
    """Anchors with their own pivot distances, the scores they need after the sample, and the spans of parts that they need."""

    def probe(batches):
        space, sample = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                low, high = _bounds(batch)
                v = _matrix(batch.column("v"), space.kind)
                q = Rows(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "mixed", "label")), v, space.anchor_distances(v))
                hits = _met(q, low, high, sample, space, same)
                raised = low.copy()
                for anchor, j, _, score in _best(hits, low, high, sample, k):
                    n = np.bincount(anchor, minlength=len(v))
                    full = np.flatnonzero(n >= k)
                    raised[full, j] = score[np.cumsum(n)[full] - 1]
                least, most = space.bracket(q.v, q.away, space.low, space.high)
                need = np.zeros(least.shape, bool)
                for j in range(low.shape[1]):
                    need |= (most >= raised[:, j, None]) & (least <= high[:, j, None]) & (raised[:, j, None] <= high[:, j, None])
                spans = []
                for row in need:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
                    spans.append([{"a": int(space.first[a]), "b": int(space.last[b - 1])} for a, b in edge.reshape(-1, 2).tolist()])
                columns = [pa.array(x, pa.int64()) for x in (q.vec_id, q.mixed, q.label)] + [batch.column("v"), pa.array(list(q.away), pa.list_(pa.float32())), pa.array(list(raised), pa.list_(pa.int64())), pa.array(list(high), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["vec_id", "mixed", "label", "v", "away", "low", "high", "spans"])

    return probe


def _search(shared, same: bool, k: int):
    """Rows come by part, a part's rows before its anchors."""

    def search(batches):
        space, _ = shared.value
        part, held, rows = None, [], None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(parts)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, rows = parts[a], [], None
                if kinds[a] == 0:
                    held.append(_rows(piece, space))
                    continue
                if rows is None:
                    rows = Rows(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                for i in range(0, piece.num_rows, TOGETHER):
                    q = _rows(piece.slice(i, TOGETHER), space)
                    low, high = _bounds(piece.slice(i, TOGETHER))
                    for anchor, j, row, score in _best(_met(q, low, high, rows, space, same), low, high, rows, k):
                        columns = [q.vec_id[anchor], q.mixed[anchor], np.full(len(anchor), j), rows.vec_id[row], rows.mixed[row], score]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "anchor_mixed", "j", "vec_id", "mixed", "score"])

    return search


class PivotTable:
    """The rows of (vec_id, label, vector, anchor) in parts with their pivot distances, stored in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.tables = Tables(self.spark)
        self.dim = max(longest(rows, "vector"), 1)
        whole = rows.mapInArrow(_whole(self.dim), "vec_id long, label long, anchor boolean, v array<int>, norm long")
        whole = self.tables.keep(whole.dropDuplicates(["vec_id", "label", "v"]).withColumn("mixed", F.xxhash64("vec_id", "label", "v")))
        self.count, reach = whole.agg(F.count("*"), F.max("norm")).first()
        if not self.count:
            return
        probe = min(PROBE_ROWS, rows_a_block(self.dim, PROBE_VALUES))
        share = F.pmod(F.col("mixed"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, probe / self.count))
        sample = whole.where(share).select("vec_id", "mixed", "label", "v").limit(2 * probe).toArrow()
        x = _matrix(sample.column("v"), np.int64)
        order = np.argsort(sample.column("mixed").to_numpy())
        space = Space(self.dim, spread(x[order][:CHUNK], reach), reach, *[np.zeros(0)] * 4)

        part_rows = min(PART_ROWS, rows_a_block(self.dim, PART_VALUES))
        at_once = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(-(-self.count // part_rows), min(at_once, -(-self.count // 1024)))
        located = whole.mapInArrow(_located(space), "vec_id long, mixed long, label long, anchor boolean, v array<int>, away array<float>, home int, near float")
        dealt = located.repartitionByRange(parts, "home", "near", "mixed").withColumn("part", F.spark_partition_id())
        self.rows = self.tables.keep(dealt)
        region = F.floor(F.col("part") / F.lit(-(-parts // REGIONS)))
        n = len(space.pivots)
        ends = [f(F.col("away")[k]).alias(f"{name}{k}") for k in range(n) for name, f in (("low", F.min), ("high", F.max))]
        regions = sorted(self.rows.groupBy(region.alias("region")).agg(F.min("part").alias("a"), F.max("part").alias("b"), *ends).collect(), key=lambda r: r.a)
        low, high = (np.array([[r[f"{name}{k}"] for k in range(n)] for r in regions], np.float32) for name in ("low", "high"))
        self.space = space._replace(first=np.array([r.a for r in regions]), last=np.array([r.b for r in regions]), low=low, high=high)
        ids = [sample.column(c).to_numpy() for c in ("vec_id", "mixed", "label")]
        held = Rows(*(c[order] for c in ids), x[order].astype(self.space.kind), self.space.row_distances(x[order]))
        # near rows together, so that chunks have narrow brackets
        by_home = np.lexsort((held.away.min(1), held.away.argmin(1)))
        self.shared = self.spark.sparkContext.broadcast((self.space, Rows(*(c[by_home] for c in held))))

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, anchor_mixed, j, vec_id, mixed, score, rank): the k best rows of each anchor's interval j, counted from 0.

        anchors: vec_id, mixed, label, v, and the arrays low and high. same: rows of the anchor's label but itself, or of others.
        """
        probed = anchors.select("vec_id", "mixed", "label", "v", "low", "high").mapInArrow(_probe(self.shared, same, k), ANCHOR + ", spans array<struct<a int, b int>>")
        sent = probed.withColumn("span", F.explode("spans")).withColumn("part", F.explode(F.sequence("span.a", "span.b")))
        columns = ["part", "kind", "home", "near", "vec_id", "mixed", "label", "v", "away", "low", "high"]
        nothing = F.lit(None).cast("array<long>")
        rows = self.rows.withColumn("kind", F.lit(0)).withColumn("low", nothing).withColumn("high", nothing).select(columns)
        sent = sent.withColumn("kind", F.lit(1)).withColumn("home", F.lit(None).cast("int")).withColumn("near", F.lit(None).cast("float")).select(columns)
        parts = int(self.space.last[-1]) + 1
        both = rows.unionByName(sent).repartition(parts, "part").sortWithinPartitions("part", "kind", "home", "near")
        found = both.mapInArrow(_search(self.shared, same, k), "anchor_id long, anchor_mixed long, j long, vec_id long, mixed long, score long")
        order = Window.partitionBy("anchor_id", "anchor_mixed", "j").orderBy(F.desc("score"), "vec_id", "mixed")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the inner product of its vector and the anchor's, components as floor(256 * x); higher scores come first, ties
    by smaller vec_id. An anchor's positives are its best other rows of the same label; for each of them, its negatives are the
    best rows of other labels whose score is from low % to high % of the positive's. Rows with a null label, vector or vec_id, or
    with null or non-finite components, take no part. Rows that repeat vec_id, label and vector count once; others that repeat a
    vec_id are rows of their own. Shorter vectors are followed by zeros; components beyond 2^30 / sqrt(length) are set to that.
    An anchor without positives, or a positive without negatives (as where its score is below 0), has no rows.
    """
    ship_package(rows.sparkSession)
    taking = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    pivot = PivotTable(taking.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not pivot.count:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = pivot.rows.where("anchor").select("vec_id", "mixed", "label", "v")
    every = anchors.withColumn("low", F.array(F.lit(-NO_END))).withColumn("high", F.array(F.lit(NO_END)))
    near = pivot.tables.keep(pivot.best(every, True, positives).select("anchor_id", "anchor_mixed", (F.col("rank") - 1).cast("long").alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # bounds in hundredths without leaving 64 bits: 100 * h + r splits the score
    r = F.pmod(F.col("positive_score"), F.lit(100))
    h = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
    bounds = near.select("*", (low * h + F.ceil(low * r / 100)).cast("long").alias("low"), (high * h + F.floor(high * r / 100)).cast("long").alias("high"))
    listed = bounds.groupBy("anchor_id", "anchor_mixed").agg(F.sort_array(F.collect_list(F.struct("j", "low", "high"))).alias("all"))
    seeking = anchors.join(listed, (F.col("vec_id") == F.col("anchor_id")) & (F.col("mixed") == F.col("anchor_mixed"))).withColumn("low", F.col("all.low")).withColumn("high", F.col("all.high"))
    far = pivot.best(seeking, False, negatives).select("anchor_id", "anchor_mixed", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "anchor_mixed", "j"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of `embeddings`: anchors are the rows whose vec_id is divisible by 100 (see hard_negatives).

    Rows whose vec_id is divisible by 7 have the label (label + 1) % 10.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def oracle() -> str:
    return f"""
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
 list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
 FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INT AS rank,
 n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10"""
