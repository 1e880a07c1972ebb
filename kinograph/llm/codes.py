"""Compression of vectors to codes: each vector is cut into parts, and a part is written as the nearest entry of its codebook.

Codebooks are trained on all vectors by an RDD's treeAggregate over columnar blocks of integers: distances accumulate dimension by
dimension, the sums and counts of the entries are int64 tensors, and a tree of reductions merges them. All arithmetic is whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import Tables
from kinograph.llm.vectors import SCALE, longest, rows_a_block, usable, whole_numbers
from kinograph.session import ship_package, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Components of a block, 1 MB of 32-bit numbers.
BLOCK_VALUES = 1 << 18
#: Levels of the reduction tree.
DEPTH = 3
#: Totals of so many labels are broadcast (1 MB); with more the join is Spark's to choose.
FEW_LABELS = 1 << 16


def _blocks(dim: int):
    """Columnar blocks: the number of rows, and the components as int32, a dimension after another."""

    def pack(batches):
        most, held, n = rows_a_block(dim, BLOCK_VALUES), [], 0

        def block(x):
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([np.ascontiguousarray(x.T).astype("<i4").tobytes()], pa.binary())], ["n", "columns"])

        for batch in batches:
            x = whole_numbers(batch.column("vector"), dim)
            for i in range(0, len(x), most):
                piece = x[i : i + most]
                if n + len(piece) > most:
                    yield block(np.concatenate(held))
                    held, n = [], 0
                held.append(piece)
                n += len(piece)
        if held:
            yield block(np.concatenate(held))

    return pack


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns x (dim, n) and codebooks (parts, entries, width): the nearest entry of each part, and its squared distance.

    Both results have the shape (parts, n); the lower index wins a tie.
    """
    parts, entries, width = books.shape
    index, least = np.empty((parts, x.shape[1]), np.int64), np.empty((parts, x.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((entries, x.shape[1]), np.int64)
        for d in range(width):
            apart = x[p * width + d][None, :] - books[p, :, d][:, None]
            distance += apart * apart
        index[p] = distance.argmin(0)
        least[p] = np.take_along_axis(distance, index[p][None, :], 0)[0]
    return index, least


def _add_block(books: np.ndarray):
    """Folds a block into (sums, counts) of the entries."""
    parts, entries, width = books.shape

    def add(total, row):
        x = np.frombuffer(row.columns, "<i4").reshape(-1, row.n).astype(np.int64)
        sums, counts = (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)) if total is None else total
        index, _ = nearest(x, books)
        for p in range(parts):
            np.add.at(sums[p], index[p], x[p * width : (p + 1) * width].T)
            np.add.at(counts[p], index[p], 1)
        return sums, counts

    return add


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts, entries, width) of the rows with the smallest vec_ids; fewer entries where there are fewer rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    x = whole_numbers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim)
    return np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))


def train(blocks: DataFrame, books: np.ndarray, rounds: int, depth: int = DEPTH) -> np.ndarray:
    """The codebooks after some rounds over all blocks: each entry becomes the floor of the mean of its parts, unused ones stay."""
    rdd = blocks.rdd
    for _ in range(rounds):
        sums, counts = rdd.treeAggregate(None, _add_block(books), _merge, depth)
        used = counts > 0
        books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def _encode(books: np.ndarray, dim: int):
    def encode(batches):
        most = rows_a_block(dim, BLOCK_VALUES)
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                index, least = nearest(np.ascontiguousarray(whole_numbers(part.column("vector"), dim).T), books)
                codes = [c.tobytes().hex() for c in np.ascontiguousarray(index.T).astype(np.uint8)] if len(index) else []
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(least.sum(0), pa.int64())], ["vec_id", "label", "code", "error"])

    return encode


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of each usable row, and the codebooks (parts, entries, width); none where no row is usable.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors are cut into equal consecutive parts;
    ones that are shorter than the longest, or whose length isn't a multiple of the parts, are followed by zeros. Repeated rows
    count as often as they occur, and each is answered. Rows without a vec_id come last among the first entries' candidates, and
    equal vec_ids go by their vectors. Components beyond 2^30 / sqrt(length) are set to that. entries is 256 at most.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(usable(F.col("vector")))
    dim = -(-max(longest(kept, "vector"), 1) // parts) * parts
    books = first_books(kept, dim, parts, entries)
    if not books.size:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).where("false"), None
    # stored once; both rounds read the same blocks, wherever their executors are by then
    blocks = Tables(spark).keep(kept.select("vector").mapInArrow(_blocks(dim), "n int, columns binary"))
    books = train(blocks, books, rounds)
    kind = dict(kept.dtypes)["label"]
    return kept.mapInArrow(_encode(books, dim), f"vec_id long, label {kind}, code string, error long"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable rows of `embeddings` (see compress); label_error is null where a label's sum leaves 64 bits.

    The sums by label are pre-aggregated; where they are few they are broadcast, so that no row moves for a common label.
    """
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    if books is None:
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    tables = Tables(spark)
    coded = tables.keep(coded)
    totals = tables.keep(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    totals = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    met = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    steps = []
    for k in range(ROUNDS):
        steps.append(f"""near{k} AS ({_nearest_sql(k)}),
sums{k} AS (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM near{k}, range(1, (SELECT max(len(x)) FROM cut) + 1) t(j) GROUP BY p, e, j),
means{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM kept),
cut AS (SELECT r, vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM whole, range({PARTS}) t(p)),
book0 AS (SELECT p, r AS e, x AS c FROM cut WHERE r < {ENTRIES}),
{", ".join(steps)},
final AS ({_nearest_sql(ROUNDS)}),
coded AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY r),
said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, said"""


def _nearest_sql(k: int) -> str:
    """The nearest entry of each part in the codebooks of round k."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"""SELECT r, p, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e
 FROM (SELECT v.*, b.e, {distance} AS d FROM cut v JOIN book{k} b ON v.p = b.p) GROUP BY r, p"""
