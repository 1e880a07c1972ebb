"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Score = w0 + sum(w_i x_i) + sum over factors of ((sum(v_i x_i))^2 - sum((v_i x_i)^2)) / 2: all pairwise interactions in
time linear in the document's features. The machine is fitted in numpy on a bounded sample of labelled rows and applied
to whole texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinograph.llm.common import _SPACE, chunks, combine, giving_back, parts_of, rows_of, word_hashes
from kinograph.session import ship_package

#: Hashed words share so many weights.
BUCKETS = 1 << 13
FACTORS = 6
#: The most labelled rows that a model is fitted on (the smallest hashes of doc_id), and passes over them.
SAMPLE_ROWS, EPOCHS = 6000, 12
STATS = ["upper", "punctuation", "digits", "not_ascii", "space", "word_length", "distinct_words", "distinct_runs", "line_length", "symbol_ends", "shouts", "repeats", "length"]

_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 common punctuation, 5 other ASCII symbol, 6 not ASCII, 7 space
_CLASS[33:127] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[128:] = 6
_CLASS[_SPACE] = 7


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: feature numbers, values, and where each row begins (the statistics come last in a row)."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    kinds = _CLASS[raw]

    def share(mask: np.ndarray, of: np.ndarray = size) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[off]) / of

    hashes, words, starts = word_hashes(raw, off)
    n_words = np.diff(words)
    row = rows_of(words)
    code, count = np.unique((row << 13) | (hashes >> np.uint64(51)).astype(np.int64), return_counts=True)
    at_row, bucket = code >> 13, code & (BUCKETS - 1)
    norm = np.sqrt(np.bincount(at_row, count.astype(float) ** 2, n))
    values = count / np.maximum(norm, 1)[at_row]
    distinct = np.bincount(at_row, minlength=n) / np.maximum(np.minimum(n_words, BUCKETS), 1)
    runs = combine(hashes, 5)
    run_row = row[: len(runs)]
    inside = np.arange(len(runs)) + 5 <= words[1:][run_row] if len(runs) else np.zeros(0, bool)
    run_code = np.unique((run_row[inside] << 44) | (runs[inside] >> np.uint64(20)).astype(np.int64))
    distinct_runs = np.bincount(run_code >> 44, minlength=n) / np.maximum(n_words - 4, 1)
    lines = share(raw == 10) * size + 1
    symbol = (kinds == 5).astype(np.int8)
    symbol_end = symbol.copy()
    symbol_end[:-1] &= kinds[1:] == 7
    repeat = np.bincount(row[1:][hashes[1:] == hashes[:-1]], minlength=n) / np.maximum(n_words, 1) if len(row) else np.zeros(n)
    shout = (raw == ord("!")).astype(np.int8)
    stats = np.stack(
        [
            share(kinds == 1) * 4, share(symbol > 0) * 4, share(kinds == 3) * 4, share(kinds == 6) * 2, share(kinds == 7) * 2,
            np.minimum(size / np.maximum(n_words, 1) / 12, 2), distinct, np.minimum(distinct_runs, 1), np.minimum(np.log1p(size / lines) / 6, 2),
            np.minimum(share(symbol_end, np.maximum(n_words, 1)), 1) * 2, np.minimum(share(shout, np.maximum(n_words, 1)), 1) * 2, np.minimum(repeat, 1) * 3, np.log1p(size) / 10,
        ],
        axis=1,
    )
    per = np.bincount(at_row, minlength=n)
    starts_out = np.concatenate([[0], np.cumsum(per + len(STATS))])
    index = np.empty(starts_out[-1], np.int32)
    value = np.empty(starts_out[-1], np.float32)
    place = np.arange(len(code)) + at_row * len(STATS)
    index[place], value[place] = bucket, values
    tail = (starts_out[1:, None] - len(STATS) + np.arange(len(STATS))).ravel()
    index[tail] = np.tile(BUCKETS + np.arange(len(STATS)), n)
    value[tail] = stats.ravel()
    return index, value, starts_out


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw_scores(self, index: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not len(index):
            return np.full(len(off) - 1, self.bias)
        linear = np.add.reduceat(self.weights[index] * value, off[:-1])
        scaled = self.factors[index] * value[:, None]
        summed = np.add.reduceat(scaled, off[:-1], axis=0)
        squares = np.add.reduceat(scaled * scaled, off[:-1], axis=0)
        return self.bias + linear + 0.5 * (summed * summed - squares).sum(1)

    def scores(self, index: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_scores(index, value, off).astype(float), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adagrad over small batches on the logistic loss. Without rows, or with one label only, a constant machine."""
    size = BUCKETS + len(STATS)
    rng = np.random.default_rng(0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    if not len(rows) or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            off = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])
            row = rows_of(off)
            wrong = (m.scores(index, value, off) - labels[part]).astype(np.float32)
            summed = np.add.reduceat(m.factors[index] * value[:, None], off[:-1], axis=0)
            g = wrong[row] * value
            grad_v = g[:, None] * (summed[row] - m.factors[index] * value[:, None])
            used, slot = np.unique(index, return_inverse=True)
            grad_w = np.bincount(slot, g, len(used)) / len(part) + decay * m.weights[used]
            grad_f = np.stack([np.bincount(slot, grad_v[:, f], len(used)) for f in range(FACTORS)], 1) / len(part) + decay * m.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_f**2
            m.weights[used] -= rate * 2 * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= rate * grad_f / np.sqrt(seen_v[used])
            step = wrong.mean()
            seen_b += step * step
            m.bias -= float(rate * step / np.sqrt(seen_b))
    return m


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most sample_rows labelled documents, those with the smallest hashes of doc_id.

    docs has doc_id and text, labels doc_id and the label (0 or 1); rows with a null in either are left out.
    """
    ship_package(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample_rows)
    # the broadcast side has sample_rows rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys = b.column("doc_id"), b.column("_y")
            for i, j, raw, off in chunks(b.column("text")):
                index, value, at = features(raw, off)
                blob = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([ids[i:j], ys[i:j], blob(index), blob(value)], ["doc_id", "_y", "i", "v"])

    got = rows.mapInArrow(giving_back(sparse), "doc_id long, _y int, i binary, v binary").toArrow()
    order = pc.sort_indices(got, [("doc_id", "ascending"), ("_y", "ascending")]).to_numpy()
    # views of what Arrow holds, so that the driver has the sample once
    index, value = ([x for chunk in got[c].chunks for x in parts_of(chunk, kind)] for c, kind in (("i", np.int32), ("v", np.float32)))
    machine = fit([(index[k], value[k]) for k in order], got["_y"].to_numpy()[order].astype(float))
    del got, index, value
    pa.default_memory_pool().release_unused()
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Adds out: the score of each whole text, from 0 to 1 (null texts count as empty); replaces a column of that name."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(machine)  # fixed size: BUCKETS x (FACTORS + 1) numbers

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.value.scores(*features(raw, off)) for _, _, raw, off in chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    scores = F.arrow_udf(giving_back(scored), T.DoubleType())
    return docs.withColumn(out, scores(F.col(text)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
