"""Benchmark decontamination by spaced-seed hashing.

A mask is a window of SPAN tokens of which some positions are ignored; a window of a training text and one of a test
item have equal hashes under a mask if they agree in its other positions, whatever was substituted in the ignored ones.
Test hashes are stored as a table and summed up in a bitmap of fixed size. Each training text is hashed once under every
mask; windows whose bit isn't set are dropped where they arise, the others join the test hashes. Around each hit the text
and the item are laid side by side, and the overlap counts if a window of tokens agrees in a sufficient share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import Tables, chunks, giving_back, list_array, mix, signed, word_hashes
from kinograph.session import ship_package

# The masks, 1 where the token counts. Found by a search over masks of six counted tokens: whatever substitutions
# SHARE allows in a window of SPAN to WINDOW tokens, some mask somewhere in the window meets none of them (a test goes through all)
MASKS = ["1111011", "110010111", "11000100111", "111100011", "1101010101", "11101101", "10100001111", "101100001011", "100000101111"]
#: Items of fewer tokens have to occur whole.
SPAN = 12
#: Tokens of the compared window, and the share of them that has to agree.
WINDOW, SHARE = 16, 0.75
#: Bits of the filter of test hashes: 8 MiB, whatever the benchmark.
FILTER_BITS = 1 << 26


def spaced_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash of each window of len(mask) tokens under a mask; shorter by len(mask) - 1."""
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.full(n, number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, on in enumerate(mask):
            if on == "1":
                out = out * np.uint64(0x9FB21C651E98DF25) + mix(hashes[k : k + n], k + 1)
    return mix(out)


def test_hashes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, tokens) and (item_id, mask, at, key) of all items (item_id, text); items without words have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, raw, off in chunks(b.column(1)):
                hashes, words, _ = word_hashes(raw, off)
                yield pa.RecordBatch.from_arrays([ids[i:j], list_array(hashes.view(np.int64), words, pa.int64())], ["item_id", "tokens"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, tokens in zip(b.column(0).to_pylist(), b.column(1)):
                h = np.array(tokens.as_py(), np.int64).view(np.uint64)
                masks = list(enumerate(MASKS)) if len(h) >= SPAN else [(len(MASKS) + len(h), "1" * len(h))]
                for number, mask in masks:
                    keys = spaced_hashes(h, mask, number)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), b.column(0).type), pa.array(np.full(len(keys), number, np.int32)), pa.array(np.arange(len(keys), dtype=np.int32)), signed(keys)], ["item_id", "mask", "at", "key"])

    tokens = items.where("item_id is not null").select("item_id", "text").mapInArrow(giving_back(run), "item_id long, tokens array<long>").where(F.size("tokens") > 0)
    return tokens, tokens.mapInArrow(giving_back(keyed), "item_id long, mask int, at int, key long")


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, tables: Tables | None = None) -> DataFrame:
    """(doc_id, item_id, begin, end, matched): for each document and item the best overlap that counts: tokens begin to end
    (exclusive) of the document, of which `matched` agree with the item.

    Tokens are A-Z lower-cased runs without ASCII white space. An overlap counts if on one diagonal some window of
    min(window, item's tokens) tokens agrees in at least `share` of them; with WINDOW and SHARE the spaced seeds find all of
    these. Items of fewer than SPAN tokens have to occur whole. Null or empty texts, and null ids, have no overlaps; of several
    overlaps the one with most matched tokens counts, then the first. A doc_id that repeats is one document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tables = tables or Tables(spark)
    tokens, keys = test_hashes(items)
    tokens = tables.keep(tokens)
    keys = tables.keep(keys)
    lengths = [r[0] for r in tokens.where(F.size("tokens") < SPAN).select(F.size("tokens")).distinct().collect()]  # SPAN values at most
    place = keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("p"))
    bits = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[bits["w"].to_numpy()] = bits["b"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)
    masks = [(k, m) for k, m in enumerate(MASKS)] + [(len(MASKS) + n, "1" * n) for n in sorted(lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for i, j, raw, off in chunks(b.column(1)):
                hashes, words, _ = word_hashes(raw, off)
                found = []
                for number, mask in masks:
                    key = spaced_hashes(hashes, mask, number)
                    p = (key.view(np.int64) % FILTER_BITS).astype(np.int64)
                    at = np.flatnonzero((filled[p >> 5] >> (p & 31).astype(np.uint32)) & 1)
                    row = np.searchsorted(words, at, "right") - 1
                    at = at[at + len(mask) <= words[row + 1]]  # within one text
                    found.append(np.stack([at, np.full(len(at), number), key[at].view(np.int64)]))
                hits = np.concatenate(found, axis=1)
                hits = hits[:, np.argsort(hits[0], kind="stable")]
                if not hits.shape[1]:
                    continue
                row = np.searchsorted(words, hits[0], "right") - 1
                # hits of a text that are near each other share one stretch of its tokens
                cut = np.flatnonzero((np.diff(hits[0]) > window) | (np.diff(row) > 0)) + 1
                for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [hits.shape[1]]])):
                    r = row[s]
                    begin = max(words[r], hits[0, s] - window)
                    end = min(words[r + 1], hits[0, e - 1] + SPAN + window)
                    out.append((ids[i + r], begin - words[r], hashes[begin:end].view(np.int64), hits[0, s:e] - begin, hits[1, s:e], hits[2, s:e]))
            if out:
                lists = lambda k, kind: pa.array([x[k] for x in out], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in out]), pa.array([int(x[1]) for x in out]), lists(2, pa.int64()), lists(3, pa.int64()), lists(4, pa.int64()), lists(5, pa.int64())], ["doc_id", "begin", "stretch", "ats", "masks", "keys"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    stretches = texts.mapInArrow(giving_back(run), "doc_id long, begin long, stretch array<long>, ats array<long>, masks array<long>, keys array<long>")
    stretches = tables.keep(stretches.withColumn("s", F.monotonically_increasing_id()))
    hits = stretches.select("s", F.explode(F.arrays_zip("ats", "masks", "keys")).alias("h")).select("s", F.col("h.ats").alias("d"), F.col("h.masks").cast("int").alias("mask"), F.col("h.keys").alias("key"))
    diagonals = hits.join(keys, ["mask", "key"]).select("s", "item_id", (F.col("d") - F.col("at")).alias("shift")).distinct()
    side = diagonals.join(stretches.select("s", "doc_id", "begin", "stretch"), "s").join(tokens, "item_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "begin", "end", "matched"]
        for b in batches:
            out = []
            for doc, item, shift, begin, stretch, words in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(b.columns))):
                x, y = np.array(stretch.as_py(), np.int64), np.array(words.as_py(), np.int64)
                low, high = max(0, shift), min(len(x), shift + len(y))
                same = np.concatenate([[0], np.cumsum(x[low:high] == y[low - shift : high - shift])])
                size = min(window, len(y))
                need = size if len(y) < SPAN else int(np.ceil(share * size))
                agreed = same[size:] - same[:-size] if len(same) > size else np.zeros(0, int)
                good = np.flatnonzero(agreed >= need)
                if len(good):
                    s, e = int(good[0]), int(good[-1]) + size
                    out.append((doc, item, begin + low + s, begin + low + e, int(same[e] - same[s])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], names)

    side = side.select("doc_id", "item_id", "shift", "begin", "stretch", "tokens")
    found = side.mapInArrow(giving_back(compare), "doc_id long, item_id long, begin long, end long, matched long")
    best = F.min_by(F.struct("begin", "end", "matched"), F.struct((-F.col("matched")).alias("m"), "begin", "end"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, items: DataFrame, tables: Tables | None = None) -> DataFrame:
    """The rows of docs that overlap with no item; all columns stay."""
    bad = overlaps(docs, items, tables=tables).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, begin, end, matched of every document that holds a passage of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
