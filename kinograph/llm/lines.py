"""Line-level deduplication: two Bloom filters find suspected repeats, which alone shuffle for exact confirmation.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Tasks build partial filters, one of hashes seen
at least once and one of hashes seen at least twice; where two partial filters meet, what both have seen once has been seen twice.
The bits are kept as segments, so that partial filters are as small as the lines that are in them and are merged by many tasks.
Then only lines whose bits are all in the twice-seen filter shuffle, as 128-bit BLAKE2 digests of their keys, which decide.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import Tables, binary_array, chunks, mix
from kinograph.session import ship_package, table

#: Keys of fewer code points stay wherever they are.
LEAST_LENGTH = 10
#: Bits of each filter, as a power of two; two bits a key. What is broadcast is 2^28 bits (32 MB) at most, whatever the input.
#: With more than some 10^8 different lines, more lines that don't repeat become suspects; the result stays the same.
FILTER_BITS = 28
#: A segment of a filter: its bits have 16-bit places.
SEGMENT = 1 << 16
#: Hashes that a task holds before it passes on what its filters have of them.
HELD = 1 << 18
#: Rows without a doc_id are spread over this many join keys.
SALT = 1024

_BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 8), 23)[_LOWER] | np.uint64(1)


class Lines:
    """The lines of some texts: row of the text, first and last + 1 byte as written, the same of the key, code points of the key."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        ends = np.flatnonzero(raw == 10)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(ends, off)) + 1)
        # both are in the order of the lines, so that sorting pairs each start with its end
        self.start = np.sort(np.concatenate([off[:-1], ends + 1]))
        self.end = np.sort(np.concatenate([ends, off[1:]]))
        solid = np.flatnonzero(_SOLID[raw])
        bounded = np.append(solid, len(raw))
        self.a = np.minimum(bounded[np.searchsorted(solid, self.start)], self.end)
        last = np.searchsorted(solid, self.end) - 1
        self.b = np.maximum(np.where(last >= 0, bounded[np.maximum(last, 0)] + 1, 0), self.a)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.length = points[self.b] - points[self.a]
        self.raw = raw

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the keys of the lines `at`: equal keys have equal ones."""
        with np.errstate(over="ignore"):
            n = len(self.raw)
            up = np.cumprod(np.full(n, _BASE, np.uint64))
            down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[self.raw] * up, dtype=np.uint64)])
            a, b = self.a[at], self.b[at]
            return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64), 29)

    def digests(self, at: np.ndarray) -> list[bytes]:
        """128-bit digests of the keys of the lines `at`."""
        low = _LOWER[self.raw].tobytes()
        return [hashlib.blake2b(low[a:b], digest_size=16).digest() for a, b in zip(self.a[at].tolist(), self.b[at].tolist())]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash."""
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) & mask])


def _partial_filters(least: int, bits: int):
    def build(batches):
        held, n = [], 0

        def passed_on():
            places, count = np.unique(_places(np.concatenate(held), bits), return_counts=True)
            segment = (places >> np.uint64(16)).astype(np.int64)
            low, twice = (places & np.uint64(SEGMENT - 1)).astype(np.uint16), count > 1
            found, first = np.unique(segment, return_index=True)
            off = np.append(first, len(low))
            repeats = np.concatenate([[0], np.cumsum(twice)])[off]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), binary_array(low, off), binary_array(low[twice], repeats)], ["segment", "once", "twice"])

        for batch in batches:
            for _, _, raw, off in chunks(batch.column("text")):
                lines = Lines(raw, off)
                at = np.flatnonzero(lines.length >= least)
                if not len(at):
                    continue
                # a key counts once in each text
                h, row = lines.hashes(at), lines.row[at]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                held.append(h[first])
                n += len(held[-1])
                if n >= HELD:
                    yield passed_on()
                    held, n = [], 0
        if held:
            yield passed_on()

    return build


def _merge_filters(batches):
    """Rows come in the order of segments; of each, the bits of the twice-seen filter, packed."""
    now, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], ["segment", "bits"])

    for batch in batches:
        for segment, seen, again in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
            if segment != now:
                if now is not None and twice.any():
                    yield done()
                now = segment
                once[:], twice[:] = False, False
            places = np.frombuffer(seen, np.uint16)
            twice[places[once[places]]] = True
            twice[np.frombuffer(again, np.uint16)] = True
            once[places] = True
    if now is not None and twice.any():
        yield done()


def twice_seen(docs: DataFrame, least: int = LEAST_LENGTH, bits: int = FILTER_BITS) -> list[tuple[int, bytes]]:
    """The segments of the filter of keys seen at least twice: (segment, zlib-compressed bits), 2^bits bits in all at most."""
    parts = max(1, min(1 << (bits - 16), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    partial = docs.select("text").mapInArrow(_partial_filters(least, bits), "segment int, once binary, twice binary")
    merged = partial.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_merge_filters, "segment int, bits binary")
    return [(r.segment, bytes(r.bits)) for r in merged.collect()]


def _suspects(filters, least: int, bits: int):
    def find(batches):
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for segment, part in filters.value:
            packed[segment * (SEGMENT >> 3) : (segment + 1) * (SEGMENT >> 3)] = np.frombuffer(zlib.decompress(part), np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            holders: dict[bytes, set[int]] = {}
            for i, _, raw, off in chunks(batch.column("text")):
                lines = Lines(raw, off)
                at = np.flatnonzero(lines.length >= least)
                if not len(at):
                    continue
                places = _places(lines.hashes(at), bits)
                hit = (packed[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
                at = at[hit.reshape(2, -1).all(0)]
                for row, digest in zip(lines.row[at].tolist(), lines.digests(at)):
                    holders.setdefault(digest, set()).add(ids[i + row])
            if holders:
                yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.binary()), pa.array([sorted(x) for x in holders.values()], pa.list_(pa.int64()))], ["digest", "docs"])

    return find


def _without(least: int):
    def drop(batches):
        for batch in batches:
            sets = batch.column("gone").to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for i, _, raw, off in chunks(batch.column("text")):
                lines = Lines(raw, off)
                stays = np.ones(len(lines.row), bool)
                some = np.array([bool(sets[i + r]) for r in range(len(off) - 1)])
                at = np.flatnonzero((lines.length >= least) & some[lines.row]) if some.any() else np.zeros(0, np.int64)
                gone = {r: set(sets[i + r]) for r in np.flatnonzero(some).tolist()}
                stays[at] = [digest not in gone[row] for row, digest in zip(lines.row[at].tolist(), lines.digests(at))] if len(at) else []
                data, bounds = raw.tobytes(), np.searchsorted(lines.row, np.arange(len(off)))
                for r in range(len(off) - 1):
                    a, b = bounds[r], bounds[r + 1]
                    left = np.flatnonzero(stays[a:b]) + a
                    n_lines.append(int(b - a))
                    n_dropped.append(int(b - a - len(left)))
                    kept.append(data[off[r] : off[r + 1]] if len(left) == b - a else b"\n".join(data[s:e] for s, e in zip(lines.start[left].tolist(), lines.end[left].tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).view(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    return drop


def dedup_lines(docs: DataFrame, least: int = LEAST_LENGTH, bits: int = FILTER_BITS, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of each row: its text without the lines whose key a smaller doc_id has too.

    A text is split at newlines; null and empty texts have one empty line, and kept is empty where no line stays. Keys of fewer
    than `least` code points stay, and so do all lines of the smallest doc_id that holds a key, repeats among them. Rows that
    repeat a doc_id belong to one document: each is answered, and none of them makes another lose a line. Rows without a doc_id
    keep all lines and take none from others, as they have no order. A row holds no more than one text's own digests beside it.

    A line that most documents share meets others as one row a batch of documents, not one a document; its least doc_id is found
    with partial aggregation, and the join that returns it to its documents is one that Spark splits where it is skewed.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tables = Tables(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id") if isinstance(doc_id, str) else doc_id.cast("long").alias("doc_id"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"))
    known = docs.where("doc_id is not null")
    filters = spark.sparkContext.broadcast(twice_seen(known, least, bits))
    suspects = tables.keep(known.mapInArrow(_suspects(filters, least, bits), "digest binary, docs array<long>"))
    firsts = suspects.groupBy("digest").agg(F.min(F.array_min("docs")).alias("first"), F.max(F.array_max("docs")).alias("last")).where("first < last")
    later = suspects.join(firsts.select("digest", "first"), "digest").select(F.explode(F.filter("docs", lambda d: d > F.col("first"))).alias("doc_id"), "digest")
    gone = later.groupBy("doc_id").agg(F.collect_set("digest").alias("gone")).withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALT)) + 1).otherwise(0).cast("int")
    # the texts aren't sorted: the lists of digests are hashed
    met = docs.withColumn("salt", salt).join(gone.hint("shuffle_hash"), ["doc_id", "salt"], "left")
    return met.select("doc_id", "text", "gone").mapInArrow(_without(least), "doc_id long, kept string, n_lines long, n_dropped long")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of the whole `documents`: one row a document, with the digest of what is kept (see dedup_lines)."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM parts),
keyed AS (SELECT *, translate(trim(line, {white}), '{upper}', '{lower}') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT d.*, coalesce(d.doc_id > f.first, false) AS gone FROM keyed d LEFT JOIN firsts f ON d.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
