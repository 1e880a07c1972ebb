"""What several corpus operators share: word hashing in numpy, tables in the shared folder, running totals."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.session import shared_dir

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in pieces of about this many bytes, so that a worker holds a bounded number of temporary arrays.
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Gives freed memory back to the system, where its C library can: Python workers stay between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for a task's batches; its worker keeps none of the memory that it used for them."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit scrambler (xor-shift and multiply)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(256, dtype=np.uint64) * _GOLDEN, 7) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_WORD = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 places where they begin (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased; words are the longest runs without ASCII white space.

    Returns the hashes of all words in order, the n + 1 places where each text's words begin, and each word's first byte.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = off[:-1][off[:-1] < n]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), starts
    word = np.cumsum(first, dtype=np.int32) - 1
    place = np.arange(n, dtype=np.int32) - starts.astype(np.int32)[np.maximum(word, 0)]
    place[: starts[0]] = 0
    longest = int(place.max(initial=0)) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(longest, 0xD6E8FEB86659FD93, np.uint64))
        # trailing white space adds nothing
        sums = np.add.reduceat(_BYTE_WORD[raw] * power[place], starts)
        hashes = mix(sums)
    return hashes, np.searchsorted(starts, off), starts


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, places) for runs of texts of about chunk_bytes; a longer text is a run of its own."""
    raw, off = text_buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk_bytes, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each element of a flat array whose rows begin at off."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive hashes; shorter by width - 1."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9FB21C651E98DF25) + mix(hashes[k : k + len(out)], k + 1)
        return mix(out)


def shingle_sets(hashes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct word shingles, sorted, and where each text's begin.

    A text with fewer words than width has its whole sequence as its one shingle; one without words has none.
    """
    n_words = np.diff(off)
    runs = combine(hashes, width)
    row = rows_of(off)[: len(runs)]
    inside = np.arange(len(runs)) + width <= off[1:][row] if len(runs) else np.zeros(0, bool)
    values, rows = runs[inside], row[inside]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        whole = [combine(hashes[off[r] : off[r + 1]], int(n_words[r]))[0] ^ np.uint64(n_words[r]) for r in short]
        values, rows = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(len(off)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def binary_array(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary value for each row: the bytes of its part of values."""
    data = np.ascontiguousarray(values)
    places = (off * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data.tobytes())])


def parts_of(column: pa.Array, kind: type) -> list[np.ndarray]:
    """binary_array() taken apart: each row's values, as views of the column's bytes."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2] if off[-1] > off[0] else b""
    return [np.frombuffer(data, kind, (b - a) // np.dtype(kind).itemsize, a if b > a else 0) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


class Tables:
    """Parquet tables of one operator call in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark), 0
        self.named: dict[str, DataFrame] = {}
        # a query's result is read from these tables after it has been returned, so that they go with the application
        atexit.register(self._leave)

    def _leave(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop()

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """df, stored; with a name it can be looked up in `named`."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        if name:
            self.named[name] = kept
        return kept

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        atexit.unregister(self._leave)


def running_total(df: DataFrame, by: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows before this one within by, in the order of bucket, then order.

    Two levels, so that no task sorts all rows of one by: sums within (by, bucket), and offsets from the buckets' totals.
    The number of buckets has to be bounded by the caller.
    """
    df = df.withColumn("_v", value)
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(F.sum("_v").alias("_t"))
    outer = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, bucket, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    inside = df.withColumn("_i", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return inside.join(offsets, [*by, bucket]).withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_i", "_o", "_v")


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, `most` at most: all rows from a cut-off that a histogram of the counts gives.

    The histogram has some 8000 rows whatever the input, so no task sorts or gathers every partition's own top rows.
    """
    c = F.col(count)
    place = F.when(c < 4096, c.cast("int")).otherwise((4096 + F.floor(F.log2(c.cast("double")) * 64)).cast("int"))
    held, cut = 0, None
    for place_of, rows in sorted(((r.p, r.n) for r in counted.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if held + rows > most:
            break
        held, cut = held + rows, place_of
    if cut is None:  # a single count that more rows share
        return counted.orderBy(F.desc(count)).limit(most)
    return counted.where(place >= cut)
