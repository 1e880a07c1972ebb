"""Language identification by words first: per-language log frequencies of known words; a word that isn't known is scored
by its longest character n-grams that are, then by shorter ones.

Learning counts every word and n-gram of all training texts: each task adds up its own, a shuffle adds the tasks' counts
up. All counts stay, by 64-bit hash, in a shuffled table. Every task holds the most frequent words and n-grams; the others
are joined to that table, so how many a task holds has no part in the result.
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

from kinograph.llm.common import Tables, chunks, combine, giving_back, list_array, mix, most_frequent, rows_of, signed, word_hashes
from kinograph.llm.quality import held_out
from kinograph.session import ship_package

#: Words and n-grams that every task holds (the most frequent), and the longest n-grams.
WORDS, GRAMS, LONGEST = 1 << 16, 1 << 16, 4
#: A task hands on its counts when it holds so many, so that its memory is bounded.
HELD = 2_000_000

# letters and bytes outside ASCII stay; other ASCII bytes part words
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def letter_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cleaned = _LETTERS[raw]
    return cleaned, *word_hashes(cleaned, off)


def spelled(cleaned: np.ndarray, starts: np.ndarray, which: np.ndarray) -> list[str]:
    """The words that begin at starts[which]."""
    data = cleaned.tobytes()
    ends = np.append(starts[1:], len(cleaned))
    return [data[starts[k] : ends[k]].split(None, 1)[0].decode("utf-8", "replace") for k in which.tolist()]


def word_ngrams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to LONGEST: the hashes of all character n-grams of the words, and the number of each one's word. A word is
    held between two spaces, which count as characters."""
    if not words:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * LONGEST
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words])
    owner = np.append(np.repeat(np.arange(len(words)), sizes), len(words) - 1)
    scrambled = mix(points)
    out = []
    for n in range(1, LONGEST + 1):
        code = combine(scrambled, n)
        own = owner[: len(code)]
        # an n-gram lies in one word with its two spaces: no space within
        inner = np.ones(len(code), bool)
        for k in range(1, n - 1):
            inner &= points[k : k + len(code)] != 32
        if n == 1:
            inner &= points[: len(code)] != 32
        out.append((code[inner], own[inner]))
    return out


@dataclass
class Held:
    """What every task holds of the model: hashes, sorted, and their log frequencies in each language."""

    keys: np.ndarray
    scores: np.ndarray  # (keys, languages)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are held, and the log frequencies of each (0 where it isn't)."""
        out = np.zeros((len(hashes), self.scores.shape[1]))
        if not len(self.keys):
            return np.zeros(len(hashes), bool), out
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        out[hit] = self.scores[at[hit]]
        return hit, out


@dataclass
class Languages:
    names: list[str]
    words: Held
    grams: list[Held]  # for n = 1 to LONGEST
    scale: np.ndarray  # (LONGEST + 1, languages): what a count + 0.5 is divided by; n = 0 for words
    table: DataFrame  # n, key, by (array of lang, c): every word and n-gram

    def logs(self, n: int, by: str = "by") -> list[Column]:
        """The log frequency in each language of a key of the table."""
        c = F.map_from_entries(by)
        return [F.log10((F.coalesce(c[name], F.lit(0)) + 0.5) / float(self.scale[n, k])) for k, name in enumerate(self.names)]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, slot = np.unique(np.concatenate(keys), return_inverse=True)
    return all_keys, np.bincount(slot, np.concatenate(counts)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """Counts (lang, n, key, c) over all texts: n = 0 has words, n > 0 n-grams, both by 64-bit hash. Needs text and lang."""
    ship_package(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[list, list]] = {}
        size = 0

        def hand_on():
            for (lang, n), (keys, counts) in held.items():
                k, c = _counted(keys, counts)
                for at in range(0, len(k), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    m = len(k[part])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(np.full(m, n, np.int32)), signed(k[part]), pa.array(c[part])], ["lang", "n", "key", "c"])
            held.clear()

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for i, j, raw, off in chunks(b.column("text")):
                cleaned, hashes, words, starts = letter_words(raw, off)
                row_lang = langs[i:j][rows_of(words)]
                for lang in set(langs[i:j]):
                    mine = np.flatnonzero(row_lang == lang)
                    if not len(mine):
                        continue
                    distinct, first, number = np.unique(hashes[mine], return_index=True, return_counts=True)
                    grams = word_ngrams(spelled(cleaned, starts, mine[first]))
                    for n, (keys, counts) in enumerate([(distinct, number), *((c, number[own]) for c, own in grams)]):
                        if n:
                            keys, counts = _counted([keys], [counts])
                        slot = held.setdefault((lang, n), ([], []))
                        slot[0].append(keys)
                        slot[1].append(counts)
                        size += len(keys)
                if size > HELD:
                    for k, (keys, counts) in held.items():
                        merged = _counted(keys, counts)
                        held[k] = ([merged[0]], [merged[1]])
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > HELD // 2:
                        yield from hand_on()
                        size = 0
        yield from hand_on()

    parts = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # dealt by key alone: a key's languages are needed together next, and a task has few rows of one key
    return parts.mapInArrow(giving_back(partial), "lang string, n int, key long, c long").repartition("n", "key").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Languages:
    """The model of these texts' languages; rows without a text or lang are left out.

    The driver gets a row for each of the most frequent words and n-grams, `words` and `grams` at most, whatever the input; the model's
    table has all of them and stays in the shared folder.
    """
    tables = Tables(docs.sparkSession)
    by_key = count(docs).groupBy("n", "key").agg(F.sum("c").alias("total"), F.collect_list(F.struct("lang", "c")).alias("by"))
    by_key = tables.keep(by_key)
    each = by_key.select("n", F.explode("by").alias("x")).groupBy("n", "x.lang").agg(F.sum("x.c").alias("s"), F.count("*").alias("d"))
    sums = {(r.n, r.lang): (r.s, r.d) for r in each.collect()}
    names = sorted({lang for n, lang in sums if n == 0})
    whole = np.array([[sums.get((n, x), (0, 0)) for x in names] for n in range(LONGEST + 1)], float).reshape(LONGEST + 1, len(names), 2)
    scale = whole[:, :, 0] + 0.5 * (whole[:, :, 1].max(1, initial=1)[:, None] + 1)

    def held(n: int, got: pa.Table) -> Held:
        c = np.zeros((len(got), len(names)))
        # by Arrow's columns: as Python's objects, so many rows are some hundred MB of the driver
        by = got["by"].combine_chunks()
        each = by.flatten()
        lang = pc.index_in(pc.struct_field(each, "lang"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        c[np.repeat(np.arange(len(by)), pc.list_value_length(by).to_numpy(zero_copy_only=False)), lang] = pc.struct_field(each, "c").to_numpy(zero_copy_only=False)
        keys = got["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return Held(keys[order], np.log10((c[order] + 0.5) / scale[n]))

    top = most_frequent(by_key.where("n = 0"), "total", words).select("key", "by").toArrow()
    longer = most_frequent(by_key.where("n > 0"), "total", grams).select("n", "key", "by").toArrow()
    of = longer["n"].to_numpy()
    model = Languages(names, held(0, top), [held(n, longer.filter(pa.array(of == n))) for n in range(1, LONGEST + 1)], scale, by_key.select("n", "key", "by"))
    del top, longer
    pa.default_memory_pool().release_unused()
    return model


def _heads(docs: DataFrame, model: Languages) -> DataFrame:
    """kept, sums (by language, of the words that every task holds), lettered, and the other words: hash, times, and spelling,
    which is null in rows that were learned from."""
    held = docs.sparkSession.sparkContext.broadcast(model.words)  # WORDS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            lettered = pc.fill_null(pc.match_substring_regex(b.column("text"), r"\pL"), False)
            learned = b.column("learned").to_numpy(zero_copy_only=False)
            for i, j, raw, off in chunks(b.column("text")):
                cleaned, hashes, words, starts = letter_words(raw, off)
                distinct, first, slot = np.unique(hashes, return_index=True, return_inverse=True)
                hit, vectors = m.find(distinct)
                row, n = rows_of(words), j - i
                sums = np.stack([np.bincount(row, vectors[slot, k], n) for k in range(vectors.shape[1])], 1)
                missed = ~hit[slot]
                code, times = np.unique(row[missed] * (len(distinct) + 1) + slot[missed], return_counts=True)
                of, which = np.divmod(code, len(distinct) + 1)
                at = np.searchsorted(of, np.arange(n + 1))
                silent = learned[i:j][of]
                spelt = np.unique(which[~silent])
                number = np.where(silent, 0, np.searchsorted(spelt, which))
                names = pa.array(spelled(cleaned, starts, first[spelt]), pa.string()).take(pa.array(number, mask=silent))
                columns = [
                    b.column("kept")[i:j], list_array(sums.ravel(), np.arange(n + 1) * sums.shape[1], pa.float64()), lettered[i:j],
                    list_array(distinct[which].view(np.int64), at, pa.int64()), list_array(times.astype(np.int64), at, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), names),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["kept", "sums", "lettered", "key", "t", "word"])

    longs = T.ArrayType(T.LongType())
    kinds = {"sums": T.ArrayType(T.DoubleType()), "lettered": T.BooleanType(), "key": longs, "t": longs, "word": T.ArrayType(T.StringType())}
    return docs.mapInArrow(giving_back(run), T.StructType([docs.schema["kept"], *[T.StructField(c, k) for c, k in kinds.items()]]))


def _by_grams(words: DataFrame, model: Languages, tables: Tables) -> DataFrame:
    """(key, v): for each of these distinct words (key, word) the mean log frequencies, by language, of its longest known n-grams.
    A word without any has no row."""
    held = words.sparkSession.sparkContext.broadcast(model.grams)  # GRAMS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = len(b)
            for n, (codes, own) in enumerate(word_ngrams(b.column("word").to_pylist()), 1):
                hit, vectors = held.value[n - 1].find(codes)
                sums = np.stack([np.bincount(own, vectors[:, k], size) for k in range(vectors.shape[1])], 1)
                at = np.searchsorted(own[~hit], np.arange(size + 1))
                columns = [
                    b.column("key"), pa.array(np.full(size, n, np.int32)), pa.array(np.bincount(own[hit], minlength=size).astype(np.int64)),
                    list_array(sums.ravel(), np.arange(size + 1) * sums.shape[1], pa.float64()), list_array(codes[~hit].view(np.int64), at, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "m", "v", "gram"])

    split = tables.keep(words.mapInArrow(giving_back(run), "key long, n int, m long, v array<double>, gram array<long>"))
    others = split.select("key", "n", F.explode("gram").alias("gram"))
    # the frequent n-grams aren't here, so no n-gram is hot
    met = others.join(model.table.where("n > 0").withColumnRenamed("key", "gram"), ["n", "gram"])
    logs = F.coalesce(*[F.when(F.col("n") == n, F.array(*model.logs(n))) for n in range(1, LONGEST + 1)])
    parts = split.select("key", "n", "m", "v").where("m > 0").unionByName(met.select("key", "n", F.lit(1).cast("long").alias("m"), logs.alias("v")))
    # dealt by word alone: its lengths of n-grams are compared next
    means = F.array(*[F.sum(F.col("v")[k]) / F.sum("m") for k in range(len(model.names))])
    return parts.repartition("key").groupBy("key", "n").agg(means.alias("v")).groupBy("key").agg(F.max_by("v", "n").alias("v"))


def scores(docs: DataFrame, model: Languages, keep: list[str], text: str = "text", learned: Column | None = None) -> DataFrame:
    """The columns `keep` of every row of docs with lang_pred, a learned language, or `und` with score 0 where the text is null or
    has no letter or nothing was learned; score: the likelihood's share among the languages.

    learned may name rows whose texts the model was learned from: it knows all their words, so that their spelling needn't be
    stored and shuffled. It has no part in the result.
    """
    if not model.names:
        return docs.select(*keep).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    ship_package(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    known = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    heads = _heads(docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), known.alias("learned")), model)
    heads = tables.keep(heads.withColumn("row", F.monotonically_increasing_id()))
    tail = heads.select("row", F.explode(F.arrays_zip("key", "t", "word")).alias("x")).select("row", "x.*")
    # the frequent words aren't here, so no word of the table is hot
    met = tail.join(model.table.where("n = 0").select("key", "by"), "key", "left")
    # a known word needs neither hash nor spelling any more
    met = tables.keep(met.select("row", "t", *[F.when(F.col("by").isNull(), F.col(c)).alias(c) for c in ("key", "word")], "by"))
    unknown = met.where("by is null")
    vectors = _by_grams(unknown.groupBy("key").agg(F.first("word").alias("word")), model, tables)
    parts = met.where("by is not null").select("row", "t", F.array(*model.logs(0)).alias("v")).unionByName(unknown.select("row", "key", "t").join(vectors, "key").select("row", "t", "v"))
    more = parts.groupBy("row").agg(F.array(*[F.sum(F.col("t") * F.col("v")[k]) for k in range(len(model.names))]).alias("more"))
    both = heads.select("kept", "sums", "lettered", "row").join(more, "row", "left")
    total = both.withColumn("sums", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b)))
    top = F.array_max("sums")
    name = F.element_at(F.array(*map(F.lit, model.names)), F.array_position("sums", top).cast("int"))
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return total.select("kept.*", F.when(F.col("lettered"), name).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), share).otherwise(0.0).alias("score"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, as scores() gives them; replaces columns of those names."""
    return scores(docs, model, [c for c in docs.columns if c.lower() not in ("lang_pred", "score")], text)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the texts outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    out = scores(docs, model, ["doc_id"], learned=~held_out(F.col("doc_id"), 4, 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
