"""SimHash fingerprints and their search, in DataFrame functions alone.

A text's words, lower-cased and weighted by length, vote on the 64 bits of their hash; a bit is set where more weight
votes for it than against. 32 sums hold two votes each, 32 bits apart: a word of L characters weighs at most 2 L and a
string has fewer than 2^31 bytes, so that no sum overflows into its neighbour. Fingerprints within a Hamming radius
are found through permuted block tables: the 64 bits are cut into blocks, and two fingerprints that differ in `radius`
bits agree in all but `radius` blocks, so each choice of the agreeing blocks is the key of one table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import Tables

BITS, RADIUS, BLOCKS = 64, 3, 5
_LANES = 0x0000000100000001


def _weight(word: Column) -> Column:
    size = F.char_length(word)
    return F.when(size > 0, F.greatest(F.lit(1), 2 * size - 5)).otherwise(0).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", out: str = "fp") -> DataFrame:
    """keys and out (long): the fingerprint of each text; equal texts have equal ones, texts without words 0.

    Rows with equal keys count as one text. There is no shuffle where rows are already dealt by some of the keys.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("_w"))
    voting = words.select(*keys, F.xxhash64("_w").alias("_h"), _weight(F.col("_w")).alias("_g"))
    votes = [F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(_LANES)) * F.col("_g")).alias(f"_v{i}") for i in range(32)]
    summed = voting.groupBy(*keys).agg(F.sum("_g").alias("_all"), *votes)
    bits = None
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{i}", 32)
        for bit, lane in ((i, low), (i + 32, high)):
            term = F.shiftleft((2 * lane > F.col("_all")).cast("long"), bit)
            bits = term if bits is None else bits.bitwiseOR(term)
    return summed.select(*keys, bits.alias(out))


def as_string(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """An array of (table, key): the bits of each choice of blocks - radius blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    out = []
    for number, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        out.append(F.struct(F.lit(number).alias("table"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("key")))
    return F.array(*out)


def within_radius(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_fp, fp, distance): for each distinct fingerprint of queries all distinct ones of all_rows within radius.

    Both have a column fp; nulls match nothing. Exact for 0 <= radius < blocks. Equal fingerprints are one row
    on either side, so that copies don't multiply; join the rows back by fingerprint.
    """
    q = queries.where("fp is not null").select(F.col("fp").alias("query_fp")).distinct()
    a = all_rows.where("fp is not null").select("fp").distinct()
    q = q.select("query_fp", F.explode(_block_keys(F.col("query_fp"), radius, blocks)).alias("k")).select("query_fp", "k.*")
    a = a.select("fp", F.explode(_block_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.*")
    near = q.join(a, ["table", "key"]).withColumn("distance", F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))))
    return near.where(F.col("distance") <= radius).select("query_fp", "fp", "distance").distinct()


def next_descending(ids: DataFrame, shifts: tuple[int, ...] = (12, 30, 46)) -> DataFrame:
    """(doc_id, next_id): the next smaller doc_id, the largest after the smallest; of distinct ids that aren't null.

    No task sorts all ids: the next one is looked up among the ids that share all but the lowest 12 bits, and for the
    last of such a run in the next run that isn't empty, which is found in the same way among the runs.
    """
    largest = ids.agg(F.max("doc_id")).first()[0]
    level = ids.select(F.col("doc_id").alias("k"), F.col("doc_id").alias("top"))
    found = []
    for shift in (*shifts, None):
        bucket = F.lit(0).cast("long") if shift is None else F.shiftright("k", shift if not found else shift - found[-1][1])
        inside = Window.partitionBy("b").orderBy(F.desc("k"))
        with_next = level.withColumn("b", bucket).withColumn("next_top", F.lead("top").over(inside))
        found.append((with_next, shift))
        level = with_next.groupBy("b").agg(F.max("top").alias("top")).select(F.col("b").alias("k"), "top")
    upper = None
    for with_next, _ in reversed(found):
        if upper is None:
            upper = with_next.select(F.col("k").alias("b"), "next_top")
            continue
        step = with_next.join(upper.withColumnRenamed("next_top", "beyond"), "b", "left")
        upper = step.select(F.col("k").alias("b"), F.coalesce("next_top", "beyond").alias("next_top"))
    return upper.select(F.col("b").alias("doc_id"), F.coalesce("next_top", F.lit(largest).cast("long")).alias("next_id"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; n_near, for ids divisible by 100: how
    many other rows have a fingerprint within the radius (null for other ids).

    A repeated doc_id gives a row for each combination of its distinct texts with those of the next id. Rows without a doc_id
    have no next document: their fingerprints are given, and what depends on the edited or next text is null.
    """
    tables = Tables(spark)
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, nameless = every.where("doc_id is not null"), every.where("doc_id is null")
    sizes = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))
    order = next_descending(sizes.select("doc_id").distinct())
    wanted = sizes.join(order, "doc_id").select(F.col("doc_id").alias("target"), "next_id", F.floor(F.col("n_chars") / 3).cast("int").alias("cut")).distinct()
    # texts are dealt by doc_id once, for both joins; only the replacing part of the next text travels to its document
    heads = docs.join(wanted, F.col("doc_id") == F.col("next_id"))
    heads = heads.select(F.col("target").alias("doc_id"), "next_id", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    both = docs.join(heads, "doc_id")
    # of a repeated doc_id's texts each has its own cut; not written as an equality, which would deal the texts anew
    both = both.where(F.abs(F.floor(F.char_length("text") / 3) - F.col("cut")) < 1)
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.col("cut")), F.col("head"))
    both = both.select("doc_id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("sha", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)))
    sides = both.select("doc_id", "next_id", "n_chars", "sha", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    fps = fingerprints(sides, ["doc_id", "next_id", "n_chars", "sha", "side"])
    pair = fps.groupBy("doc_id", "next_id", "n_chars", "sha").agg(
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")
    )
    pair = tables.keep(pair)
    following = pair.groupBy("doc_id").agg(F.min("fp").alias("next_fp")).withColumnRenamed("doc_id", "next_id")
    sizes_of = pair.groupBy("fp").agg(F.count("*").alias("rows"))
    queries = pair.where(F.col("doc_id") % 100 == 0)
    near = within_radius(queries, pair).join(sizes_of, "fp").groupBy("query_fp").agg((F.sum("rows") - 1).alias("near"))
    out = pair.join(following, "next_id").join(near.withColumnRenamed("query_fp", "fp"), "fp", "left")
    # equal texts of nameless rows vote alike, so that their rows share one fingerprint
    sized = nameless.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("own"), F.char_length("text").cast("long").alias("n_chars"), "text")
    alone = fingerprints(sized, ["own", "n_chars"]).join(sized.groupBy("own").agg(F.count("*").alias("times")), "own")
    none = {"edited_sha256": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "n_near": "long"}
    alone = alone.select(F.lit(None).cast("long").alias("doc_id"), "n_chars", as_string(F.col("fp")).alias("fingerprint"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))), *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    named = out.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near")).alias("n_near"),
    )
    return named.unionByName(alone.drop("col"))
