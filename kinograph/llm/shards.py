"""Sharding by balanced label propagation: documents that are linked move towards one shard under capacity quotas.

Documents of one group are linked with each other and are alike otherwise, so the state that propagates is the number of
documents that each group has in each shard, not the documents. In a round each group asks to move to the shard that
holds most of it and has room; a running total in each target admits moves, larger groups first, until its quota is
used, the last of them in part. A group that is larger than a shard thus fills one shard after the other. In the end the
few documents above a shard's exact quota, unlinked ones first, go where rows are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import Tables, running_total

SHARDS, ROUNDS = 24, 14
#: Rows that one task orders, about, and the most parts into which running totals are cut.
ORDERED_ROWS, MOST_PARTS = 10_000, 4096


def _spread(df: DataFrame, state: DataFrame, shards: int, rounds: int, quota: int, tables: Tables) -> DataFrame:
    """Label propagation on state (g, shard, c); gives its last state. The driver sees one row a shard."""
    for _ in range(rounds):
        load = {r.shard: r.c for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
        room = {s: quota - load.get(s, 0) for s in range(shards)}
        spare = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, room[s]))])
        of_group = Window.partitionBy("g")
        best = F.max(F.when(spare[F.col("shard")] > 0, F.struct("c", (-F.col("shard")).alias("k")))).over(of_group)
        asked = state.withColumn("best", best).withColumn("all", F.sum("c").over(of_group)).withColumn("to", -F.col("best.k"))
        asked = asked.where(F.col("to").isNotNull() & (F.col("to") != F.col("shard")))
        # a row leaves a fuller shard only where that shard has too much, or ties would swap for ever
        asked = asked.where((F.col("c") < F.col("best.c")) | ((F.col("c") == F.col("best.c")) & (F.col("to") < F.col("shard"))))
        rank = F.lit(64) - F.floor(F.log2(F.col("all"))).cast("int")
        ordered = running_total(asked.withColumn("part", rank * 64 + F.pmod("g", F.lit(64)).cast("int")), ["to"], "part", ["g", "shard"], F.col("c"), "before")
        moved = ordered.withColumn("n", F.greatest(F.lit(0), F.least(F.col("c"), spare[F.col("to")] - F.col("before")))).where("n > 0")
        moved = tables.keep(moved.select("g", "shard", "to", "n"))
        if moved.isEmpty():
            break
        change = moved.select("g", "shard", (-F.col("n")).alias("c")).union(moved.select("g", F.col("to").alias("shard"), F.col("n").alias("c")))
        state = tables.keep(state.union(change.select("g", "shard", F.col("c").cast("long"))).groupBy("g", "shard").agg(F.sum("c").alias("c")).where("c > 0"))
    return state


def balanced_shards(docs: DataFrame, group: str, shards: int = SHARDS, rounds: int = ROUNDS, tables: Tables | None = None) -> DataFrame:
    """docs (doc_id, group: a long, and other columns) with shard and slot: row counts of shards differ by one at most,
    and slots count each shard's rows from 0 without gaps.

    Rows with equal group are linked; a null group is linked with nothing. Rows that repeat a doc_id, or have none, each get a
    slot. Other columns may have any names; shard and slot are replaced. docs has to give the same rows whenever it is read (a
    stored table). Links other than equal groups (an edge list) aren't taken.
    """
    spark = docs.sparkSession
    tables = tables or Tables(spark)
    kept_names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept_names])
    docs = docs.select(F.col("doc_id"), F.col(f"`{group}`").alias("same"), whole.alias("whole"))
    group = "same"
    total = docs.count()
    least, extra = divmod(total, shards)
    parts = max(1, min(MOST_PARTS, total // ORDERED_ROWS))
    rows = docs.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    counts = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col("home").alias("shard")).agg(F.count("*").alias("c"))
    state = tables.keep(counts.withColumn("all", F.sum("c").over(Window.partitionBy("g"))).where("all > 1").drop("all"))
    state = _spread(rows, state, shards, rounds, least, tables)

    # a group's documents, in any fixed order, take its places shard by shard; at most `shards` places each
    upto = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = state.withColumn("lo", F.coalesce(F.sum("c").over(upto), F.lit(0))).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("lo", "shard"))).alias("places"))
    ids = F.xxhash64("doc_id")
    linked = rows.where(F.col(group).isNotNull()).withColumn("_b", F.pmod(F.shiftright(ids, 20), F.lit(parts)).cast("int"))
    ranked = running_total(linked, [group], "_b", ["doc_id"], F.lit(1), "rank")
    with_places = ranked.join(places.withColumnRenamed("g", group), group, "left")
    chosen = F.element_at(F.filter("places", lambda x: x["lo"] <= F.col("rank")), -1)["shard"]
    placed = with_places.withColumn("at", F.coalesce(chosen, F.col("home"))).withColumn("single", F.col("places").isNull().cast("int"))
    lone = rows.where(F.col(group).isNull()).withColumn("at", F.col("home")).withColumn("single", F.lit(1))
    kept_columns = [*docs.columns, "at", "single"]
    placed = placed.select(*kept_columns).union(lone.select(*kept_columns))
    # unlinked rows come last, so that they are the ones beyond a quota; parts are even whatever the groups' sizes
    part = F.col("single") * parts + F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit(1)), 20), F.lit(parts)).cast("int")
    placed = tables.keep(running_total(placed.withColumn("_p", part), ["at"], "_p", ["doc_id", group], F.lit(1), "rank").drop("_p", "single"))

    load = {r["at"]: r["c"] for r in placed.groupBy("at").agg(F.count("*").alias("c")).collect()}
    quota = [least + (s < extra) for s in range(shards)]
    kept = [min(load.get(s, 0), quota[s]) for s in range(shards)]
    quotas = F.array(*[F.lit(q) for q in quota])
    stay = placed.where(F.col("rank") < F.get(quotas, F.col("at"))).select(*docs.columns, F.col("at").alias("shard"), F.col("rank").alias("slot"))
    over = placed.where(F.col("rank") >= F.get(quotas, F.col("at")))
    over = over.withColumn("_all", F.lit(0)).withColumn("_p", F.pmod(F.xxhash64("at", "rank"), F.lit(parts)).cast("int"))
    over = running_total(over, ["_all"], "_p", ["at", "rank"], F.lit(1), "extra")
    begin, open_places = 0, []
    for s in range(shards):
        if quota[s] > kept[s]:
            open_places.append(F.struct(F.lit(begin).cast("long").alias("lo"), F.lit(s).alias("shard"), F.lit(kept[s]).cast("long").alias("slot")))
            begin += quota[s] - kept[s]
    if open_places:
        place = F.element_at(F.filter(F.array(*open_places), lambda x: x["lo"] <= F.col("extra")), -1)
        over = over.withColumn("_x", place)
        stay = stay.union(over.select(*docs.columns, F.col("_x.shard").alias("shard"), (F.col("_x.slot") + F.col("extra") - F.col("_x.lo")).alias("slot")))
    return stay.select("whole.*", "shard", "slot")


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`; equal texts are linked."""
    tables = Tables(spark)
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("same_text")
    )
    out = balanced_shards(tables.keep(docs), "same_text", SHARDS, tables=tables)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
