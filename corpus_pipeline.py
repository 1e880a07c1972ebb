"""The corpus pipeline: quality, language, near duplicates, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller stores the result as Parquet and hands it to
the next stage. A stage deletes what the stage before it left in the shared folder, once that stage's result is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm import bpe, decontaminate, jaccard, langid, quality
from kinograph.llm.common import Tables

#: Scores from which a document stays.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.5

_left: list[Tables] = []


def _scratch(spark: SparkSession) -> Tables:
    while _left:
        _left.pop().drop()
    _left.append(Tables(spark))
    return _left[-1]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine, fitted on a bounded sample of labelled ones, scores LEAST_QUALITY or more.

    A null text counts as empty; rows that repeat a doc_id are judged one by one.
    """
    _scratch(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train(docs, labels)
    name = langid.fresh(docs, "quality_score")
    return quality.score(docs, machine, out=name).where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of LEAST_LANGUAGE or more.

    Texts that are null or have no letter go; rows that repeat a doc_id are judged one by one. The score is a share among the
    learned languages, so that a text in a language that wasn't learned is rarely rejected.
    """
    tables = _scratch(spark)
    model = langid.train(docs.select("text", "lang"))
    row = langid.fresh(docs, "row")
    # stored, so that a row's number stays; few rows are rejected, and texts needn't be shuffled
    numbered = tables.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    named = langid.scores(numbered, model, [row], learned=F.col("text").isNotNull() & F.col("lang").isNotNull())
    rejected = tables.keep(named.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE)).select(row))
    return numbered.join(rejected, row, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, Jaccard 0.8 or more).

    Texts without words are no duplicates. Of rows that repeat a doc_id all stay or go, rows without a doc_id stay.
    """
    tables = _scratch(spark)
    groups = jaccard.jaccard_components(docs, 5, 80, 100, tables)
    # stored, so that the join is planned by the ids' real size
    later = tables.keep(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows that repeat a doc_id all go if one has a passage; rows without a doc_id
    and null texts stay."""
    tables = _scratch(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = tables.keep(decontaminate.overlaps(docs, items, tables=tables).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every row, null and empty texts included: doc_id, n_tokens, ids (array<int>), ids_sha256, and whether decoding gives the text back."""
    _scratch(spark)
    return bpe.round_trip(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        F.col("coded.ids_sha256").alias("ids_sha256"),
        (F.col("coded.decoded") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("tokens", token_ids),
]

#: The models and tokens aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result stored in the shared folder before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = Tables(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored.keep(docs)
    return docs
