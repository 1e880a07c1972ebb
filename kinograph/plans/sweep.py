"""Sweeps of settings over clips that keep what they have computed.

A store holds results keyed by (clip, judge, setting). A sweep asks for clips and settings; an anti-join with the store's keys leaves
those that are missing, and only they are computed. A part is visible when its list of keys has been written, after its rows: a sweep
that fails leaves nothing behind that a later one could take for a result, and a key without any row is known as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.session import Steps


def setting_key(knobs: dict[str, float | Column]) -> Column:
    """A setting as JSON text, the knobs by name: the same whatever their order.

    Numbers are written as doubles, so that 1 and 1.0 are one setting.
    """
    parts = [F.concat(F.lit(f'"{k}": '), (v if isinstance(v, Column) else F.lit(v)).cast("double").cast("string")) for k, v in sorted(knobs.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def digest(judge: Column, key: Column) -> Column:
    """A short name of a judge's setting: judges never share results, whatever their settings."""
    return F.substring(F.sha2(F.concat(F.length(judge).cast("string"), F.lit(":"), judge, key), 256), 1, 16)


class Store:
    """Results in a folder of Parquet parts, keys beside them, both partitioned by judge and digest.

    rows: the columns of a result besides clip_id, as DDL.
    """

    KEYS = "clip_id string, setting string, part string, judge string, digest string"

    def __init__(self, spark: SparkSession, path: str, rows: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"clip_id string, {rows}, part string, judge string, digest string"

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def keys(self) -> DataFrame:
        """clip_id, judge, digest, setting and part of what is stored, once each: the same key of two parts is the first part's."""
        return self._read("keys", self.KEYS).groupBy("clip_id", "judge", "digest").agg(F.min("setting").alias("setting"), F.min("part").alias("part"))

    def rows(self) -> DataFrame:
        """The stored results of all keys; rows of parts without keys are not results."""
        return self._read("rows", self.schema).join(self.keys().drop("setting"), ["clip_id", "judge", "digest", "part"], "left_semi").drop("part")

    def add(self, keys: DataFrame, rows: DataFrame) -> None:
        """Stores rows (clip_id, judge, digest and the result's columns), then the keys (clip_id, judge, digest, setting)."""
        part = F.lit(uuid.uuid4().hex)
        names = [c.split()[0] for c in self.schema.split(", ")]
        for name, df, columns in (("rows", rows, names), ("keys", keys, [c.split()[0] for c in self.KEYS.split(", ")])):
            # few files for each judge and setting, and none too large
            df.withColumn("part", part).select(columns).hint("rebalance", "judge", "digest").write.mode("append").partitionBy("judge", "digest").parquet(f"{self.path}/{name}")


def wanted(clips: DataFrame, settings: DataFrame, knobs: list[str], judge: str) -> DataFrame:
    """(clip_id, judge, digest, setting, knobs) of every clip and setting; settings is a grid, a few rows that all clips share."""
    key = setting_key({k: F.col(k) for k in knobs})
    grid = settings.select(*knobs, key.alias("setting"), F.lit(judge).alias("judge")).withColumn("digest", digest(F.col("judge"), F.col("setting")))
    listed = grid.agg(F.collect_list(F.struct("judge", "digest", "setting", *knobs)).alias("all"))
    # one row of the whole grid beside each clip
    return clips.select(F.col("clip_id").cast("string").alias("clip_id")).distinct().join(F.broadcast(listed)).select("clip_id", F.explode("all").alias("s")).select("clip_id", "s.*")


def missing(store: Store, asked: DataFrame) -> DataFrame:
    return asked.join(store.keys().select("clip_id", "judge", "digest"), ["clip_id", "judge", "digest"], "left_anti")


def sweep(store: Store, clips: DataFrame, settings: DataFrame, knobs: list[str], judge: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Computes and stores what is missing of clips (clip_id) x settings (knobs); returns how many keys were computed.

    compute: of (clip_id, judge, digest, setting, knobs), the keys to compute, to rows with clip_id, judge, digest and the
    result's columns. It isn't called where nothing is missing.
    """
    # kept, since it is read several times, and the store that it was compared with changes meanwhile
    todo = Steps(store.spark).keep(missing(store, wanted(clips, settings, knobs, judge)))
    n = todo.count()
    if n:
        store.add(todo, compute(todo))
    return n


def results(store: Store, asked: DataFrame) -> DataFrame:
    """The stored rows of the keys asked for (see wanted): scoring them again computes nothing."""
    return store.rows().join(asked, ["clip_id", "judge", "digest"])


def gaps(store: Store, asked: DataFrame) -> DataFrame:
    """(setting, n): how many of the clips asked for a setting still lacks; a report over these would leave them out unsaid."""
    return missing(store, asked).groupBy("setting").agg(F.count("*").alias("n"))
