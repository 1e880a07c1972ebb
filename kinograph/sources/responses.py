"""A store of model responses by salted key: idempotent batches, the last writer's row for each key, and compaction.

A batch is a folder named after it, so that writing it again replaces it. Reading takes, for each key, the row of the latest time, of
equal times that of the greatest batch name. Compaction writes these rows as a snapshot and then a pointer that names the snapshot and
the batches in it; a reader takes the snapshot and the batches that it doesn't name, so that a compaction that fails changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.text import content_key

RECORD = "key string, at timestamp, model_id string, revision string, max_pixels_per_frame int, frame_indices array<int>, raw string, parsed string"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
#: Folders of a snapshot or batch: a reader of some keys reads theirs alone.
BUCKETS = 16


def salted(prompt_key: Column, model_id: Column, revision: Column, max_new_tokens: Column, max_pixels_per_frame: Column) -> Column:
    """The key of a prompt's response: all that changes an answer besides the prompt is in it."""
    return content_key(prompt_key, model_id, revision, max_new_tokens, max_pixels_per_frame)


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def last_written(rows: DataFrame) -> DataFrame:
    """One row a key: the latest, by its batch's name and then its text where times are equal. Partial aggregation, so that a key
    of very many versions has one row a task."""
    rank = F.struct("at", "batch", "raw", "parsed", "model_id", "revision", "max_pixels_per_frame", "frame_indices")
    newest = rows.groupBy("key").agg(F.max(rank).alias("r"))
    return newest.select("key", *[F.col(f"r.{c}").alias(c) for c in NAMES if c != "key"], "r.batch")


class Responses:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _pointer(self) -> tuple[str | None, list[str]]:
        """The snapshot and the batches in it; pointers are written once each, and the last one counts."""
        if not self._fs.exists(self._at("pointers")):
            return None, []
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("pointers")) if x.getPath().getName().endswith(".json"))
        if not names:
            return None, []
        found = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/pointers/{names[-1]}").collect()))
        return found["snapshot"], found["batches"]

    def batches(self) -> list[str]:
        """The finished batches that are there, in or out of the snapshot."""
        if not self._fs.exists(self._at("batches")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("batches"))]
        return sorted(n for n in names if self._fs.exists(self._at("batches", n, "_SUCCESS")))

    def append(self, rows: DataFrame, batch: str) -> None:
        """Rows of RECORD under the batch's name; the same batch again replaces what it wrote before.

        A batch that a snapshot has already is not written again: it was finished, and its rows are the same.
        """
        if not re.fullmatch(r"[\w.=-]+", batch):
            raise ValueError(f"not a batch's name: {batch!r}")
        if batch in self._pointer()[1]:
            return
        self._write(rows.select(*NAMES).withColumn("batch", F.lit(batch)), f"{self.path}/batches/{batch}")

    def _write(self, rows: DataFrame, at: str) -> None:
        rows.withColumn("bucket", bucket(F.col("key"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)

    def _all(self) -> DataFrame:
        snapshot, inside = self._pointer()
        paths = [f"{self.path}/snapshots/{snapshot}"] * bool(snapshot) + [f"{self.path}/batches/{b}" for b in self.batches() if b not in inside]
        schema = RECORD + ", batch string, bucket int"
        rows = self.spark.createDataFrame([], schema)
        for p in paths:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(p))
        return rows

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The response of each key (of `keys`, column key, where given)."""
        rows = self._all()
        if keys is not None:
            wanted = keys.select("key").distinct().withColumn("bucket", bucket(F.col("key")))
            rows = rows.join(wanted, ["bucket", "key"], "left_semi")
        return last_written(rows.drop("bucket")).drop("batch")

    def compact(self) -> str:
        """Writes a snapshot of all finished batches and points to it; returns its name. Batches stay until purge()."""
        inside = sorted(set(self._pointer()[1]) | set(self.batches()))
        name = uuid.uuid4().hex
        self._write(last_written(self._all().drop("bucket")), f"{self.path}/snapshots/{name}")
        # pointers are numbered, and one is there as a whole or not at all: it is renamed into its place
        n = self._fs.listStatus(self._at("pointers")).__len__() if self._fs.exists(self._at("pointers")) else 0
        staged = self._at(f"_pointer-{name}")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps({"snapshot": name, "batches": inside}).encode()))
        out.close()
        self._fs.mkdirs(self._at("pointers"))
        if not self._fs.rename(staged, self._at("pointers", f"{n:09d}.json")):
            raise RuntimeError("another compaction was first")
        return name

    def purge(self) -> None:
        """Removes the batches and snapshots that the pointer has made needless; readers that began before may still want them."""
        snapshot, inside = self._pointer()
        for b in inside:
            self._fs.delete(self._at("batches", b), True)
        if self._fs.exists(self._at("snapshots")):
            for x in self._fs.listStatus(self._at("snapshots")):
                if x.getPath().getName() != snapshot:
                    self._fs.delete(x.getPath(), True)


def stream_into(stream: DataFrame, store: Responses, checkpoint: str):
    """Starts writing a stream of RECORD rows to the store: a micro-batch that is done again replaces itself."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: store.append(rows, f"stream-{n:09d}"))
