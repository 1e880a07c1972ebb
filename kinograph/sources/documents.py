"""A data source of JSON documents: files are planned as partitions, known by their shape, and written all or not at all.

    spark.dataSource.register(Documents)
    spark.read.format("kinograph_documents").option("include", "a,b").load(folder)
    rows.write.format("kinograph_documents").mode("append").save(folder)
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kinograph.session import ship_package

FORMAT = "kinograph_documents"
SCHEMA = "path string, name string, status string, clip_id string, value string"
MANIFEST = "_documents.json"
#: Files are read together up to this many bytes; a larger one is a partition of its own.
PARTITION_BYTES = 16 << 20
#: And up to this many, since a small file takes as long to open as a larger one.
PARTITION_FILES = 1000
#: Files that a commit moves at a time.
MOVES = 16


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shape(text: bytes, stem: str) -> tuple[str, str | None]:
    """(status, clip_id) of a file: document, damaged (no JSON text), other (JSON of another shape), mismatch (a document that
    declares another clip than its file is named after)."""
    try:
        value = json.loads(text.decode("utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError):
        return "damaged", None
    if not isinstance(value, dict) or not isinstance(value.get("clip_id"), str) or not isinstance(value.get("interactions"), list):
        return "other", None
    return ("document" if value["clip_id"] == stem else "mismatch"), value["clip_id"]


@dataclass
class Files(InputPartition):
    """Files to read one after another, or names that were asked for and aren't there."""

    paths: list[str]
    absent: list[str]


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        include = options.get("include")
        self.include = None if include is None else sorted({x.strip() for x in include.split(",") if x.strip()})
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        files, folder = filesystem(self.path)
        found = {}
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            stem = info.base_name.removesuffix(".json")
            if info.type == fs.FileType.File and stem != info.base_name and not stem.startswith(("_", ".")) and (self.include is None or stem in self.include):
                found[stem] = info
        out, size = [Files([], [n for n in self.include or [] if n not in found])], 0
        for _, info in sorted(found.items()):
            if out[-1].paths and (size + info.size > self.most or len(out[-1].paths) >= PARTITION_FILES):
                out.append(Files([], []))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = filesystem(self.path)
        for name in partition.absent:
            yield None, name, "missing", None, None
        for path in partition.paths:
            stem = posixpath.basename(path).removesuffix(".json")
            with files.open_input_stream(path) as f:
                text = f.read()
            status, clip_id = ("debug", None) if stem.endswith(".debug") else shape(text, stem)
            yield path, stem, status, clip_id, (text.decode("utf-8", "replace") if status in ("document", "mismatch", "debug") else None)


@dataclass
class Written(WriterCommitMessage):
    """(staged path, name) of the files of a task."""

    files: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Tasks write to a staging folder; the commit moves all files in place and lists them, or puts back what was there."""

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.name, self.value = schema.fieldNames().index("name"), schema.fieldNames().index("value")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, folder = filesystem(self.path)
        at = f"{folder}/{self.staging}/{uuid.uuid4().hex}"
        files.create_dir(at, recursive=True)
        written = []
        for k, row in enumerate(rows):
            name = row[self.name]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"not a document's name: {name!r}")
            with files.open_output_stream(f"{at}/{k}") as f:
                f.write((row[self.value] or "").encode("utf-8"))
            written.append((f"{at}/{k}", name))
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = filesystem(self.path)
        staged = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in staged]
        if len(set(names)) < len(names):
            raise ValueError(f"documents of one name: {sorted({n for n in names if names.count(n) > 1})[:3]}")
        is_file = lambda path: files.get_file_info(path).type == fs.FileType.File
        before = json.loads(files.open_input_stream(f"{folder}/{MANIFEST}").read()) if is_file(f"{folder}/{MANIFEST}") else []
        gone = sorted(set(before) - set(names)) if self.overwrite else []
        undo: list[tuple[str, str]] = []

        def move(pair: tuple[str, str]) -> None:
            files.move(*pair)
            undo.append(pair[::-1])

        def move_all(pool: ThreadPoolExecutor, pairs: list[tuple[str, str]]) -> None:
            for at in {posixpath.dirname(target) for _, target in pairs}:
                files.create_dir(at, recursive=True)
            list(pool.map(move, pairs))

        try:
            manifest = f"{folder}/{self.staging}/{MANIFEST}"
            with files.open_output_stream(manifest) as f:
                f.write(json.dumps(sorted(set(names) if self.overwrite else set(names) | set(before))).encode())
            # leaving the pool waits for all moves, so that undo has each one
            with ThreadPoolExecutor(MOVES) as pool:
                old = [n for n, there in zip([*gone, *names], pool.map(is_file, [f"{folder}/{n}" for n in [*gone, *names]])) if there]
                move_all(pool, [(f"{folder}/{n}", f"{folder}/{self.staging}/before/{n}") for n in old])
                move_all(pool, [(source, f"{folder}/{name}") for source, name in staged])
            files.move(manifest, f"{folder}/{MANIFEST}")
        except BaseException:
            for target, source in reversed(undo):
                files.create_dir(posixpath.dirname(source), recursive=True)
                files.move(target, source)
            raise
        files.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = filesystem(self.path)
        if files.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.staging}")


class Documents(DataSource):
    """Options: path; include, clip ids that are read and expected (comma-separated); partitionBytes.

    Reading gives a row a file: document, mismatch, damaged, other or debug, and missing for ids without a file; damaged files and
    others have no value. Writing takes
    name (with its ending, folders allowed) and value; overwrite removes what earlier writes listed and this one lacks.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema, overwrite)


def read_documents(spark: SparkSession, path: str, include: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The files of a folder (see Documents)."""
    ship_package(spark)
    spark.dataSource.register(Documents)
    reader = spark.read.format(FORMAT).option("partitionBytes", partition_bytes)
    return (reader if include is None else reader.option("include", ",".join(include))).load(path)


def write_documents(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """rows (name, value) as files of a folder, all or none."""
    ship_package(rows.sparkSession)
    rows.sparkSession.dataSource.register(Documents)
    rows.select("name", "value").write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def with_missing(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """files and, of status missing, the clips of an inventory (clip_id) that have none: a join, for inventories of any size."""
    lacking = inventory.select(F.col("clip_id").cast("string").alias("name")).distinct().join(files.select("name"), "name", "left_anti")
    null = F.lit(None).cast("string")
    return files.unionByName(lacking.select(null.alias("path"), "name", F.lit("missing").alias("status"), null.alias("clip_id"), null.alias("value")))


def pooled_documents(files: DataFrame, schema: str, allow_partial: bool = False) -> DataFrame:
    """(name, document), a struct of the schema, of all accepted files.

    Fails where a file declares another clip than its name, where documents come from several configurations, or where a clip
    of the inventory has no document (unless allow_partial): pooled, they would pass for a complete answer. What is neither
    document nor missing is left out.
    """
    # one row of counts beside the documents, so that nothing passes unless all of it may
    parsed = files.withColumn("document", F.from_json("value", schema))
    kinds = ["mismatch"] if allow_partial else ["mismatch", "missing"]
    bad = F.col("status").isin(kinds)
    said = parsed.agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.concat_ws(" is ", "name", "status"))).alias("first"), F.countDistinct(F.when(F.col("status") == "document", F.col("document.config_hash"))).alias("hashes"))
    fine = said.select(
        F.assert_true(F.col("n") == 0, F.concat(F.lit("documents can't be pooled: "), F.coalesce("first", F.lit("")))).isNull()
        & F.assert_true(F.col("hashes") <= 1, F.lit("documents of several configurations")).isNull()
    ).toDF("_fine")
    return parsed.where("status = 'document'").join(F.broadcast(fine)).where("_fine").select("name", "document")
