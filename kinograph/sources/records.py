"""JSON sources of clips, labelled events, predictions and cached responses, and the sinks that write them back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.text import NEGATIVE, TYPES

CLIP = "width int, height int, fps double, n_frames int"
ANCHOR = "struct<frame: int, x: double, y: double>"
EVENT = f"event_id string, event_group_id string, clip_id string, type string, frame_start int, frame_end int, time_start_s double, time_end_s double, person_desc string, vehicle_desc string, person_anchor {ANCHOR}, vehicle_anchor {ANCHOR}, ambiguous boolean, note string"
SUBJECT = "track_id: int, description: string, attributes: map<string,string>"
INTERACTION = f"interaction_id string, event_group_id string, type string, frame_start int, frame_end int, time_start_s double, time_end_s double, person struct<{SUBJECT}>, vehicle struct<track_id: int, class: string, description: string, attributes: map<string,string>>, note string, confidence double, evidence map<string,string>"


def nested(ddl: str) -> str:
    """The fields of a table schema as those of a struct."""
    return re.sub(r"\b(\w+) (?=(?:int|string|double|boolean|struct<|map<|array<))", r"\1: ", ddl)


DOCUMENT = f"clip_id string, clip_meta struct<fps: double, n_frames: int, width: int, height: int>, config_hash string, interactions array<struct<{nested(INTERACTION)}>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def checked_type(kind: Column, allowed: list[str]) -> Column:
    """The type, or a failure that names one that isn't allowed."""
    return F.when(kind.isin(allowed), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null")))))


def clips(spark: SparkSession, path: str) -> DataFrame:
    """Clips from a JSON object keyed by clip id; other keys of a clip are ignored."""
    entries = whole_files(spark, path).select(F.explode(F.from_json("value", f"map<string, struct<{nested(CLIP)}>>")).alias("clip_id", "m"))
    return entries.select("clip_id", "m.*")


def rate(text: Column) -> Column:
    """Frames a second of a rational like 30000/1001; NULL where it can't be told."""
    return F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit("")), F.lit("1")).try_cast("double"))


def labelled_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of {"events": [...]} files with defaults for what is absent; an unknown type fails."""
    shape = f"events array<struct<{nested(EVENT)}>>"
    e = whole_files(spark, path).select(F.explode(F.from_json("value", shape)["events"]).alias("e")).select("e.*")
    return e.withColumns(
        {
            "type": checked_type(F.col("type"), [*TYPES, NEGATIVE]),
            "event_group_id": F.coalesce("event_group_id", "event_id"),
            "ambiguous": F.coalesce("ambiguous", F.lit(False)),
            "note": F.coalesce("note", F.lit("")),
        }
    )


def is_clip_document(value: Column) -> Column:
    """Whether a text is a JSON object with clip_id and interactions."""
    v = F.try_parse_json(value)
    has = lambda name: F.try_variant_get(v, f"$.{name}", "string").isNotNull()
    return F.coalesce(has("clip_id") & F.try_variant_get(v, "$.interactions", "array<variant>").isNotNull(), F.lit(False))


def predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(interactions, rejected paths): files are known by their shape; debug files and other JSON are rejected, not failures."""
    files = whole_files(spark, path).withColumn("good", ~F.endswith("path", F.lit(".debug.json")) & is_clip_document(F.col("value")))
    docs = files.where("good").select(F.from_json("value", DOCUMENT).alias("d"))
    rows = docs.select("d.clip_id", "d.config_hash", F.explode("d.interactions").alias("i")).select("clip_id", "config_hash", "i.*")
    rows = rows.withColumns(
        {
            "event_group_id": F.coalesce("event_group_id", "interaction_id"),
            "note": F.coalesce("note", F.lit("")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "type": checked_type(F.col("type"), TYPES),
            "vehicle": F.struct(F.col("vehicle.track_id").alias("track_id"), F.col("vehicle.class").alias("cls"), F.col("vehicle.description").alias("description"), F.col("vehicle.attributes").alias("attributes")),
        }
    )
    return rows, files.where("not good").select("path")


def clip_documents(interactions: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, value): one JSON document a clip, its interactions in order; clips without any have an empty list.

    interactions: clip_id, config_hash and the columns of predictions(); the vehicle's cls is written as class.
    """
    vehicle = F.struct(F.col("vehicle.track_id").alias("track_id"), F.col("vehicle.cls").alias("class"), F.col("vehicle.description").alias("description"), F.col("vehicle.attributes").alias("attributes"))
    names = [c for c in interactions.columns if c not in ("clip_id", "config_hash")]
    one = F.struct(*[vehicle.alias("vehicle") if c == "vehicle" else F.col(c) for c in names])
    lists = interactions.groupBy("clip_id").agg(F.max("config_hash").alias("config_hash"), F.collect_list(F.struct("frame_start", "interaction_id", one.alias("i"))).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: F.when(a["frame_start"] < b["frame_start"], -1).when(a["frame_start"] > b["frame_start"], 1).when(a["interaction_id"] < b["interaction_id"], -1).when(a["interaction_id"] > b["interaction_id"], 1).otherwise(0)), lambda x: x["i"])
    whole = clips.join(lists, "clip_id", "left").select("clip_id", F.struct("fps", "n_frames", "width", "height").alias("clip_meta"), "config_hash", F.coalesce(ordered, F.array()).alias("interactions"))
    return whole.select("clip_id", F.to_json(F.struct("clip_id", "clip_meta", "config_hash", "interactions")).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines, a folder for each clip."""
    docs.write.mode("overwrite").partitionBy("clip_id").text(path)


def missing_parts(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Names that are wanted and not present."""
    return wanted.select("name").distinct().join(present.select("name"), "name", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cached rows with those of new in the place of equal keys."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def next_number(ids: DataFrame, column: str) -> Column:
    """One more than the largest number at the end of the ids."""
    return F.coalesce(F.max(F.regexp_extract(column, r"(\d+)$", 1).try_cast("long")), F.lit(0)) + 1
