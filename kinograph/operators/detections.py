"""Operators on detections: top-k, suppression, tiling, class maps, tracks' inventories, door cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.functions.text import SYNONYMS
from kinograph.session import ship_package


def top_k(dets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most confident detections of each key, ties by coordinates."""
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "x1", "y1", "x2", "y2")
    return dets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _survivors(boxes: np.ndarray, iou: float, ios: float | None) -> np.ndarray:
    """Which of these boxes (x1, y1, x2, y2), best first, no better survivor overlaps."""
    x1, y1, x2, y2 = boxes.T
    area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    kept = np.ones(len(boxes), bool)
    for i in range(len(boxes) - 1):
        if not kept[i]:
            continue
        rest = slice(i + 1, None)
        inter = np.maximum(np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]), 0) * np.maximum(np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]), 0)
        union, smaller = area[i] + area[rest] - inter, np.minimum(area[i], area[rest])
        hit = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) >= iou
        if ios is not None:
            hit |= np.divide(inter, smaller, out=np.zeros_like(inter), where=smaller > 0) >= ios
        kept[rest] &= ~hit
    return kept


def suppress(dets: DataFrame, keys: list[str], iou: float = 0.5, ios: float | None = 0.75, per_key: int | None = None) -> DataFrame:
    """Greedy suppression within each key: confident ones first (ties: larger area, then coordinates); one that overlaps a kept
    one by iou, or by ios of the smaller box, goes. All boxes of a key take part, unless per_key cuts it to its most confident.

    One exchange by the keys and a sort; a task holds the boxes of one key (a class in one picture) at a time. Rows with a
    missing coordinate overlap nothing.
    """
    ship_package(dets.sparkSession)
    coordinates = ["x1", "y1", "x2", "y2", "conf"]
    chosen = (dets if per_key is None else top_k(dets, keys, per_key)).select(*keys, *[F.col(c).cast("double").alias(c) for c in coordinates])
    order = [F.desc("conf"), F.desc(B.area(B.box())), "x1", "y1", "x2", "y2"]
    dealt = chosen.withColumn("_key", F.hash(*keys)).repartition(*keys).sortWithinPartitions("_key", *keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def survivors(t: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
            boxes = np.stack([t[c].to_numpy() for c in coordinates[:4]], 1)
            kept = np.concatenate([_survivors(boxes[a:b], iou, ios) for a, b in zip(starts, np.append(starts[1:], len(t)))])
            return t.filter(pa.array(kept)).drop_columns(["_key"]).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            changed = np.zeros(len(t), bool)
            for c in ("_key", *keys):
                codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changed)])
            # the last key may go on in the next batch
            if len(starts) > 1:
                yield from survivors(t.slice(0, starts[-1]), starts[:-1])
            held = t.slice(starts[-1]).to_batches()
        if held and sum(map(len, held)):
            yield from survivors(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return dealt.mapInArrow(run, chosen.schema)


def tiles(clips: DataFrame, tile: int, overlap: float) -> DataFrame:
    """(clip_id, x0, y0, x1, y1): tiles over each clip's picture, the last ones flush with its edges."""
    grid = clips.select("clip_id", "width", "height", F.explode(S.tile_origins(F.col("height"), tile, overlap)).alias("y0"))
    grid = grid.select("*", F.explode(S.tile_origins(F.col("width"), tile, overlap)).alias("x0"))
    return grid.select("clip_id", "x0", "y0", F.least(F.col("x0") + tile, "width").alias("x1"), F.least(F.col("y0") + tile, "height").alias("y1"))


def merge_tiled(tile_dets: DataFrame, whole_dets: DataFrame, iou: float = 0.55, ios: float = 0.75) -> DataFrame:
    """Tile-local detections (with x0, y0) moved to the picture, together with whole-picture ones, suppressed by class and frame."""
    moved = B.shift(B.box(), F.col("x0"), F.col("y0"))
    keys = ["clip_id", "frame", "cls"]
    local = tile_dets.select(*keys, *[v.alias(n) for v, n in zip(moved, ("x1", "y1", "x2", "y2"))], "conf")
    return suppress(local.unionByName(whole_dets.select(*keys, "x1", "y1", "x2", "y2", "conf")), keys, iou, ios)


def class_map(labels: DataFrame, spark: SparkSession) -> DataFrame:
    """(model_id, cls) of a model's labels (model_id, name): the first label by model_id for each canonical class. Fails
    without a person."""
    known = spark.createDataFrame(SYNONYMS, "cls int, spelling string")
    met = labels.join(F.broadcast(known), F.lower(F.trim("name")) == F.col("spelling"))
    first = met.groupBy("cls").agg(F.min("model_id").alias("model_id"))
    checked = first.agg(F.assert_true(F.coalesce(F.max(F.col("cls") == 0), F.lit(False)), F.lit("no label is a person")).alias("ok"))
    return first.crossJoin(checked).where("ok is null").select("model_id", "cls")


def majority_class(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each track's most frequent class; of equally frequent ones the first seen."""
    counts = obs.groupBy(*keys, "cls").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.min_by(F.struct("cls", "n"), F.struct((-F.col("n")).alias("a"), "_first", "cls"))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.cls", "b.n")


def track_inventory(obs: DataFrame, keys: list[str], static_below: float = 0.05) -> DataFrame:
    """birth, death, observed, span, gap_frames, motion (spread of the centre in mean diagonals) and static of each track."""
    b = B.box()
    scale, n = F.avg(B.diag(b)), F.count("*")
    spread = F.hypot(F.stddev_pop((b.x1 + b.x2) / 2), F.stddev_pop((b.y1 + b.y2) / 2))
    motion = F.when((n < 2) | (scale <= 0), 0.0).otherwise(F.try_divide(spread, scale))
    span = F.max("frame") - F.min("frame") + 1
    out = obs.groupBy(*keys).agg(F.min("frame").alias("birth"), F.max("frame").alias("death"), n.alias("observed"), span.alias("span"), (span - n).alias("gap_frames"), motion.alias("motion"))
    return out.withColumn("static", F.col("motion") < static_below)


def door_cue(vehicles: DataFrame, doors: DataFrame, least_share: float = 0.5) -> DataFrame:
    """cue: the highest confidence of a door box (with door_ columns) that lies in the vehicle's by least_share of itself; 0 without."""
    v, d = B.box(), B.box("door_")
    inside = F.try_divide(B.intersection(v, d), B.area(d)) >= least_share
    met = vehicles.join(doors, ["clip_id", "frame"]).where(inside)
    best = met.groupBy("clip_id", "track_id", "frame").agg(F.max("door_conf").alias("cue"))
    return vehicles.select("clip_id", "track_id", "frame").join(best, ["clip_id", "track_id", "frame"], "left").fillna(0.0, ["cue"])


def pairs(persons: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Person and vehicle observations (p_ and v_ columns) of the same clip and frame; pairs that never meet drop out."""
    return persons.join(vehicles, ["clip_id", "frame"])


def static_cameras(homographies: DataFrame, clips: DataFrame, below: float = 0.004) -> DataFrame:
    """static: whether the median shift between sampled frames is under a share of the width; clips without estimates are."""
    moved = homographies.where("ok").groupBy("clip_id").agg(F.median(F.hypot("h02", "h12")).alias("shift"))
    return clips.join(moved, "clip_id", "left").select("clip_id", F.coalesce(F.try_divide(F.col("shift"), F.col("width")) < below, F.lit(True)).alias("static"))
