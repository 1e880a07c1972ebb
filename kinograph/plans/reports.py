"""Evidence boxes, request bundles, comparisons of judges and frame summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.plans.evaluation import with_prf

#: Pictures of this width and more are tiled.
TILED_FROM = 1920


def should_tile(width: Column, asked: Column | None = None) -> Column:
    """An explicit request wins, else wide pictures are tiled."""
    wide = width >= TILED_FROM
    return wide if asked is None else F.coalesce(asked, wide)


def span_boxes(spans: DataFrame, obs: DataFrame, clips: DataFrame) -> DataFrame:
    """spans (clip_id, track_id, frame_start, frame_end) with the union of the track's boxes in each, as shares of the
    picture rounded to five places; NULL where the track has none."""
    keys = ["clip_id", "track_id", "frame_start", "frame_end"]
    inside = spans.select(*keys).distinct().join(obs, ["clip_id", "track_id"]).where("frame between frame_start and frame_end")
    union = inside.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    sized = union.join(clips.select("clip_id", "width", "height"), "clip_id")
    share = lambda c, side: S.rounded(F.try_divide(F.col(c), F.col(side)), 5).alias(c)
    return spans.join(sized.select(*keys, share("x1", "width"), share("y1", "height"), share("x2", "width"), share("y2", "height")), keys, "left")


def bundles(cands: DataFrame, boxes: DataFrame, clips: DataFrame, pad_s: float = 1.0, n: int = 12) -> DataFrame:
    """One row a candidate: the sampled frames of its padded span and the quantised box of its track in each (NULL without).

    cands: clip_id, track_id, frame_start, frame_end; boxes: clip_id, track_id, frame, x1..y2. The sample bounds the lists.
    """
    keys = ["clip_id", "track_id", "frame_start", "frame_end"]
    met = cands.select(*keys).join(clips.select("clip_id", "fps", "n_frames"), "clip_id")
    lo, hi = S.pad(F.col("frame_start"), F.col("frame_end"), S.to_frames(pad_s, F.col("fps")), F.col("n_frames"))
    frames = met.select(*keys, F.explode(S.sample(lo.cast("int"), hi.cast("int"), n)).alias("frame"))
    q = B.quantize(B.box())
    small = boxes.select("clip_id", "track_id", "frame", F.when(F.col("x1").isNotNull(), F.array(*q)).alias("box"))
    joined = frames.join(small, ["clip_id", "track_id", "frame"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("frame", "box")))
    return joined.groupBy(*keys).agg(ordered.alias("l")).select(*keys, F.transform("l", lambda x: x["frame"]).alias("frames"), F.transform("l", lambda x: x["box"]).alias("boxes"))


def comparison(counts: DataFrame) -> DataFrame:
    """P/R/F1 of each judge and clip, with a POOLED row for each judge. counts: judge, clip_id, tp, fp, fn."""
    both = counts.groupingSets([["judge", "clip_id"], ["judge"]], "judge", "clip_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping("clip_id").alias("pooled"))
    return with_prf(both.withColumn("clip", F.when(F.col("pooled") == 1, "POOLED").otherwise(F.col("clip_id").cast("string"))).drop("pooled", "clip_id"))


def frame_summary(dets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of persons and others, the highest confidence, the median height and the sorted classes of each key."""
    person = F.col("cls") == 0
    return dets.groupBy(*keys).agg(
        F.count_if(person).alias("persons"),
        F.count_if(~person).alias("others"),
        F.max("conf").alias("max_conf"),
        F.median(B.height(B.box())).alias("median_height"),
        F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"),
    )


def attached(rows: DataFrame) -> DataFrame:
    """person_desc and vehicle_desc from parsed slots where there are any (column slots), else as they were."""
    from kinograph.functions.text import render_person, render_vehicle

    known = F.col("slots").isNotNull()
    return rows.withColumns(
        {
            "person_desc": F.when(known, render_person(F.col("slots.person"))).otherwise(F.col("person_desc")),
            "vehicle_desc": F.when(known, render_vehicle(F.col("slots.vehicle"))).otherwise(F.col("vehicle_desc")),
        }
    )


def description_report(pairs: DataFrame) -> DataFrame:
    """How many matched pairs have another actor, lack slots, or are scored. pairs: agree, has_slots."""
    return pairs.agg(
        F.count_if(~F.col("agree")).alias("other_actor"),
        F.count_if(F.col("agree") & ~F.col("has_slots")).alias("no_slots"),
        F.count_if(F.col("agree") & F.col("has_slots")).alias("scored"),
    )
