"""Data-quality rules on labelled spans, and pooling of per-clip records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions import spans as S

# Fixed value: how far a label's time may be from its frame's
TIME_TOLERANCE_S = 0.011
# Fixed value: the comma parts that a description should have
LEAST_PARTS = 3


def findings(gts: DataFrame, clips: DataFrame, least_s: float = 0.5) -> DataFrame:
    """(severity, rule, key): one row for each broken rule. gts: clip_id, gt_id, frame_start, frame_end, type, desc, and
    optionally time_start_s and time_end_s (which then give the length), vehicle_desc, person_anchor_frame and
    vehicle_anchor_frame, whose rules then apply. Of a label of an unknown clip only that is said, and whether it repeats an id
    or touches another; an empty description has no parts that could be too few.

    Labels are dealt by clip once: the clip's properties, repeated ids and the spans before are all found there, and each row
    carries the list of the rules that it breaks.
    """
    has = set(gts.columns).__contains__
    known = gts.repartition("clip_id").join(clips.select("clip_id", "fps", "n_frames"), "clip_id", "left")
    same_id = Window.partitionBy("clip_id", "gt_id")
    # a span of the same clip and description that began before and ends later, or one frame before, overlaps or touches
    order = Window.partitionBy("clip_id", "desc").orderBy("frame_start", "frame_end", "gt_id")
    known = known.withColumns(
        {
            "_n": F.count("*").over(same_id),
            "_first": F.row_number().over(same_id.orderBy("frame_start", "frame_end", "desc")) == 1,
            "_r": F.max("frame_end").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    frames = F.try_divide((F.col("frame_end") - F.col("frame_start") + 1).cast("double"), F.col("fps"))
    length = F.col("time_end_s") - F.col("time_start_s") if has("time_start_s") and has("time_end_s") else frames
    inside = lambda c: F.col(c).between(0, F.col("n_frames") - 1)
    # what a label breaks by itself, where its clip is known
    rules = [
        ("error", "span_order", F.col("frame_end") < F.col("frame_start")),
        ("error", "span_range", ~(inside("frame_start") & inside("frame_end"))),
        ("warning", "short", length < least_s),
    ]
    for frame, time in (("frame_start", "time_start_s"), ("frame_end", "time_end_s")):
        if has(time):
            rules.append(("error", time, F.abs(F.col(time) - S.to_seconds(F.col(frame), F.col("fps"))) > TIME_TOLERANCE_S))
    for c, few in (("desc", "few_parts"), ("vehicle_desc", "few_vehicle_parts")):
        if has(c):
            empty = F.coalesce(F.col(c), F.lit("")) == ""
            rules += [("error", f"empty_{c}", empty), ("warning", few, ~empty & (F.size(F.split(c, ",")) < LEAST_PARTS))]
    for c in ("person_anchor_frame", "vehicle_anchor_frame"):
        if has(c):
            rules += [("warning", f"no_{c}", F.col(c).isNull()), ("warning", f"{c}_outside", ~F.col(c).between(F.col("frame_start"), F.col("frame_end")))]
    known_clip = F.col("fps").isNotNull()
    rules = [(severity, rule, known_clip & hit) for severity, rule, hit in rules] + [
        ("error", "unknown_clip", ~known_clip),
        ("error", "duplicate_id", (F.col("_n") > 1) & F.col("_first")),
        ("warning", "overlap", F.col("frame_start") <= F.col("_r")),
        ("warning", "abuts", F.col("frame_start") == F.col("_r") + 1),
    ]
    broken = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for severity, rule, hit in rules]))
    key = F.concat_ws("/", F.col("clip_id").cast("string"), F.col("gt_id").cast("string"))
    out = known.select(key.alias("key"), F.explode(broken).alias("b")).select("b.severity", "b.rule", "key")
    unlabelled = clips.join(gts.select("clip_id").distinct(), "clip_id", "left_anti")
    return out.unionByName(unlabelled.select(F.lit("info").alias("severity"), F.lit("no_labels").alias("rule"), F.col("clip_id").cast("string").alias("key")))


def touching_pairs(gts: DataFrame, bucket: int = 64) -> DataFrame:
    """(clip_id, first_id, second_id, kind, grouped): the pairs of labels of one clip and description of which the second
    begins before the first has ended (overlap) or right after (abut). gts: clip_id, gt_id, frame_start, frame_end, desc,
    event_group_id.

    A label stands in all buckets of `bucket` frames from its start to one frame after its end, and meets those that begin in
    one of them: each pair meets once, and a description that all labels share is dealt over the clip's buckets.
    """
    side = lambda p: gts.select("clip_id", "desc", *[F.col(c).alias(f"{p}_{c}") for c in ("gt_id", "frame_start", "frame_end", "event_group_id")])
    of = lambda frame: F.floor(frame / bucket)
    reach = F.greatest(F.col("a_frame_start"), F.col("a_frame_end") + 1)
    a = side("a").withColumn("_b", F.explode(F.sequence(of(F.col("a_frame_start")), of(reach))))
    met = a.join(side("b").withColumn("_b", of(F.col("b_frame_start"))), ["clip_id", "desc", "_b"])
    met = met.where(F.struct("a_frame_start", "a_gt_id") < F.struct(F.col("b_frame_start"), F.col("b_gt_id"))).where("b_frame_start <= a_frame_end + 1")
    kind = F.when(F.col("b_frame_start") <= F.col("a_frame_end"), "overlap").otherwise("abut")
    return met.select("clip_id", F.col("a_gt_id").alias("first_id"), F.col("b_gt_id").alias("second_id"), kind.alias("kind"), F.col("a_event_group_id").eqNullSafe(F.col("b_event_group_id")).alias("grouped"))


def label_summary(gts: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: events, clips with labels and in all, positives, negatives, ambiguous ones, and groups of several events with
    the events in them. gts: clip_id, type, ambiguous, event_group_id."""
    groups = gts.where("event_group_id is not null").groupBy("event_group_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped_events"))
    negative = F.col("type") == "pass_by"
    counts = gts.agg(F.count("*").alias("events"), F.countDistinct("clip_id").alias("labelled_clips"), F.count_if(~negative).alias("positives"), F.count_if(negative).alias("negatives"), F.count_if("ambiguous").alias("ambiguous"))
    # single rows of counts beside each other
    return counts.join(F.broadcast(groups)).join(F.broadcast(clips.agg(F.count("*").alias("clips"))))


def pooled(records: DataFrame, inventory: DataFrame, allow_partial: bool = False) -> DataFrame:
    """All clips' records in one order. Fails where an inventory clip has no records (unless allow_partial) or where the
    records come from more than one configuration. records: clip_id, config_hash, frame_start, interaction_id, ..."""
    seen = records.select("clip_id", "config_hash").distinct()
    both = inventory.select("clip_id").distinct().join(seen, "clip_id", "left")
    # one small aggregate over clips, not over records
    checks = both.agg(F.count_if(F.col("config_hash").isNull()).alias("missing")).crossJoin(seen.agg(F.countDistinct("config_hash").alias("hashes")))
    checks = checks.withColumn("_ok", F.assert_true(F.col("hashes") <= 1, F.lit("records of several configurations")))
    if not allow_partial:
        checks = checks.withColumn("_ok2", F.assert_true(F.col("missing") == 0, F.lit("clips without records")))
    flags = [c for c in checks.columns if c.startswith("_ok")]
    good = checks.where(" and ".join(f"{c} is null" for c in flags)).select(F.lit(1).alias("_1"))
    return records.crossJoin(F.broadcast(good)).drop("_1").orderBy("clip_id", "frame_start", "interaction_id")
