"""Candidate interactions from contact spans, and their judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.functions import text as X
from kinograph.operators import series as O

# Rules, the interaction that each stands for, and the tolerance of births and deaths in seconds
RULES = ["R1_dwell", "R2_death_near", "R3_birth_near", "R4_door_change"]
RULE_TYPE = {"R1_dwell": "attend_vehicle", "R2_death_near": "enter_vehicle", "R3_birth_near": "exit_vehicle", "R4_door_change": "open_close_door"}
TOLERANCE_S = 0.35


def pair_series(persons: DataFrame, vehicles: DataFrame, clips: DataFrame, halves: list[int] | None = None, window_s: float = 0.4) -> DataFrame:
    """Dense series of each person and vehicle that meet in a frame: visible, d_norm (smoothed), iou, speed_bl_s.

    persons and vehicles: clip_id, track_id, frame, x1..y2. Frames without both are NULL; smoothing fills them up to half a
    window. halves: the half widths that occur among the clips' frame rates; they are read from clips where they aren't given.
    """
    half = F.floor(S.smooth_frames(window_s, F.col("fps")) / 2).cast("int")
    if halves is None:
        halves = [r.half for r in clips.select(half.alias("half")).where("half is not null").distinct().collect()]
    rename = lambda df, p: df.select("clip_id", F.col("track_id").alias(f"{p}id"), "frame", *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])
    met = rename(persons, "p_").join(rename(vehicles, "v_"), ["clip_id", "frame"])
    keys = ["clip_id", "p_id", "v_id"]
    met = O.previous_visible(met, keys, ["frame", "p_x1", "p_y1", "p_x2", "p_y2"])
    met = met.join(clips.select("clip_id", "fps", "n_frames"), "clip_id")
    p, v, before = B.box("p_"), B.box("v_"), B.box("prev_p_")
    dt = F.try_divide((F.col("frame") - F.col("prev_frame")).cast("double"), F.col("fps"))
    seen = met.select(*keys, "frame", F.lit(True).alias("visible"), B.d_norm(p, v).alias("d_norm"), B.iou(p, v).alias("iou"), B.speed(before, p, dt).alias("speed_bl_s"), "fps", "n_frames")
    axis = seen.groupBy(*keys).agg(F.first("fps").alias("fps"), F.first("n_frames").alias("n_frames"))
    axis = axis.select(*keys, "fps", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    dense = axis.join(seen.drop("fps", "n_frames"), [*keys, "frame"], "left").fillna(False, ["visible"])
    dense = dense.withColumn("half", half)
    return O.smooth_per_clip(dense, keys, "d_norm", "half", halves).drop("half", "fps")


def fired(spans: DataFrame, min_dwell_s: float = 0.5, door_conf: float = 0.30) -> DataFrame:
    """Spans with rules (array): those without any rule are dropped.

    spans: frame_start, frame_end, birth, death (of the person's track), fps, max_door (NULL: not measured).
    """
    tol = F.greatest(F.lit(1), S.to_frames(TOLERANCE_S, F.col("fps")))
    hits = [
        S.length_s(F.col("frame_start"), F.col("frame_end"), F.col("fps")) >= min_dwell_s,
        F.abs(F.col("death") - F.col("frame_end")) <= tol,
        F.abs(F.col("birth") - F.col("frame_start")) <= tol,
        F.col("max_door") >= door_conf,
    ]
    rules = F.array_compact(F.array(*[F.when(h, r) for h, r in zip(hits, RULES)]))
    return spans.withColumn("rules", rules).where(F.size("rules") > 0)


def candidates(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merged fired spans of each key with the sorted union of their rules and the evidence that the key's track gives.

    spans: what fired() gives, with min_d, and optionally max_iou (of the span), vehicle_is_static, born_at_frame_edge and
    died_at_frame_edge (of the key's tracks), which then are evidence too.
    """
    given = set(spans.columns)
    more = [S.rounded(F.max("max_iou"), 4).alias("max_iou")] if "max_iou" in given else []
    more += [F.bool_or(c).alias(c) for c in ("vehicle_is_static", "born_at_frame_edge", "died_at_frame_edge") if c in given]
    order = Window.partitionBy(*keys).orderBy("frame_start", "frame_end")
    reach = F.max("frame_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("_r").isNull() | (F.col("frame_start") > F.col("_r") + 1), 1).otherwise(0)
    marked = spans.withColumn("_r", reach).withColumn("_i", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fps, tol = F.max("fps"), F.greatest(F.lit(1), S.to_frames(TOLERANCE_S, F.max("fps")))
    start, end = F.min("frame_start"), F.max("frame_end")
    return marked.groupBy(*keys, "_i").agg(
        start.alias("frame_start"),
        end.alias("frame_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"),
        S.rounded(F.min("min_d"), 4).alias("min_d_norm"),
        S.rounded(S.length_s(start, end, fps), 3).alias("dwell_s"),
        (F.max("birth") <= tol).alias("birth_at_clip_start"),
        (F.max("death") >= F.max("n_frames") - 1 - tol).alias("death_at_clip_end"),
        F.max("birth").alias("person_birth"),
        F.max("death").alias("person_death"),
        *more,
    ).drop("_i")


def primary_rule(rules: Column) -> Column:
    out = F
    for r in (RULES[1], RULES[2], RULES[3]):
        out = out.when(F.array_contains(rules, r), r)
    return out.otherwise(RULES[0])


def geometric_judge(cands: DataFrame) -> DataFrame:
    """The control arm: every candidate is an interaction of its primary rule's type, with confidence 0.5."""
    rule = primary_rule(F.col("rules"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in RULE_TYPE.items() for x in kv]), rule)
    return cands.withColumns({"rule": rule, "type": kind, "confidence": F.lit(0.5)})


def numbered(accepted: DataFrame, order: list[str]) -> DataFrame:
    """interaction_id <clip>__i001 .. in each clip's order; each interaction is its own event group."""
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(*order))
    named = accepted.withColumn("interaction_id", F.format_string("%s__i%03d", F.col("clip_id").cast("string"), rank))
    return named.withColumn("event_group_id", F.col("interaction_id"))


def evidence_text(rules: Column, born_at_edge: Column, died_at_edge: Column, at_clip_start: Column) -> Column:
    """What the tracker saw of the whole clip, as lines in a fixed order; empty without any."""
    # The lines
    has = lambda r: F.array_contains(rules, r)
    lines = F.array_compact(
        F.array(
            F.when(has(RULES[2]), F.when(born_at_edge, "first seen at the edge of the picture").otherwise("first seen at the vehicle in open view")),
            F.when(has(RULES[1]), F.when(died_at_edge, "last seen at the edge of the picture").otherwise("last seen at the vehicle in open view")),
            F.when(has(RULES[3]), "a door was seen open"),
            F.when(at_clip_start, "the clip begins here"),
        )
    )
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def judged_from_cache(requests: DataFrame, cache: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """requests (key, ...) with hit, verdict and accepted from cached responses (key, raw).

    accepted is NULL where there is no response or it can't be parsed: that isn't a rejection.
    """
    latest = cache.groupBy("key").agg(F.max("raw").alias("raw"))
    met = requests.join(latest, "key", "left").withColumn("verdict", X.parse_verdict(F.col("raw")))
    accepted = (F.col("verdict.type") != X.NEGATIVE) & (F.col("verdict.confidence") >= least_confidence)
    return met.withColumns({"hit": F.col("raw").isNotNull(), "accepted": accepted})
