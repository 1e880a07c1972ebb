"""Matching of predicted and labelled spans: an overlap join within a clip, then a greedy one-to-one choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.session import Steps


def overlap_pairs(preds: DataFrame, gts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a key whose spans meet, with tiou and agree: the predicted boxes hold the labelled anchors.

    preds has a person's range px1, px2, or whole boxes px1..py2 and vx1..vy2 of person and vehicle; gts the anchors ax, or ax,
    ay, vax and vay. Anything missing agrees.
    """
    # a prediction's setting stays, where the labels don't have one
    setting = [c for c in ("pos",) if c in preds.columns and c not in keys]
    whole = [c for c in ("px1", "py1", "px2", "py2", "vx1", "vy1", "vx2", "vy2") if c in preds.columns]
    anchors = [c for c in ("ax", "ay", "vax", "vay") if c in gts.columns]
    both = len(whole) == 8 and len(anchors) == 4
    p = preds.select(*keys, *setting, "pred_id", F.col("frame_start").alias("p0"), F.col("frame_end").alias("p1"), F.col("type").alias("p_type"), *whole)
    g = gts.select(*keys, "gt_id", F.col("frame_start").alias("g0"), F.col("frame_end").alias("g1"), F.col("type").alias("g_type"), *anchors, "ambiguous")
    met = p.join(g, keys).where("p0 <= g1 and g0 <= p1")
    two = [(B.box("p"), F.col("ax"), F.col("ay")), (B.box("v"), F.col("vax"), F.col("vay"))] if both else []
    agree = B.anchors_agree(two) if both else B.anchor_agrees(F.col("px1"), F.col("px2"), F.col("ax"))
    return met.withColumn("tiou", S.temporal_iou(F.col("p0"), F.col("p1"), F.col("g0"), F.col("g1"))).withColumn("agree", agree)


def greedy_matches(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches of each key: positive labels before negative ones, agreeing actors, then higher tiou, then ids.

    candidates: keys, pred_id, gt_id, tiou, agree, negative. Agreement ranks and never rules out. A key's candidates are
    folded as one array: the overlaps within one clip. For keys of many thousands dominant_matches() is the way.
    """
    item = F.struct(F.col("negative").cast("int").alias("neg"), (-F.col("agree").cast("int")).alias("na"), (-F.col("tiou")).alias("nt"), "pred_id", "gt_id", "tiou", "agree")
    arrays = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    start = F.struct(F.slice(F.transform("_c", lambda c: c["pred_id"]), 1, 0).alias("p"), F.slice(F.transform("_c", lambda c: c["gt_id"]), 1, 0).alias("g"), F.slice("_c", 1, 0).alias("out"))

    def step(acc, c):
        taken = F.array_contains(acc["p"], c["pred_id"]) | F.array_contains(acc["g"], c["gt_id"])
        more = F.struct(F.array_append(acc["p"], c["pred_id"]).alias("p"), F.array_append(acc["g"], c["gt_id"]).alias("g"), F.array_append(acc["out"], c).alias("out"))
        return F.when(taken, acc).otherwise(more)

    folded = arrays.select(*keys, F.explode(F.aggregate("_c", start, step)["out"]).alias("m"))
    return folded.select(*keys, "m.pred_id", "m.gt_id", "m.tiou", (F.col("m.neg") == 1).alias("negative"), "m.agree")


def dominant_matches(candidates: DataFrame, keys: list[str], steps: Steps | None = None) -> DataFrame:
    """greedy_matches() in rounds, for keys of any size: no task holds all candidates of a key.

    In a round the pairs that are the first choice of both their prediction and their label are matched, and all pairs of
    either leave. The order is total, so that the first pair of what is left is always one of them, and no pair that greedy choice
    would take before it could take its place: the result is the same. A round is two partial aggregations, a join of
    their results and two anti-joins, kept in the shared folder; the number of rounds is the longest chain of pairs of which each
    waits for the one before.
    """
    steps = steps or Steps(candidates.sparkSession)
    order = F.struct(F.col("negative").cast("int").alias("neg"), (-F.col("agree").cast("int")).alias("na"), (-F.col("tiou")).alias("nt"), "pred_id", "gt_id")
    left = steps.keep(candidates.select(*keys, order.alias("o")))
    out = None
    while not left.isEmpty():
        first = lambda side: left.groupBy(*keys, F.col(f"o.{side}").alias(side)).agg(F.min("o").alias("o"))
        chosen = steps.keep(first("pred_id").select(*keys, "o").join(first("gt_id").select(*keys, "o"), [*keys, "o"]))
        out = chosen if out is None else out.unionByName(chosen)
        for side in ("pred_id", "gt_id"):
            taken = chosen.select(*keys, F.col(f"o.{side}").alias(side))
            left = left.withColumn(side, F.col(f"o.{side}")).join(taken, [*keys, side], "left_anti").drop(side)
        left = steps.keep(left)
    out = left if out is None else out
    return out.select(*keys, "o.pred_id", "o.gt_id", (-F.col("o.nt")).alias("tiou"), (F.col("o.neg") == 1).alias("negative"), (F.col("o.na") == -1).alias("agree"))


def match_events(preds: DataFrame, gts: DataFrame, keys: list[str], least_tiou: float = 0.3, same_type: bool = False) -> DataFrame:
    """greedy_matches() of all pairs with tiou of least_tiou and more; same_type asks positive labels for the same type."""
    pairs = overlap_pairs(preds, gts, keys).where(F.col("tiou") >= least_tiou).withColumn("negative", F.col("g_type") == "pass_by")
    if same_type:
        pairs = pairs.where("negative or p_type = g_type")
    return greedy_matches(pairs, keys)


def unmatched(rows: DataFrame, matches: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    return rows.join(matches.select(*keys, row_id), [*keys, row_id], "left_anti")
