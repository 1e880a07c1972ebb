"""Evaluation reports: counts are taken within clips and added up; every rate carries its counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.functions import spans as S
from kinograph.functions.text import TYPES
from kinograph.operators import matching as M
from kinograph.session import Steps


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    return S.rounded(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), places)


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 of tp, fp, fn; 0 where a denominator is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def detection_counts(preds: DataFrame, gts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of each key. A prediction on a negative label is a false positive; an unmatched negative costs nothing."""
    p = preds.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    g = gts.groupBy(*keys).agg(F.count_if(F.col("type") != "pass_by").alias("n_pos"))
    m = matches.groupBy(*keys).agg(F.count_if(~F.col("negative")).alias("tp"))
    joined = p.join(g, keys, "full").join(m, keys, "left").fillna(0, ["n_pred", "n_pos", "tp"])
    return joined.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_pos") - F.col("tp")).alias("fn"))


def totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def variants(preds: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """P/R/F1 for each threshold, with all labels and with those that aren't ambiguous; predictions are never dropped.

    One overlap join serves all variants: the threshold and the choice of labels are keys of the matching.
    """
    spark = preds.sparkSession
    chosen = spark.createDataFrame([(t, c) for t in thresholds for c in (False, True)], "least_tiou double, confident boolean")
    keys = ["clip_id", "least_tiou", "confident"]
    pairs = M.overlap_pairs(preds, gts, ["clip_id"]).withColumn("negative", F.col("g_type") == "pass_by")
    pairs = pairs.join(F.broadcast(chosen), (F.col("tiou") >= F.col("least_tiou")) & (~F.col("confident") | ~F.col("ambiguous")))
    matches = M.greedy_matches(pairs, keys)
    p = preds.join(F.broadcast(chosen))
    g = gts.join(F.broadcast(chosen), ~F.col("confident") | ~F.col("ambiguous"))
    return with_prf(totals(detection_counts(p, g, matches, keys), ["least_tiou", "confident"]))


def pass_by_report(gts: DataFrame, matches: DataFrame) -> DataFrame:
    negatives = gts.where("type = 'pass_by'").join(matches.where("negative").select("clip_id", "gt_id", F.lit(1).alias("hit")), ["clip_id", "gt_id"], "left")
    out = negatives.agg(F.count("*").alias("n_negatives"), F.count("hit").alias("n_hit"))
    return out.withColumn("rate", rate(F.col("n_hit"), F.col("n_negatives")))


def matched_types(preds: DataFrame, gts: DataFrame, matches: DataFrame) -> DataFrame:
    p = preds.select("clip_id", "pred_id", F.col("type").alias("p_type"), F.col("frame_start").alias("p0"), F.col("frame_end").alias("p1"))
    g = gts.select("clip_id", "gt_id", F.col("type").alias("g_type"), F.col("frame_start").alias("g0"), F.col("frame_end").alias("g1"))
    return matches.where("not negative").join(p, ["clip_id", "pred_id"]).join(g, ["clip_id", "gt_id"])


def type_confusion(typed: DataFrame) -> DataFrame:
    """All 5 x 5 cells (g_type, p_type, n), zeros included."""
    spark = typed.sparkSession
    dense = spark.createDataFrame([(a, b) for a in TYPES for b in TYPES], "g_type string, p_type string")
    counts = typed.groupBy("g_type", "p_type").agg(F.count("*").alias("n"))
    return dense.join(counts, ["g_type", "p_type"], "left").fillna(0, ["n"])


def per_type(preds: DataFrame, gts: DataFrame, typed: DataFrame) -> DataFrame:
    """P/R/F1 of each type; a true positive has both types equal, all other predictions of a type are false positives."""
    spark = preds.sparkSession
    types = spark.createDataFrame([(t,) for t in TYPES], "type string")
    n_p, n_g = preds.groupBy("type").agg(F.count("*").alias("n_pred")), gts.groupBy("type").agg(F.count("*").alias("n_gt"))
    hit = typed.where("p_type = g_type").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("tp"))
    all_of = types.join(n_p, "type", "left").join(n_g, "type", "left").join(hit, "type", "left").fillna(0, ["n_pred", "n_gt", "tp"])
    return with_prf(all_of.select("type", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn")))


def localization(typed: DataFrame) -> DataFrame:
    """Medians of the boundary errors (predicted - labelled frame), absolute and signed, and of nothing else."""
    s, e = F.col("p0") - F.col("g0"), F.col("p1") - F.col("g1")
    return typed.agg(F.count("*").alias("n"), F.median(F.abs(s)).alias("abs_start"), F.median(F.abs(e)).alias("abs_end"), F.median(s).alias("signed_start"), F.median(e).alias("signed_end"))


# Types with enough labels for rates, and those of which only counts are told
RATED, COUNTED = ["enter_vehicle", "exit_vehicle"], ["attend_vehicle", "open_close_door", "load_unload"]
POOLED = "POOLED"


def full_report(preds: DataFrame, gts: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """One row for each clip and variant (threshold, with or without ambiguous labels), and one for all clips together (scope POOLED).

    (scope, least_tiou, confident, n_clips, n_positives, n_predictions, detection, negatives, per_type, rare, confusion,
    localization): detection and per_type have tp, fp, fn, precision, recall and f1; negatives how many there are, how many
    were fired on, their rate and ids; rare only counts; confusion the matched pairs by labelled and predicted type;
    localization the medians of boundary errors and overlap. Matching is within clips, whatever the scope. The rows of a scope
    are sums, so that pooled ones need no second matching.
    """
    spark = preds.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(t, c) for t in thresholds for c in (False, True)], "least_tiou double, confident boolean"))
    variant, keys = ["least_tiou", "confident"], ["clip_id", "least_tiou", "confident"]
    clear = ~F.col("confident") | ~F.col("ambiguous")
    pairs = M.overlap_pairs(preds, gts, ["clip_id"]).withColumn("negative", F.col("g_type") == "pass_by")
    matches = M.greedy_matches(pairs.join(chosen, (F.col("tiou") >= F.col("least_tiou")) & clear), keys)
    p, g = preds.select("clip_id", "pred_id", "type", "frame_start", "frame_end"), gts.select("clip_id", "gt_id", "type", "frame_start", "frame_end", "ambiguous")
    met = matches.join(p.selectExpr("clip_id", "pred_id", "type as p_type", "frame_start as p0", "frame_end as p1"), ["clip_id", "pred_id"])
    met = met.join(g.selectExpr("clip_id", "gt_id", "type as g_type", "frame_start as g0", "frame_end as g1"), ["clip_id", "gt_id"])

    def scoped(rows: DataFrame, *more: str) -> tuple:
        """The rows by clip and variant and by variant alone, and the scope's name."""
        sets = [[*keys, *more], [*variant, *more]]
        return rows.groupingSets(sets, *keys, *more), F.when(F.grouping("clip_id") == 1, POOLED).otherwise(F.col("clip_id").cast("string")).alias("scope")

    of = lambda c, t: F.count_if(F.col(c) == t)
    grouped, scope = scoped(p.join(chosen))
    made = grouped.agg(scope, F.count("*").alias("n_predictions"), *[of("type", t).alias(f"p_{t}") for t in RATED]).drop("clip_id")
    grouped, scope = scoped(g.join(chosen, clear))
    asked = grouped.agg(scope, F.count_if(F.col("type") != "pass_by").alias("n_positives"), of("type", "pass_by").alias("n_negatives"), *[of("type", t).alias(f"g_{t}") for t in [*RATED, *COUNTED]]).drop("clip_id")
    good = ~F.col("negative")
    middle = lambda v: F.median(F.when(good, v))
    start, end = F.col("p0") - F.col("g0"), F.col("p1") - F.col("g1")
    # the clip again, under a name that grouping doesn't blank
    grouped, scope = scoped(met.withColumn("of_clip", F.col("clip_id").cast("string")))
    ids = F.array_sort(F.collect_list(F.when(F.col("negative"), F.struct("of_clip", "gt_id"))))
    hit = grouped.agg(
        scope, F.count_if(good).alias("tp"), F.count_if("negative").alias("n_fired"), ids.alias("fired_ids"), *[F.count_if(good & (F.col("g_type") == t) & (F.col("p_type") == t)).alias(f"tp_{t}") for t in RATED],
        middle(F.abs(start)).alias("abs_start"), middle(F.abs(end)).alias("abs_end"), middle(start).alias("signed_start"), middle(end).alias("signed_end"), S.rounded(middle(F.col("tiou")), 4).alias("tiou"),
    ).drop("clip_id")
    grouped, scope = scoped(met.where(good), "g_type", "p_type")
    cells = grouped.agg(scope, F.count("*").alias("n")).drop("clip_id")
    confusion = cells.groupBy("scope", *variant).agg(F.array_sort(F.collect_list(F.struct("g_type", "p_type", "n"))).alias("confusion"))

    by = ["scope", *variant]
    every = made.join(asked, by, "full").join(hit, by, "left").join(confusion, by, "left")
    every = every.fillna(0, [c for c, k in every.dtypes if k == "bigint"])
    n_clips = preds.select("clip_id").union(gts.select("clip_id")).agg(F.countDistinct("clip_id").alias("_clips"))
    every = every.join(F.broadcast(n_clips))

    def prf(tp: Column, made: Column, asked: Column) -> Column:
        fp, fn = made - tp, asked - tp
        return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))

    c = F.col
    return every.select(
        *by, F.when(c("scope") == POOLED, c("_clips")).otherwise(1).alias("n_clips"), "n_positives", "n_predictions",
        prf(c("tp"), c("n_predictions"), c("n_positives")).alias("detection"),
        F.struct(c("n_negatives").alias("n"), c("n_fired").alias("fired"), rate(c("n_fired"), c("n_negatives")).alias("rate"), F.coalesce("fired_ids", F.array().cast("array<struct<of_clip: string, gt_id: bigint>>")).alias("ids")).alias("negatives"),
        F.struct(*[prf(c(f"tp_{t}"), c(f"p_{t}"), c(f"g_{t}")).alias(t) for t in RATED]).alias("per_type"),
        F.struct(*[c(f"g_{t}").alias(t) for t in COUNTED]).alias("rare"),
        F.coalesce("confusion", F.array().cast("array<struct<g_type: string, p_type: string, n: bigint>>")).alias("confusion"),
        F.struct(c("tp").alias("n"), "abs_start", "abs_end", "signed_start", "signed_end", "tiou").alias("localization"),
    )


def report_documents(report: DataFrame) -> DataFrame:
    """(name, value): the reports of each scope as one JSON document, metrics/<scope>.json."""
    fields = F.struct(*[c for c in report.columns if c != "scope"])
    listed = report.groupBy("scope").agg(F.array_sort(F.collect_list(fields)).alias("variants"))
    return listed.select(F.concat(F.lit("metrics/"), "scope", F.lit(".json")).alias("name"), F.to_json(F.struct("scope", "variants")).alias("value"))


def leave_one_out(counts: DataFrame) -> DataFrame:
    """For each clip (fold) the setting with the best F1 over all other clips (ties: the first position), and its counts on
    that clip. counts: clip_id, pos, tp, fp, fn for every clip and setting.

    The other clips' counts are the setting's totals without the clip's own, so that no fold joins all others, and no task holds
    all clips of a setting.
    """
    whole = counts.groupBy("pos").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    rest = counts.join(F.broadcast(whole), "pos").withColumns({f"o_{c}": F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")})
    f1 = F.coalesce(F.try_divide(2.0 * F.col("o_tp"), 2.0 * F.col("o_tp") + F.col("o_fp") + F.col("o_fn")), F.lit(0.0))
    best = F.min_by(F.struct("pos", "tp", "fp", "fn", "fit_f1"), F.struct((-F.col("fit_f1")).alias("k"), "pos"))
    return rest.withColumn("fit_f1", f1).groupBy(F.col("clip_id").alias("fold")).agg(best.alias("b")).select("fold", "b.*")


def setting_counts(preds: DataFrame, gts: DataFrame, clips: DataFrame, grid: DataFrame, least_tiou: float = 0.3, steps: Steps | None = None) -> DataFrame:
    """(pos, clip_id, tp, fp, fn) of every clip (clip_id) and setting of the grid (pos). preds: with pos, as for overlap_pairs().

    Labels meet the predictions of every setting; only their counts are multiplied by the settings. Predictions and counts are
    kept in the shared folder, since both are read more than once.
    """
    steps = steps or Steps(preds.sparkSession)
    preds = steps.keep(preds)
    pairs = M.overlap_pairs(preds, gts, ["clip_id"]).where(F.col("tiou") >= least_tiou).withColumn("negative", F.col("g_type") == "pass_by")
    hits = M.greedy_matches(pairs, ["pos", "clip_id"]).groupBy("pos", "clip_id").agg(F.count_if(~F.col("negative")).alias("tp"))
    made = preds.groupBy("pos", "clip_id").agg(F.count("*").alias("n_pred"))
    asked = gts.groupBy("clip_id").agg(F.count_if(F.col("type") != "pass_by").alias("n_pos"))
    every = clips.select("clip_id").distinct().join(asked, "clip_id", "left").join(F.broadcast(grid.select("pos")))
    all_of = every.join(made, ["pos", "clip_id"], "left").join(hits, ["pos", "clip_id"], "left").fillna(0, ["n_pred", "n_pos", "tp"])
    return steps.keep(all_of.select("pos", "clip_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_pos") - F.col("tp")).alias("fn")))


def loco_summary(counts: DataFrame) -> DataFrame:
    """Held-out and all-data P/R/F1 with the gap between the two F1."""
    held = with_prf(leave_one_out(counts).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).select(*[F.col(c).alias(f"held_{c}") for c in ("tp", "fp", "fn", "f1")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    every = totals(counts, ["pos"]).withColumn("k", f1)
    best = every.agg(F.min_by(F.struct("pos", "tp", "fp", "fn"), F.struct((-F.col("k")).alias("k"), "pos")).alias("b")).select("b.*")
    chosen = with_prf(best).select(F.col("pos").alias("all_pos"), *[F.col(c).alias(f"all_{c}") for c in ("tp", "fp", "fn", "f1")])
    return held.crossJoin(chosen).withColumn("gap", S.rounded(F.col("all_f1") - F.col("held_f1"), 4))


def fold_agreement(folds: DataFrame, settings: DataFrame, knobs: list[str]) -> DataFrame:
    """For each knob how many values the folds chose and the most frequent one (ties: the first fold's)."""
    chosen = folds.join(settings, "pos")
    long = None
    for k in knobs:
        part = chosen.select(F.lit(k).alias("knob"), F.col("fold"), F.col(k).alias("value"))
        long = part if long is None else long.union(part)
    counts = long.groupBy("knob", "value").agg(F.count("*").alias("n"), F.min("fold").alias("first"))
    return counts.groupBy("knob").agg(F.count("*").alias("n_values"), F.min_by("value", F.struct((-F.col("n")).alias("k"), "first")).alias("modal"), F.max("n").alias("n_modal"))


def slot_rollup(outcomes: DataFrame) -> DataFrame:
    """correct, wrong, abstain, accuracy and coverage for each slot (side.name...) and for each side (slot NULL)."""
    sided = outcomes.withColumn("side", F.split_part("slot", F.lit("."), F.lit(1)))
    counted = sided.groupingSets([["side", "slot"], ["side"]], "side", "slot").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "abstain")])
    answered = F.col("correct") + F.col("wrong")
    return counted.withColumns({"accuracy": S.rounded(F.try_divide(F.col("correct").cast("double"), answered.cast("double")), 4), "coverage": S.rounded(F.try_divide(answered.cast("double"), (answered + F.col("abstain")).cast("double")), 4)})


class Setting(NamedTuple):
    pos: int
    det_conf: float
    tau_near: float
    tau_far: float


def grid_rows() -> list[Setting]:
    """All settings whose tau_far is above tau_near, in grid order."""
    # The grid
    conf, near, far = (0.35, 0.50, 0.65), (0.06, 0.10, 0.15, 0.22), (0.18, 0.25, 0.32, 0.45)
    return [Setting(k, *r) for k, r in enumerate((c, n, f) for c in conf for n in near for f in far if f > n)]


def settings_grid(spark) -> DataFrame:
    """(pos, det_conf, tau_near, tau_far) of grid_rows()."""
    return spark.createDataFrame([tuple(r) for r in grid_rows()], "pos int, det_conf double, tau_near double, tau_far double")
