"""Matching in rounds, touching labels by time, audit rules, smoothing of several widths and content keys, on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinograph.functions.text import content_key
from kinograph.operators import matching as M
from kinograph.operators import proposal as P
from kinograph.operators import series as O
from kinograph.plans import audit as A
from kinograph.plans import evaluation as E
from kinograph.sources import documents as D

CANDS = "clip_id string, pred_id int, gt_id int, tiou double, agree boolean, negative boolean"


def greedy(rows):
    taken, out = set(), []
    for c, p, g, t, a, n in sorted(rows, key=lambda r: (r[0], r[5], not r[4], -r[3], r[1], r[2])):
        if (c, "p", p) not in taken and (c, "g", g) not in taken:
            taken |= {(c, "p", p), (c, "g", g)}
            out.append((c, p, g, t, n, a))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_fold_and_greedy_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), p, g, rng.choice([0.3, 0.4, 0.5, 0.9]), rng.random() < 0.5, rng.random() < 0.3) for p in range(12) for g in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, CANDS)
    plain = lambda d: sorted((r.clip_id, r.pred_id, r.gt_id, r.tiou, r.negative, r.agree) for r in d.collect())
    assert plain(M.dominant_matches(df, ["clip_id"])) == plain(M.greedy_matches(df, ["clip_id"])) == greedy(rows)


def test_rounds_of_one_large_key_and_of_a_chain(spark):
    # each pair but the first waits for the one before it
    chain = [("c", k, k + d, 0.9 - 0.01 * (2 * k + d), True, False) for k in range(8) for d in (0, 1)]
    df = spark.createDataFrame(chain, CANDS)
    assert sorted((r.pred_id, r.gt_id) for r in M.dominant_matches(df, ["clip_id"]).collect()) == [(k, k) for k in range(8)]
    many = spark.range(40_000).selectExpr("'c' as clip_id", "cast(id % 400 as int) as pred_id", "cast(id / 100 as int) as gt_id", "0.3 + (id * 7919 % 600) / 1000 as tiou", "true as agree", "false as negative")
    got = M.dominant_matches(many, ["clip_id"])
    assert got.count() == got.select("pred_id").distinct().count() == got.select("gt_id").distinct().count() == 400
    assert M.dominant_matches(df.where("false"), ["clip_id"]).collect() == []


LABELS = "clip_id string, gt_id int, frame_start int, frame_end int, desc string, event_group_id string"


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_touching_pairs_equal_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for k in range(120):
        s = rng.randrange(200)
        rows.append((rng.choice("ab"), k, s, s + rng.choice([-2, -1, 0, 3, 10, 90]), rng.choice(["x", "x", "x", "y", None]), rng.choice(["g", "h", None])))
    want = sorted(
        (a[0], a[1], b[1], "overlap" if b[2] <= a[3] else "abut", a[5] == b[5])
        for a in rows for b in rows if a[0] == b[0] and a[4] == b[4] and a[4] is not None and (a[2], a[1]) < (b[2], b[1]) and b[2] <= a[3] + 1
    )
    assert sorted(tuple(r) for r in A.touching_pairs(spark.createDataFrame(rows, LABELS), bucket).collect()) == want


def rules(spark, **label):
    row = {"clip_id": "c", "gt_id": 1, "frame_start": 0, "frame_end": 20, "time_start_s": 0.0, "time_end_s": 2.0, "type": "pass_by", "desc": "man, dark shirt, jeans", "vehicle_desc": "white, van, parked", "person_anchor_frame": 3, "vehicle_anchor_frame": 4} | label
    schema = "clip_id string, gt_id int, frame_start int, frame_end int, time_start_s double, time_end_s double, type string, desc string, vehicle_desc string, person_anchor_frame int, vehicle_anchor_frame int"
    clips = spark.createDataFrame([("c", 10.0, 100)], "clip_id string, fps double, n_frames int")
    return {r.rule for r in A.findings(spark.createDataFrame([tuple(row.values())], schema), clips).collect()}


def test_what_a_label_breaks(spark):
    assert rules(spark) == set()
    # of an unknown clip nothing else is known
    assert rules(spark, clip_id="z", frame_start=9, frame_end=2, vehicle_desc="", person_anchor_frame=None) == {"unknown_clip", "no_labels"}
    assert rules(spark, desc="") == {"empty_desc"} and rules(spark, desc=None, vehicle_desc="van") == {"empty_desc", "few_vehicle_parts"}
    assert rules(spark, desc="man") == {"few_parts"}
    # the length is that of the times
    assert rules(spark, time_start_s=1.6) == {"time_start_s", "short"}
    assert rules(spark, frame_start=120, frame_end=130, time_start_s=12.0, time_end_s=13.0, person_anchor_frame=120, vehicle_anchor_frame=131) == {"span_range", "vehicle_anchor_frame_outside"}


def test_clips_of_any_frame_rate_are_smoothed(spark):
    clips = spark.createDataFrame([("a", 25.0, 40), ("b", 60.0, 40), ("c", 6.0, 40)], "clip_id string, fps double, n_frames int")
    rows = spark.range(40).selectExpr("explode(array('a', 'b', 'c')) as clip_id", "1 as track_id", "cast(id as int) as frame", "0.0 as x1", "0.0 as y1", "10.0 as x2", "20.0 as y2")
    moved = rows.withColumn("x1", F.col("frame") * 3.0).withColumn("x2", F.col("x1") + 10)
    got = P.pair_series(rows, moved, clips)
    assert {r.clip_id: r.n for r in got.where("d_norm is not null").groupBy("clip_id").agg(F.count("*").alias("n")).collect()} == {"a": 40, "b": 40, "c": 40}
    wide = {r.clip_id: r.d_norm for r in got.where("frame = 3").collect()}
    assert len(set(wide.values())) == 3
    with pytest.raises(Exception, match="isn't listed"):
        O.smooth_per_clip(rows.withColumn("h", F.lit(4)), ["clip_id"], "x1", "h", [1, 2]).collect()


def test_keys_of_different_parts_differ(spark):
    parts = [("a|b", ""), ("a", "b|"), ("a", "|b"), ("", None), (None, ""), (None, None), ("-", ""), ("1:a", "b"), ("1", "a1:b")]
    df = spark.createDataFrame(parts, "x string, y string").select(content_key(F.col("x"), F.col("y")).alias("k"))
    assert df.distinct().count() == len(parts)


def test_the_whole_report_of_clips_and_of_all(spark, tmp_path):
    span = "frame_start int, frame_end int, type string"
    preds = spark.createDataFrame([("a", 1, 0, 9, "enter_vehicle", 0.0, 1.0), ("a", 2, 50, 59, "exit_vehicle", 0.0, 1.0), ("b", 1, 0, 9, "enter_vehicle", 0.0, 1.0), ("c", 1, 0, 5, "load_unload", 0.0, 1.0)], f"clip_id string, pred_id long, {span}, px1 double, px2 double")
    gts = spark.createDataFrame([("a", 1, 0, 9, "exit_vehicle", None, False), ("a", 2, 50, 59, "pass_by", None, True), ("b", 1, 5, 14, "enter_vehicle", None, True), ("d", 1, 0, 5, "attend_vehicle", None, False)], f"clip_id string, gt_id long, {span}, ax double, ambiguous boolean")
    report = E.full_report(preds, gts)
    got = {(r.scope, r.least_tiou, r.confident): r for r in report.collect()}
    # d has no predictions and c no labels: both count; b's only label is ambiguous
    assert set(k[0] for k in got) == {"a", "b", "c", "d", "POOLED"} and len(got) == 20
    whole = got["POOLED", 0.3, False]
    assert (whole.n_clips, whole.n_positives, whole.n_predictions) == (4, 3, 4) and tuple(whole.detection)[:3] == (2, 2, 1)
    assert tuple(whole.negatives)[:3] == (1, 1, 1.0) and [tuple(x) for x in whole.negatives.ids] == [("a", 2)]
    assert [tuple(x) for x in whole.confusion] == [("enter_vehicle", "enter_vehicle", 1), ("exit_vehicle", "enter_vehicle", 1)]
    assert tuple(whole.per_type.enter_vehicle)[:3] == (1, 1, 0) and whole.rare.attend_vehicle == 1 and whole.localization.tiou == round((1 + 1 / 3) / 2, 4)
    clear = got["POOLED", 0.3, True]
    assert tuple(clear.detection)[:3] == (1, 3, 1) and clear.negatives.n == 0 and got["POOLED", 0.5, False].detection.tp == 1
    D.write_documents(E.report_documents(report), str(tmp_path))
    told = json.loads((tmp_path / "metrics" / "POOLED.json").read_text())
    assert [(v["least_tiou"], v["confident"], v["detection"]["tp"]) for v in told["variants"]] == [(0.3, False, 2), (0.3, True, 1), (0.5, False, 1), (0.5, True, 1)]
    assert sorted(x.name for x in (tmp_path / "metrics").iterdir() if not x.name.startswith(".")) == ["POOLED.json", "a.json", "b.json", "c.json", "d.json"]
