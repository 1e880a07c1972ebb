"""Small cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.functions import text as T
from kinograph.operators import detections as D
from kinograph.operators import matching as M
from kinograph.operators import proposal as P
from kinograph.operators import series as O
from kinograph.plans import audit as A
from kinograph.plans import evaluation as E


def lit_box(*v):
    return B.Box(*[F.lit(None).cast("double") if x is None else F.lit(float(x)) for x in v])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "expression,expected",
    [
        (lambda: B.gap(lit_box(0, 0, 10, 10), lit_box(13, 14, 20, 20)), 5.0),
        (lambda: B.gap(lit_box(0, 0, 10, 10), lit_box(10, 0, 20, 10)), 0.0),
        (lambda: B.gap(lit_box(0, 0, 10, 10), lit_box(14, 0, 20, 10)), 4.0),
        (lambda: B.gap(lit_box(None, 0, 10, 10), lit_box(14, 0, 20, 10)), None),
        (lambda: B.d_norm(lit_box(40, 0, 50, 20), lit_box(0, 0, 30, 40)), 0.2),
        (lambda: B.d_norm(lit_box(40, 0, 50, 20), lit_box(5, 5, 5, 5)), math.inf),
        (lambda: B.iou(lit_box(0, 0, 10, 10), lit_box(5, 0, 15, 10)), 50 / 150),
        (lambda: B.iou(lit_box(0, 0, 1, 1), lit_box(5, 5, 6, 6)), 0.0),
        (lambda: B.speed(lit_box(0, 0, 10, 20), lit_box(20, 0, 30, 20), F.lit(1.0)), 1.0),
        (lambda: B.speed(lit_box(0, 0, 10, 20), lit_box(20, 0, 30, 20), F.lit(0.0)), 0.0),
        (lambda: B.dilate(lit_box(0, 0, 10, 10), 1.0, (F.lit(15), F.lit(15))).x2, 15.0),
        (lambda: B.width(lit_box(5, 0, 1, 0)), 0.0),
        (lambda: S.temporal_iou(*map(F.lit, (0, 10, 11, 20))), 0.0),
        (lambda: S.temporal_iou(*map(F.lit, (0, 10, 10, 20))), 1 / 21),
        (lambda: S.temporal_iou(*map(F.lit, (0, 39, 10, 19))), 0.25),
        (lambda: S.sample(F.lit(10), F.lit(12), 12), [10, 11, 12]),
        (lambda: S.sample(F.lit(10), F.lit(20), 1), [15]),
        (lambda: S.sample(F.lit(0), F.lit(100), 5), [0, 25, 50, 75, 100]),
        (lambda: S.sample(F.lit(0), F.lit(9), 0), []),
        (lambda: S.to_frames(0.4, F.lit(6.667)), 3),
        (lambda: S.smooth_frames(0.4, F.lit(6.0)), 3),
        (lambda: S.tile_origins(4000, 704, 0.25), [0, 528, 1056, 1584, 2112, 2640, 3168, 3296]),
        (lambda: S.tile_origins(2000, 500, 0.0), [0, 500, 1000, 1500]),
        (lambda: S.tile_origins(352, 704, 0.25), [0]),
        (lambda: T.compare_colour(F.array(F.lit("dark")), F.lit("black"))[0], None),
        (lambda: T.compare_colour(F.array(F.lit("dark")), F.lit("black"))[1], "correct"),
        (lambda: T.compare_colour(F.array(F.lit("grey")), F.lit("silver"))[0], "correct"),
        (lambda: T.compare_colour(F.array(F.lit("black")), F.lit("dark"))[0], "abstain"),
        (lambda: T.compare_colour(F.array(F.lit("black")), F.lit("unknown"))[1], "abstain"),
        (lambda: T.parse_verdict(F.lit('```json\n{"type": "enter_vehicle", "confidence": 7}\n```'))["confidence"], 1.0),
        (lambda: T.parse_verdict(F.lit('Sure: {"type": "pass_by"} ok'))["type"], "pass_by"),
        (lambda: T.parse_verdict(F.lit('{"type": "dance"}')), None),
        (lambda: T.parse_verdict(F.lit("")), None),
        (lambda: T.parse_description(F.lit('{"person": {"sex": "MALE ", "upper_color": "navy"}}'))["person"]["sex"], "male"),
        (lambda: T.parse_description(F.lit('{"person": {"sex": "MALE ", "upper_color": "navy"}}'))["person"]["upper_color"], "unknown"),
        (lambda: T.person_slots(F.lit("adult man, dark shirt, light pants, black bag"))["carrying"], True),
        (lambda: T.person_slots(F.lit("young boy"))["carrying"], None),
        (lambda: T.person_slots(F.lit("woman, black clothes"))["lower_color"], ["black"]),
        (lambda: T.vehicle_slots(F.lit("white and black, hatchback, parked"))["color"], ["black", "white"]),
        (lambda: T.vehicle_slots(F.lit("silver minivan, starting to drive"))["state"], "moving"),
        (lambda: B.plausible([F.lit(float(x)) for x in (5, 0, 0, 0, 5, 0, 0, 0, 1)])[1], "scale"),
        (lambda: B.plausible([F.lit(float(x)) for x in (-1, 0, 0, 0, 1, 0, 0, 0, 1)])[1], "mirrored"),
        (lambda: B.plausible([F.lit(float(x)) for x in (math.nan, 0, 0, 0, 1, 0, 0, 0, 1)])[1], "not finite"),
        (lambda: B.at_edge(lit_box(0, 50, 20, 90), F.lit(352), F.lit(288)), True),
        (lambda: B.at_edge(lit_box(100, 50, 120, 90), F.lit(352), F.lit(288)), False),
    ],
)
def test_expressions(spark, expression, expected):
    got = value(spark, expression())
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def series(spark, values):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "k string, frame int, d double")


@pytest.mark.parametrize(
    "values,expected",
    [
        ([0.9, 0.5, 0.1, 0.1, 0.2, 0.25, 0.9], [(2, 5)]),
        ([0.9, 0.1, 0.2, 0.1, 0.25, 0.1, 0.2, 0.9], [(1, 6)]),
        ([0.9, 0.1, None, None, 0.1, 0.9], [(1, 4)]),
        ([0.9, 0.1, 0.1, None, None, None], [(1, 2)]),
        ([None, None], []),
    ],
)
def test_hysteresis(spark, values, expected):
    got = O.contact_spans(series(spark, values), ["k"], "d", 0.15, 0.30).collect()
    assert [(r.frame_start, r.frame_end) for r in got] == expected


def walk(values, enter, leave):
    """The state machine, one value after another."""
    out, start, last = [], None, None
    for k, v in enumerate(values):
        if v is None:
            continue
        if start is None and v < enter:
            start = k
        elif start is not None and v > leave:
            out.append((start, k - 1))
            start = None
        last = k
    return out + ([(start, last)] if start is not None else [])


def test_hysteresis_against_a_state_machine(spark):
    rng = random.Random(5)
    all_values = {k: [rng.choice([None, rng.random()]) if rng.random() < 0.4 else rng.random() for _ in range(40)] for k in range(60)}
    rows = [(k, f, v) for k, vs in all_values.items() for f, v in enumerate(vs)]
    got = O.contact_spans(spark.createDataFrame(rows, "k int, frame int, d double"), ["k"], "d", 0.3, 0.6).collect()
    for k, vs in all_values.items():
        assert sorted((r.frame_start, r.frame_end) for r in got if r.k == k) == walk(vs, 0.3, 0.6)


def test_thresholds_have_an_order(spark):
    with pytest.raises(ValueError):
        O.contact_spans(series(spark, [0.1]), ["k"], "d", 0.3, 0.3)


def test_smoothing(spark):
    got = O.smooth(series(spark, [1.0, None, 3.0, None, None, None]), ["k"], "d", 1).orderBy("frame").collect()
    assert [r.d for r in got] == [1.0, 2.0, 3.0, 3.0, None, None]


@pytest.mark.parametrize("spans,gap,expected", [([(0, 5), (3, 8)], 0, [(0, 8)]), ([(0, 5), (6, 8)], 0, [(0, 8)]), ([(0, 5), (8, 10)], 0, [(0, 5), (8, 10)]), ([(0, 5), (8, 10)], 2, [(0, 10)]), ([(0, 9), (2, 3)], 0, [(0, 9)])])
def test_islands(spark, spans, gap, expected):
    df = spark.createDataFrame([("a", *s) for s in spans], "k string, frame_start int, frame_end int")
    assert sorted((r.frame_start, r.frame_end) for r in O.merge_islands(df, ["k"], gap).collect()) == expected


def preds_and_gts(spark, preds, gts):
    p = spark.createDataFrame(preds, "clip_id string, pred_id long, frame_start int, frame_end int, type string, px1 double, px2 double")
    g = spark.createDataFrame(gts, "clip_id string, gt_id long, frame_start int, frame_end int, type string, ax double, ambiguous boolean")
    return p, g


def test_matching_stays_within_clips(spark):
    p, g = preds_and_gts(spark, [("A", 1, 0, 10, "enter_vehicle", None, None)], [("B", 1, 0, 10, "enter_vehicle", None, False), ("A", 2, 50, 60, "enter_vehicle", None, False)])
    m = M.match_events(p, g, ["clip_id"])
    r = E.totals(E.detection_counts(p, g, m, ["clip_id"]), []).first()
    assert (r.tp, r.fp, r.fn) == (0, 1, 2)


def test_positive_labels_and_actors_come_first(spark):
    p, g = preds_and_gts(
        spark,
        [("A", 1, 0, 9, "enter_vehicle", 0.4, 0.6), ("A", 2, 0, 8, "enter_vehicle", 0.8, 0.9)],
        [("A", 1, 0, 9, "pass_by", None, False), ("A", 2, 0, 8, "exit_vehicle", 0.63, False)],
    )
    got = {(r.pred_id, r.gt_id, r.negative) for r in M.match_events(p, g, ["clip_id"]).collect()}
    assert got == {(1, 2, False), (2, 1, True)}
    r = E.with_prf(E.totals(E.detection_counts(p, g, M.match_events(p, g, ["clip_id"]), ["clip_id"]), [])).first()
    assert (r.tp, r.fp, r.fn, r.precision) == (1, 1, 0, 0.5)


def test_empty_tables(spark):
    p, g = preds_and_gts(spark, [], [])
    m = M.match_events(p, g, ["clip_id"])
    assert m.count() == 0
    assert E.variants(p, g).count() == 0
    assert D.suppress(spark.createDataFrame([], "k int, x1 double, y1 double, x2 double, y2 double, conf double"), ["k"]).count() == 0


def test_suppression_ties_and_containment(spark):
    rows = [("a", 0.0, 0.0, 10.0, 10.0, 0.9), ("a", 0.0, 0.0, 12.0, 10.0, 0.9), ("a", 2.0, 2.0, 4.0, 4.0, 0.5), ("b", 0.0, 0.0, 10.0, 10.0, 0.8)]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sorted((r.k, r.x2) for r in D.suppress(df, ["k"]).collect()) == [("a", 12.0), ("b", 10.0)]
    assert sorted((r.k, r.x2) for r in D.suppress(df, ["k"], ios=None).collect()) == [("a", 4.0), ("a", 12.0), ("b", 10.0)]


def test_suppression_takes_all_boxes_of_a_key(spark):
    # 150 boxes apart from each other, and a copy of the least confident one
    rows = [(1, 7, 2, 20.0 * k, 0.0, 20.0 * k + 10, 10.0, 0.99 - k / 1000) for k in range(150)] + [(1, 7, 2, 2980.0, 0.0, 2990.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sorted(r.x1 for r in D.suppress(df, ["clip_id", "frame", "cls"]).collect()) == [20.0 * k for k in range(150)]
    tiles = df.where("x1 < 1500").withColumns({"x0": F.lit(0), "y0": F.lit(0)})
    assert sorted(r.x1 for r in D.merge_tiled(tiles, df.where("x1 >= 1000")).collect()) == [20.0 * k for k in range(150)]
    assert D.suppress(df, ["clip_id", "frame", "cls"], per_key=20).count() == 20


def test_class_map_needs_a_person(spark):
    labels = spark.createDataFrame([(3, "Car"), (9, "lorry")], "model_id int, name string")
    with pytest.raises(Exception, match="person"):
        D.class_map(labels, spark).collect()


@pytest.mark.parametrize(
    "start,end,birth,death,door,expected",
    [(0, 29, -50, 150, None, ["R1_dwell"]), (10, 12, 0, 99, None, []), (70, 72, 0, 72, None, ["R2_death_near"]), (10, 12, 10, 99, None, ["R3_birth_near"]), (10, 12, 0, 99, 0.45, ["R4_door_change"]), (10, 12, 0, 99, 0.1, [])],
)
def test_rules(spark, start, end, birth, death, door, expected):
    df = spark.createDataFrame([(start, end, birth, death, 10.0, 100, door)], "frame_start int, frame_end int, birth int, death int, fps double, n_frames int, max_door double")
    assert [r.rules for r in P.fired(df).collect()] == ([expected] if expected else [])


def test_pair_series_fills_half_a_window(spark):
    box = lambda x: (float(x), 0.0, float(x) + 10, 20.0)
    persons = spark.createDataFrame([("c", 1, f, *box(40)) for f in (3, 4, 5)], "clip_id string, track_id int, frame int, x1 double, y1 double, x2 double, y2 double")
    vehicles = spark.createDataFrame([("c", 2, f, 0.0, 0.0, 30.0, 40.0) for f in range(10)], persons.schema)
    clips = spark.createDataFrame([("c", 640, 480, 6.0, 10)], "clip_id string, width int, height int, fps double, n_frames int")
    got = P.pair_series(persons, vehicles, clips, [1]).orderBy("frame").collect()
    assert [r.d_norm is not None for r in got] == [False, False, True, True, True, True, True, False, False, False]
    assert got[4].d_norm == pytest.approx(0.2) and got[4].speed_bl_s == 0.0 and [r.visible for r in got].count(True) == 3


def test_leave_one_out_does_not_see_the_held_out_clip(spark):
    rows = [("a", 0, 1, 0, 0), ("a", 1, 0, 1, 1), ("b", 0, 0, 1, 1), ("b", 1, 1, 0, 0), ("c", 0, 0, 1, 1), ("c", 1, 1, 0, 0)]
    got = {r.fold: r.pos for r in E.leave_one_out(spark.createDataFrame(rows, "clip_id string, pos int, tp int, fp int, fn int")).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}


def test_pooling_refuses_gaps_and_mixed_configurations(spark):
    rows = spark.createDataFrame([("a", "h", 5, "a__i001"), ("a", "h", 2, "a__i002")], "clip_id string, config_hash string, frame_start int, interaction_id string")
    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    with pytest.raises(Exception, match="without records"):
        A.pooled(rows, clips).collect()
    assert [r.frame_start for r in A.pooled(rows, clips, allow_partial=True).collect()] == [2, 5]
    mixed = rows.union(spark.createDataFrame([("b", "other", 1, "b__i001")], rows.schema))
    with pytest.raises(Exception, match="configurations"):
        A.pooled(mixed, clips).collect()


def test_rounding_is_that_of_the_exact_value(spark):
    values = [a / b for b in (1920, 1280, 720, 29.97, 7) for a in range(0, 2 * 1920, 7)] + [2.675, 1.005, 0.015625, -0.00005, 138 / 1920, 306 / 1920, 294 / 1920]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (3, 4, 5):
        assert all(r.r == round(r.v, places) for r in df.select("v", S.rounded(F.col("v"), places).alias("r")).collect())


def test_many_settings_in_one_pass(spark):
    rows = [(k, f, ((f * 7 + k * 3) % 23) / 23, ((f * 5 + k) % 11) / 11) for k in range(4) for f in range(60)]
    series = spark.createDataFrame(rows, "pair int, frame int, d double, conf double")
    settings = [(0, 0.1, 0.3, 0.0), (1, 0.2, 0.6, 0.0), (2, 0.2, 0.6, 0.4)]
    got = {tuple(r) for r in O.contact_spans_grid(series, ["pair"], "d", settings, "conf").collect()}
    want = set()
    for pos, near, far, least in settings:
        one = O.contact_spans(series.withColumn("d", F.when(F.col("conf") >= least, F.col("d"))), ["pair"], "d", near, far)
        want |= {(pos, *r) for r in one.collect()}
    assert got == want and len(got) > 12


def test_many_settings_in_batches_of_any_size(spark):
    """Keys and spans go on from batch to batch, of missing, NaN and few values, and of two key columns with NULL."""
    kind = lambda k, f: None if (f * 11 + k) % 9 == 0 else float("nan") if (f * 13 + k) % 29 == 0 else ((f * 7 + k * 3) % 23) / 23
    rows = [(k, None if k % 3 == 0 else f"x{k % 2}", f, kind(k, f), None if f % 17 == 3 else ((f * 5 + k) % 11) / 11) for k in range(9) for f in range(1 if k == 5 else 40 + k)]
    series = spark.createDataFrame(rows, "pair long, side string, frame long, d double, conf double").repartition(1)
    settings = [(3, 0.1, 0.3, 0.0), (1, 0.2, 0.6, 0.0), (2, 0.2, 0.6, 0.4), (7, 0.9, 0.95, 0.8), (8, 0.0, 0.5, 0.0)]
    want = set()
    for pos, near, far, least in settings:
        want |= {(pos, *r) for r in O.contact_spans(series.withColumn("d", F.when(F.col("conf") >= least, F.col("d"))), ["pair", "side"], "d", near, far).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = O.contact_spans_grid(series, ["pair", "side"], "d", settings, "conf")
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) > 30 and set(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    # one pass over the rows in batches, without a window a setting
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Window" not in found._jdf.queryExecution().toString()


def test_held_out_settings_hold_no_setting_whole(spark):
    counts = spark.createDataFrame([("a", 0, 1, 0, 0)], "clip_id string, pos int, tp int, fp int, fn int")
    assert "Window" not in E.leave_one_out(counts)._jdf.queryExecution().toString()
