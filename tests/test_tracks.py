"""Assignment against all choices, and the tracker in batches and in a stream."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinograph.functions.assignment import assign, heaviest_pairs
from kinograph.streaming import tracks as K
from kinograph.streaming.late import LateRows

DETS = "clip_id string, frame int, cls int, x1 double, y1 double, x2 double, y2 double, conf double"


def test_assignment_equals_the_best_of_all_choices():
    rng = np.random.default_rng(1)
    for t in range(1500):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 5, (n, m)).astype(float) if t % 2 else rng.normal(size=(n, m))
        pairs = assign(cost)
        assert len(pairs) == min(n, m) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, s[i]] for i in range(wide.shape[0])) for s in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(cost[p] for p in pairs) == pytest.approx(best)


def test_heaviest_pairs_equal_the_best_of_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(800):
        n, m = rng.integers(1, 5, 2)
        weight = rng.random((n, m))
        best = 0.0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for columns in itertools.permutations(range(m), k):
                    if all(weight[r, c] >= 0.4 for r, c in zip(rows, columns)):
                        best = max(best, sum(weight[r, c] for r, c in zip(rows, columns)))
        pairs = heaviest_pairs(weight, 0.4)
        assert all(weight[p] >= 0.4 for p in pairs) and sum(weight[p] for p in pairs) == pytest.approx(best)
    assert heaviest_pairs(np.zeros((0, 3)), 0.4) == [] == heaviest_pairs(np.zeros((2, 2)), 0.4)


def box(x, y=0.0, w=40.0, h=100.0):
    return [x, y, x + w, y + h]


def run(frames, **more):
    """Track numbers by frame, of frames given as {frame: [(x, conf) or (box, conf)]}."""
    tracker = K.Tracker(**({"lost_after": 10, "trusted": 0.6} | more))
    out = {}
    for f, rows in sorted(frames.items()):
        boxes = np.array([b if isinstance(b, list) else box(b) for b, _ in rows], float).reshape(-1, 4)
        out[f] = tracker.step(f, boxes, np.array([c for _, c in rows], float)).tolist()
    return out


def test_a_number_comes_with_the_second_frame_and_stays_through_gaps():
    got = run({f: [(2.0 * f, 0.9)] for f in [0, 1, 2, 3, 4, 9, 10]} | {25: [(50.0, 0.9)], 26: [(52.0, 0.9)]})
    assert [got[f] for f in (0, 1, 4, 9, 10)] == [[-1], [0], [0], [0], [0]]
    assert got[25] == [-1] and got[26] == [1]  # not seen for more than ten frames
    assert run({0: [(0.0, 0.9)], 2: [(0.0, 0.9)], 3: [(0.0, 0.9)]}) == {0: [-1], 2: [-1], 3: [0]}  # one without a number misses none


def test_weak_boxes_continue_tracks_and_begin_none():
    got = run({f: [(0.0, 0.9 if f < 3 else 0.2), (500.0, 0.2)] for f in range(8)})
    assert got[7] == [0, -1] and all(n[1] == -1 for n in got.values())


def test_trusted_boxes_choose_before_weak_ones():
    got = run({0: [(0.0, 0.9)], 1: [(0.0, 0.9)], 2: [(0.0, 0.3), (15.0, 0.9)]})
    assert got[2] == [-1, 0]


def test_objects_that_pass_through_each_other_keep_their_numbers():
    """Overlap with the last box alone would swap them where they meet."""
    frames = {f: [(8.0 * f, 0.9), (320 - 8.0 * f, 0.8)] for f in range(41) if f not in (19, 20, 21)}
    got = run(frames)
    assert got[1] == got[18] == got[22] == got[40] == [0, 1]


def test_the_choice_is_best_in_all_not_box_by_box():
    # the second box overlaps track 0 most, but then the first would have none
    got = run({0: [(0.0, 0.9), (30.0, 0.9)], 1: [(0.0, 0.9), (30.0, 0.9)], 2: [(-9.0, 0.9), (14.0, 0.9)]}, least_iou=(0.1, 0.5))
    assert got[2] == [0, 1]


def test_a_camera_that_pans():
    shift = [1.0, 0.0, 300.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    for moved, last in ((True, 0), (False, -1)):
        tracker = K.Tracker(10, 0.6)
        for f in range(3):
            tracker.step(f, np.array([box(2.0 * f)]), np.array([0.9]))
        if moved:
            tracker.warp(shift)
        assert tracker.step(3, np.array([box(306.0)]), np.array([0.9])).tolist() == [last]


def some_dets(seed, clips=5, frames=40, objects=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clips):
        for o in range(objects):
            x, v, cls = rng.uniform(0, 600), rng.uniform(-4, 4), int(rng.choice([0, 0, 2, 7]))
            rows += [(f"c{c}", f, cls, *map(float, box(x + v * f + rng.normal() * 2)), float(rng.uniform(0.2, 1))) for f in range(frames) if rng.random() < 0.85]
    return rows


def plain(rows, fps=6.0, trusted=0.65):
    """The same tracker over each clip and kind, one after another."""
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in DETS.split(", ")])
    out = []
    for (clip, person), part in df.groupby(["clip_id", df["cls"] == 0]):
        tracker = K.Tracker(K.lost_frames(fps), trusted)
        part = part.sort_values(["frame", "conf", *K.BOX, "cls"], ascending=[True, False, *[True] * 5])
        for f, now in part.groupby("frame"):
            for r, n in zip(now.itertuples(), tracker.step(f, now[K.BOX].to_numpy(), now["conf"].to_numpy())):
                if n >= 0:
                    out.append((clip, f, r.x1, int(n) + (0 if person else K.VEHICLES_FROM)))
    return sorted(out)


def test_batches_of_any_size_give_the_same_tracks(spark):
    rows = some_dets(3)
    dets = spark.createDataFrame(rows, DETS).repartition(7)
    clips = spark.createDataFrame([(f"c{k}", 6.0) for k in range(5)], "clip_id string, fps double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted((r.clip_id, r.frame, r.x1, r.track_id) for r in K.observed(dets, clips).collect())
            assert got == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tracks_have_one_class_and_odd_rows_are_left_out(spark):
    rows = [("c", f, 2 if f in (1, 2, 5) else 7, 100.0, 0.0, 150.0, 40.0, 0.8) for f in range(6)] + [("c", None, 2, 0.0, 0.0, 1.0, 1.0, 0.9), ("c", 3, 2, None, 0.0, 1.0, 1.0, 0.9), ("c", 3, 2, 0.0, 0.0, 1.0, 1.0, None), ("other", 1, 0, 0.0, 0.0, 1.0, 1.0, 0.9)]
    clips = spark.createDataFrame([("c", 6.0), ("empty", 6.0)], "clip_id string, fps double")
    got = K.track(spark.createDataFrame(rows, DETS), clips).collect()
    assert {(r.clip_id, r.track_id, r.cls) for r in got} == {("c", 10_000, 2)} and sorted(r.frame for r in got) == [1, 2, 3, 4, 5]
    assert K.track(spark.createDataFrame([], DETS), clips).collect() == []


def test_a_camera_table_moves_the_tracks(spark):
    rows = [("c", f, 0, *box(2.0 * f + (300.0 if f > 2 else 0.0)), 0.9) for f in range(6)]
    clips = spark.createDataFrame([("c", 6.0)], "clip_id string, fps double")
    camera = spark.createDataFrame([("c", 3, [1.0, 0.0, 300.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "clip_id string, frame int, h array<double>")
    dets = spark.createDataFrame(rows, DETS)
    assert {r.track_id for r in K.observed(dets, clips, camera=camera).collect()} == {0}
    assert {r.track_id for r in K.observed(dets, clips).collect()} == {0, 1}


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_a_stream_equals_the_batch_in_any_order_within_the_delay(spark, tmp_path, order):
    rows = some_dets(4, clips=2, frames=20, objects=3)
    df = spark.createDataFrame(rows, DETS).withColumn("fps", F.lit(6.0)).withColumn("ts", F.timestamp_seconds(1000 + F.col("frame") / 6)).toPandas()
    sooner = np.random.default_rng(5).integers(0, 8, len(df)) if order == "shuffled" else 0
    df = df.assign(at=df["frame"] + sooner).sort_values("at", kind="stable").drop(columns="at")
    # the end of the stream, a minute later, and a row that comes far too late
    end = pd.DataFrame([("end", 0, 0, 0.0, 0.0, 1.0, 1.0, 0.9, 6.0, pd.Timestamp(5000, unit="s"))], columns=df.columns)
    late = df[df["frame"] == 0].head(1)
    schema = DETS + ", fps double, ts timestamp"
    parts = [*np.array_split(np.arange(len(df)), 3)]
    for k, part in enumerate([*(df.iloc[p] for p in parts), end, end, late]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    name, late_rows = f"tracks{len(order)}", LateRows()
    spark.streams.addListener(late_rows)
    q = K.stream_tracks(stream, delay="2 seconds").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.clip_id, r.frame, r.x1, r.track_id) for r in spark.table(name).collect()) == plain(rows)
    for _ in range(100):  # listeners hear of a batch after it has ended
        if late_rows.total(name):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late_rows)
    assert late_rows.total(name) == 1 and [r.rows for r in late_rows.table(spark).collect()] == [1]


def test_frames_of_a_few_boxes_cost_little():
    tracker = K.Tracker(25, 0.6)
    began = time.process_time()
    for f in range(4000):
        tracker.step(f, np.array([box(float(f)), box(9000.0), box(9500.0)]), np.array([0.9, 0.8, 0.3]))
    assert time.process_time() - began < 1.5  # 3.5 s by arrays of each frame's boxes


def test_many_boxes_and_few_are_compared_alike(monkeypatch):
    rng = np.random.default_rng(5)
    frames = [(f, np.concatenate([p := rng.random((12, 2)) * 150, p + 20 + rng.random((12, 2)) * 60], 1), rng.random(12)) for f in range(40)]
    got = []
    for few in (0, 10_000):
        monkeypatch.setattr(K, "FEW", few)
        tracker = K.Tracker(10, 0.6)
        got.append([tracker.step(*x).tolist() for x in frames])
    assert got[0] == got[1] and max(map(max, got[0])) > 5


def test_the_tracker_runs_once(spark):
    df = spark.createDataFrame([("a", f, 0, *box(1.0 * f), 0.9) for f in range(5)], DETS)
    tracks = K.track(df, spark.createDataFrame([("a", 25.0)], "clip_id string, fps double"))
    assert "MapInArrow" not in tracks._jdf.queryExecution().toString() and tracks.count() == 4
