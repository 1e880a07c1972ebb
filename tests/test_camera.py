"""Camera motion: planted homographies with noise and wrong points, and pairs that say nothing."""

import numpy as np
import pytest

from kinograph.operators import camera as Z

POINTS = "clip_id string, frame int, point_id long, x double, y double"


def moved(h, p):
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.asarray(h, float).reshape(3, 3).T
    return q[:, :2] / q[:, 2:]


PLANTED = [
    [1, 0, 0, 0, 1, 0, 0, 0, 1],
    [1, 0, 240.0, 0, 1, -35.5, 0, 0, 1],
    [1.1, -0.2, 14, 0.15, 0.95, -40, 0, 0, 1],
    [1.02, 0.03, 5, -0.02, 0.98, 9, 1e-4, -5e-5, 1],
]


@pytest.mark.parametrize("h", PLANTED)
@pytest.mark.parametrize("wrong", [0.0, 0.3, 0.5])
def test_planted_homographies_are_found_among_wrong_points(h, wrong):
    rng = np.random.default_rng(7)
    a = rng.uniform(0, 1000, (120, 2))
    b = moved(h, a) + rng.normal(size=a.shape) * 0.3
    bad = rng.random(len(a)) < wrong
    b[bad] = rng.uniform(0, 1000, (int(bad.sum()), 2))
    found, agree = Z.consensus(a, b, 3)
    assert np.hypot(*(moved(found, a) - moved(h, a)).T).max() < 1.5
    assert agree[~bad].mean() > 0.95 and agree[bad].sum() <= 2


def test_exact_points_give_the_exact_homography():
    a = np.array([[x, y] for x in range(0, 600, 100) for y in range(0, 500, 80)], float)
    found, agree = Z.consensus(a, moved(PLANTED[3], a))
    assert agree.all() and np.abs(found.reshape(-1) - PLANTED[3]).max() < 1e-8


def test_points_that_say_nothing():
    line = np.array([[k, 2.0 * k] for k in range(30)])
    assert Z.consensus(line, line)[0] is None
    assert Z.consensus(line[:3], line[:3])[0] is None and Z.consensus(np.zeros((0, 2)), np.zeros((0, 2)))[0] is None
    same = np.zeros((20, 2))
    assert Z.consensus(same, same)[0] is None


def test_pairs_reasons_and_batches_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows, clips = [], []
    for clip, h, n in (("fine", PLANTED[2], 40), ("few", PLANTED[0], 8), ("mirrored", [-1, 0, 900, 0, 1, 0, 0, 0, 1], 40), ("far", [2.5, 0, 0, 0, 2.5, 0, 0, 0, 1], 40), ("noise", None, 60)):
        a = rng.uniform(0, 800, (n, 2))
        b = rng.uniform(0, 800, (n, 2)) if h is None else moved(h, a)
        rows += [(clip, 0, k, *map(float, a[k])) for k in range(n)] + [(clip, 6, k, *map(float, b[k])) for k in range(n)]
        clips.append((clip, 6.0, 7, 1000))
    rows += [("fine", 0, 999, 5.0, 5.0), ("fine", 6, 999, 900.0, 5.0), ("fine", 6, 999, 5.0, 900.0), ("fine", 0, 1000, None, 1.0), ("fine", 6, 1000, 1.0, 1.0)]
    clips += [("short", 6.0, 6, 1000), ("unseen", 6.0, 50, 1000)]
    points = spark.createDataFrame(rows, POINTS).repartition(5)
    clips = spark.createDataFrame(clips, "clip_id string, fps double, n_frames int, width int")
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = Z.homographies(Z.lagged_points(points, Z.sampled_pairs(clips)))
            seen.append({r.clip_id: r for r in got.collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1]
    assert {k: (r.reason, r.ok) for k, r in seen[0].items()} == {"fine": ("ok", True), "few": ("too few matches", False), "mirrored": ("mirrored", False), "far": ("scale", False), "noise": ("too few inliers", False)}
    assert seen[0]["fine"].n_matches == seen[0]["fine"].n_inliers == 40
    report = {r.clip_id: r for r in Z.motion_report(got, clips).collect()}
    assert not report["fine"].static and report["short"].static and report["unseen"].pairs == 0 and report["noise"].estimated == 0


def test_sampled_pairs(spark):
    clips = spark.createDataFrame([("a", 25.0, 600), ("b", 25.0, 26), ("c", 25.0, 25), ("d", 0.2, 3)], "clip_id string, fps double, n_frames int")
    got = {}
    for r in Z.sampled_pairs(clips).collect():
        got.setdefault(r.clip_id, []).append((r.frame_a, r.frame_b))
    assert got["b"] == [(0, 25)] and "c" not in got and sorted(got["d"]) == [(0, 1), (1, 2)]
    assert len(got["a"]) == 13 and all(b - a == 25 and b < 600 for a, b in got["a"])
