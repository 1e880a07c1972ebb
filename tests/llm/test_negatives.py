"""Hard negatives against a plain version, and the brackets of the pivot table."""

import math

import numpy as np
import pytest

from kinograph.llm import negatives
from kinograph.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def plain(rows):
    kept = set()
    for i, v, lab in rows:
        if i is None or lab is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        kept.add((i, tuple(math.floor(256 * x) for x in v), (lab + 1) % 10 if i % 7 == 0 else lab))
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in kept if b != a]
        for p, i, _ in sorted(s for s in scored if s[2] == a[2])[:5]:
            fit = sorted(s for s in scored if s[2] != a[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a[0], i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def run(spark, folder, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as part", "2 as v", "3 as away", "4 as anchor", "5 as mixed", "6 as vector", "7 as low", "8 as score")
    df.repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op12_negatives"](spark, str(folder)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dim, seed, grain=4):
    rng = np.random.default_rng(seed)
    return (np.round(rng.normal(size=(n, dim)) * grain) / grain / math.sqrt(dim)).astype(np.float32).tolist()


ODD = [(100, None, 1), (200, [NAN] * 8, 1), (300, [INF] * 8, 1), (400, [None] * 8, 1), (500, [1.0] * 8, None), (None, [1.0] * 8, 2)]


def test_equals_the_plain_version(spark, tmp_path):
    """Coarse components tie; rows repeat; some have no label, number or vector."""
    rows = [(k * 20, v, k % 4) for k, v in enumerate(vectors(400, 8, 1, 2))]
    rows += rows[:60] + ODD + [(0, rows[3][1], 0), (1000, [0.0] * 8, 2), (5, [], 0), (1100, [0.5, 0.5], 0)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows) and len(got) > 1000


@pytest.mark.parametrize("probe", [1, 40])
def test_many_parts_and_a_small_sample(spark, tmp_path, monkeypatch, probe):
    """What anchors need from the sample on never loses a row, however few rows a part or the sample has."""
    monkeypatch.setattr(negatives, "PROBE_ROWS", probe)
    monkeypatch.setattr(negatives, "PART_ROWS", 50)
    monkeypatch.setattr(negatives, "REGIONS", 7)
    rows = [(k * 10, v, k % 3) for k, v in enumerate(vectors(900, 6, 2))]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_one_label_and_one_vector_for_most(spark, tmp_path):
    rows = [(k * 50, [0.5] * 4, 1) for k in range(300)] + [(7000 + k, v, 2) for k, v in enumerate(vectors(300, 4, 3))]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_few_rows_and_none(spark, tmp_path):
    assert run(spark, tmp_path / "none", ODD) == [] and run(spark, tmp_path / "empty", []) == []
    assert run(spark, tmp_path / "alone", [(100, [1.0], 1)]) == []
    rows = [(100, [1.0], 1), (101, [2.0], 1), (102, [1.0], 2), (103, [-1.0], 2), (200, [-1.0], 2)]
    assert run(spark, tmp_path / "few", rows) == plain(rows) == [(100, 101, 1, 102, 131072, 65536)]


def test_large_components_do_not_overflow(spark, tmp_path):
    got = run(spark, tmp_path, [(100 * k, [3e38, -3e38, 1.0], k % 2) for k in range(9)] + [(1, [1e30, -1e30, 0.0], 0)])
    assert got == []  # all are set to one length: no score is within 90 % of another


def test_brackets_hold():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(200, 12)) * 300).astype(np.int64)
    q = x[:20]
    reach = int((x * x).sum(1).max())
    empty = [np.zeros(0)] * 4
    space = negatives.Space(12, negatives.spread(x, reach), reach, *empty)
    assert len(space.pivots) == negatives.PIVOTS
    away = space.row_distances(x)
    least, most = space.bracket(q, space.anchor_distances(q), away, away)
    score = q @ x.T
    assert (least <= score).all() and (score <= most).all()
    # of a group: within the brackets of the group's ends
    least, most = space.bracket(q, space.anchor_distances(q), away.min(0)[None], away.max(0)[None])
    assert (least[:, 0] <= score.min(1)).all() and (score.max(1) <= most[:, 0]).all()


def test_the_pivots_rule_parts_out(spark, monkeypatch):
    """In a table of far clusters, anchors go to some of the parts alone."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * 0.02).tolist(), k % 2, k % 100 == 0) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label long, anchor boolean")
    from kinograph.session import ship_package

    ship_package(spark)
    monkeypatch.setattr(negatives, "PART_ROWS", 250)
    pivot = negatives.PivotTable(df)
    parts = int(pivot.space.last[-1]) + 1
    anchors = pivot.rows.where("anchor").selectExpr("vec_id", "mixed", "label", "v", f"array({-negatives.NO_END}) as low", f"array({negatives.NO_END}) as high")
    sent = anchors.mapInArrow(negatives._probe(pivot.shared, True, 5), negatives.ANCHOR + ", spans array<struct<a int, b int>>").collect()
    visits = sum(s.b - s.a + 1 for r in sent for s in r.spans)
    assert parts >= 20 and len(sent) == 60 and visits < 60 * parts * 0.5
