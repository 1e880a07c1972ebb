"""Codes of vectors against a plain version in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from kinograph.llm import codes
from kinograph.llm.queries import ORACLES, QUERIES
from tests.compare import connection, differences

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dim = -(-max(max(len(v) for _, v, _ in kept), 1) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    w = dim // parts
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(v, p)[1], []).append(v[p * w : p * w + w])
            new.append([[sum(x) // len(x) for x in zip(*mine[e])] if e in mine else c for e, c in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), lab) for i, v, lab in kept]
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted([(i, c, e, total[lab], digest) for i, c, e, lab in out], key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as columns", "3 as error", "'x' as code", "4 as vector", "5 as of")
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted([tuple(r) for r in QUERIES["op13_codes"](spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


def vectors(n, dim, seed, grain=8):
    """Coarse components, so that distances tie."""
    rng = np.random.default_rng(seed)
    return (np.round(rng.normal(size=(n, dim)) * grain) / grain).astype(np.float32).tolist()


def test_equals_the_plain_version(spark, tmp_path):
    rows = [(k * 3, v, k % 5 if k % 7 else None) for k, v in enumerate(vectors(200, 32, 1, 2))]
    rows += rows[:9] + [(7, None, 1), (8, [None] * 32, 1), (9, [NAN] * 32, 2), (10, [1.0] * 31 + [INF], 2), (11, [1.0] * 31 + [None], 2), (None, vectors(1, 32, 2)[0], 3), (-1, [-0.001] * 32, 3)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_lengths_that_differ(spark, tmp_path):
    rows = [(k, v[: 3 + k % 30], 0) for k, v in enumerate(vectors(90, 40, 3))] + [(1000, [], 0)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(5, [0.5] * 16, 1), (5, [0.25] * 16, None), (5, [0.5] * 16, 1)]
    assert run(spark, tmp_path / "few", rows) == plain(rows)
    assert run(spark, tmp_path / "none", [(1, None, 1), (2, [NAN], 1)]) == []
    assert run(spark, tmp_path / "empty", []) == []


def test_large_components_do_not_overflow(spark, tmp_path):
    rows = [(k, [(-1) ** k * 3e38] * 16, k) for k in range(4)] + [(9, [0.0] * 16, None)]
    got = run(spark, tmp_path, rows)
    assert len(got) == 5 and all(r[2] >= 0 for r in got)


def test_blocks_in_any_deal_train_the_same_books(spark):
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors(500, 16, 5))], "vec_id long, embedding array<float>, label int")
    books = [codes.compress(df.repartition(n))[1] for n in (1, 13)]
    assert (books[0] == books[1]).all() and books[0].shape == (16, 64, 1)


def test_the_lower_entry_wins_a_tie():
    books = np.array([[[0], [2], [0]]], np.int64)
    index, least = codes.nearest(np.array([[1, 0, 2, 5]], np.int64), books)
    assert index.tolist() == [[0, 0, 1, 1]] and least.tolist() == [[1, 0, 0, 9]]


@pytest.mark.parametrize("name", ["op12_negatives", "op13_codes"])
def test_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder), connection(folder), ORACLES[name]) == ""
