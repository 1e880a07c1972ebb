"""Connected components against a union-find, on graphs of several shapes."""

import random

import pytest

from kinograph.llm.common import Tables
from kinograph.llm.components import connected_components


def plain(edges):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {x: root(x) for x in above}


def random_edges():
    r = random.Random(5)
    return [(r.randrange(400), r.randrange(400)) for _ in range(260)]


SHAPES = {
    "none": [],
    "stars": [(1, 5), (7, 1), (2, 9)],
    "path": [(k, k + 1) for k in range(60)],
    "hub": [(50, k) for k in range(120)],
    "two parents": [(9, 1), (9, 2)],
    "negative and repeated": [(-3, 4), (4, -3), (4, 4), (4, 8)],
    "random": random_edges(),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_components(spark, shape):
    edges = SHAPES[shape]
    tables = Tables(spark)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), tables).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == plain([e for e in edges if e[0] != e[1]])


def test_stars_need_no_round(spark):
    tables = Tables(spark)
    connected_components(spark.createDataFrame(SHAPES["stars"], "a long, b long"), tables)
    assert tables.n == 1


def test_rows_of_a_binary_column_are_views_of_it():
    import numpy as np
    import pyarrow as pa

    from kinograph.llm.common import parts_of

    rows = [np.array(x, np.int32) for x in ([1, 2], [], [3], [4, 5, 6])]
    column = pa.array([x.tobytes() for x in rows], pa.binary())
    for at in (0, 1, 2):
        assert [x.tolist() for x in parts_of(column.slice(at), np.int32)] == [x.tolist() for x in rows[at:]]
    assert parts_of(pa.array([b"", b""], pa.binary()), np.float32)[1].size == 0
