"""Line deduplication against a plain version."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from kinograph.llm import lines
from kinograph.llm.common import text_buffers
from kinograph.llm.queries import ORACLES, QUERIES
from tests.compare import connection, differences
import pyarrow as pa

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(docs, least=10):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(key(x)) < least or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for name in ("salt", "gone", "digest", "kept", "docs"):
        df = df.selectExpr("*", f"1 as {name}")
    return sorted([tuple(r) for r in lines.dedup_lines(df, **more).collect()], key=str)


def some_docs(n, seed):
    rng = random.Random(seed)
    said = ["A line that is Common to all", "a LINE that is common to all ", "\t ünïcode line — ÄÖ \r", "ünïcode line — Äö", "short", "ninechars", "tencharsxx", " tenCHARSxx\x0b", "日本語のテキストです。とても", " hard space line ", "hard space line", "", "   ", "x" * 5000]
    return [(rng.choice([k, k, k, k // 2]), None if rng.random() < 0.05 else "\n".join(rng.choice(said) if rng.random() < 0.6 else f"line of its own {rng.random()}" for _ in range(rng.choice([0, 1, 1, 3, 9])))) for k in range(n)]


@pytest.mark.parametrize("bits", [16, 20, 28])
def test_equals_the_plain_version(spark, bits):
    docs = some_docs(300, bits) + [(None, "a line that is common to all\nshort"), (None, None), (-5, "tencharsxx")]
    assert run(spark, docs, bits=bits) == plain(docs)


def test_false_suspects_change_nothing(spark):
    """A filter of 2^16 bits is full of these lines: nearly all are suspects."""
    docs = [(k, "\n".join(f"line {k * 500 + j} of many others" for j in range(500)) + ("\nThe one that repeats" if k % 7 == 3 else "")) for k in range(60)]
    got = run(spark, docs, bits=16)
    assert got == plain(docs) and sum(r[3] for r in got) == 8


def test_repeats_within_one_document_stay(spark):
    docs = [(3, "one and the same line\nONE and the same line\nother"), (5, "x\n  one and the same line\none and the same line"), (5, "one and the same line")]
    assert run(spark, docs) == [(3, docs[0][1], 3, 0), (5, "", 1, 1), (5, "x", 3, 2)]


def test_empty_very_long_and_bounded(spark):
    long = "\n".join(f"word{k % 997} of line {k % 5003}" for k in range(60_000))
    docs = [(1, ""), (2, None), (3, "\n"), (4, long), (9, long), (10, "y" * 3_000_000), (11, "Y" * 3_000_000)]
    got = {r[0]: r for r in run(spark, docs)}
    assert got[1] == (1, "", 1, 0) and got[2] == (2, "", 1, 0) and got[3] == (3, "\n", 2, 0)
    assert got[4] == (4, long, 60_000, 0) and got[9] == (9, "", 60_000, 60_000) and got[11] == (11, "", 1, 1)
    assert run(spark, []) == []


def test_a_line_in_all_documents_is_a_row_a_batch(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'the line that all have' as text").repartition(4)
    filters = spark.sparkContext.broadcast(lines.twice_seen(df))
    assert len(filters.value) <= 2  # the segments of one key's two bits
    rows = df.mapInArrow(lines._suspects(filters, 10, lines.FILTER_BITS), "digest binary, docs array<long>").collect()
    assert len(rows) <= 8 and sum(len(r.docs) for r in rows) == 3000


def test_lines_of_bytes():
    texts = ["a\n", "", "\n\n", " b c \n\td", "é"]
    found = lines.Lines(*text_buffers(pa.array(texts)))
    raw = "".join(texts).encode()
    assert found.row.tolist() == [0, 0, 1, 2, 2, 2, 3, 3, 4]
    assert [raw[a:b].decode() for a, b in zip(found.a, found.b)] == ["a", "", "", "", "", "", "b c", "d", "é"]
    assert found.length.tolist() == [1, 0, 0, 0, 0, 0, 3, 1, 1]
    h = lines.Lines(*text_buffers(pa.array(["xx Same", "  xx sAME\t", "xx same y"])))
    assert len(set(h.hashes(np.arange(3)).tolist())) == 2 and h.digests(np.arange(2)) == [hashlib.blake2b(b"xx same", digest_size=16).digest()] * 2


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES["op11_lines"](spark, folder), connection(folder), ORACLES["op11_lines"]) == ""
