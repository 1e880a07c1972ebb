"""The response store: repeated batches, the last writer, compaction, and compactions that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinograph.sources import responses as S


def rows(spark, *triples):
    """Rows of (key, minute, raw)."""
    data = [(k, dt.datetime(2026, 1, 1, 0, m), "m", None, None, [1, 2], raw, None) for k, m, raw in triples]
    return spark.createDataFrame(data, S.RECORD)


@pytest.fixture
def store(spark, tmp_path):
    return S.Responses(spark, f"file://{tmp_path}/store")


def held(store, **more):
    return sorted((r.key, r.raw) for r in store.read(**more).collect())


def test_repeated_batches_leave_one_row_a_key(spark, store):
    assert held(store) == []
    for _ in range(3):
        store.append(rows(spark, ("a", 1, "x"), ("b", 1, "y"), ("b", 1, "y")), "one")
    assert held(store) == [("a", "x"), ("b", "y")] and store._all().count() == 3
    store.append(rows(spark, ("a", 1, "z")), "one")
    assert held(store) == [("a", "z")]  # the batch is what it was written as last


def test_the_last_writer_counts(spark, store):
    store.append(rows(spark, ("a", 5, "late"), ("b", 2, "first")), "2")
    store.append(rows(spark, ("a", 3, "early"), ("b", 2, "other")), "1")
    assert held(store) == [("a", "late"), ("b", "first")]
    store.append(rows(spark, ("a", 5, "again")), "3")
    assert held(store) == [("a", "again"), ("b", "first")]
    assert held(store, keys=spark.createDataFrame([("b",), ("zz",), ("b",)], "key string")) == [("b", "first")]


def test_compaction_changes_no_result(spark, store):
    for n in range(4):
        store.append(rows(spark, *[(f"k{i}", n, f"{i}/{n}") for i in range(n, 30)]), f"b{n}")
    before = held(store)
    store.compact()
    assert held(store) == before and store._all().count() == 30
    store.append(rows(spark, ("k0", 9, "new")), "b9")
    store.append(rows(spark, ("k1", 9, "never")), "b0")  # in the snapshot already
    after = [("k0", "new"), *before[1:]]
    assert held(store) == after
    store.compact()
    store.purge()
    assert held(store) == after and store.batches() == [] and store._all().count() == 30


def test_a_compaction_or_batch_that_fails_changes_nothing(spark, store, monkeypatch):
    store.append(rows(spark, ("a", 1, "x")), "one")
    with pytest.raises(Exception, match="broken"):
        store.append(rows(spark, ("a", 2, "y")).withColumn("raw", F.raise_error(F.lit("broken"))), "two")
    assert held(store) == [("a", "x")] and store.batches() == ["one"]
    at = store._at
    monkeypatch.setattr(store, "_at", lambda *parts: 1 / 0 if parts[0].startswith("_pointer") else at(*parts))
    with pytest.raises(ZeroDivisionError):
        store.compact()
    monkeypatch.undo()
    assert held(store) == [("a", "x")] and store._pointer() == (None, [])
    store.purge()
    assert held(store) == [("a", "x")]
    with pytest.raises(ValueError):
        store.append(rows(spark, ("a", 1, "x")), "../two")


def test_a_stream_writes_each_batch_once(spark, store, tmp_path):
    for n in range(3):
        rows(spark, ("a", n, f"v{n}"), (f"only{n}", n, "w")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(S.RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        S.stream_into(stream, store, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert held(store) == [("a", "v2"), ("only0", "w"), ("only1", "w"), ("only2", "w")] and len(store.batches()) == 3


def test_salts(spark):
    one = lambda *a: spark.range(1).select(S.salted(*[F.lit(x) for x in a]).alias("k")).first().k
    base = one("p", "m", "r", 512, 400)
    assert len({base, one("p", "m", "r", 512, None), one("p", "m", None, 512, 400), one("p", "mr", "", 512, 400), one("q", "m", "r", 512, 400)}) == 5 and one("p", "m", "r", 512, 400) == base
