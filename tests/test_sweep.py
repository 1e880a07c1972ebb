"""The sweep's store: only what is missing is computed, and what has failed isn't there."""

import pytest
from pyspark.sql import functions as F

from kinograph.plans import sweep as W

KNOBS = ["det_conf", "tau"]


def grid(spark, *rows):
    return spark.createDataFrame(list(rows), "det_conf double, tau double")


def clips(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "clip_id string")


class Spy:
    """Computes rows for all clips but "empty", and remembers what it was asked for."""

    def __init__(self, fails=False):
        self.asked, self.fails = [], fails

    def __call__(self, todo):
        self.asked.append(sorted((r.clip_id, r.det_conf, r.tau) for r in todo.collect()))
        value = F.raise_error(F.lit("broken")).cast("double") if self.fails else F.col("tau") * 10
        return todo.where("clip_id <> 'empty'").select("clip_id", "judge", "digest", value.alias("value"))


@pytest.fixture
def store(spark, tmp_path):
    return W.Store(spark, f"file://{tmp_path}/store", "value double")


def test_a_second_sweep_computes_nothing(spark, store):
    spy, few = Spy(), grid(spark, (0.5, 0.1), (0.5, 0.2))
    assert W.sweep(store, clips(spark, "a", "b", "empty", "a"), few, KNOBS, "geometric", spy) == 6
    assert W.sweep(store, clips(spark, "a", "b", "empty"), few, KNOBS, "geometric", spy) == 0 and len(spy.asked) == 1
    assert sorted((r.clip_id, r.value) for r in store.rows().collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)]


def test_a_new_setting_clip_or_judge_computes_its_own_rows(spark, store):
    spy = Spy()
    W.sweep(store, clips(spark, "a", "b"), grid(spark, (0.5, 0.1)), KNOBS, "geometric", spy)
    assert W.sweep(store, clips(spark, "a", "b"), grid(spark, (0.5, 0.1), (0.5, 0.3)), KNOBS, "geometric", spy) == 2
    assert spy.asked[-1] == [("a", 0.5, 0.3), ("b", 0.5, 0.3)]
    assert W.sweep(store, clips(spark, "a", "c"), grid(spark, (0.5, 0.1), (0.5, 0.3)), KNOBS, "geometric", spy) == 2
    assert spy.asked[-1] == [("c", 0.5, 0.1), ("c", 0.5, 0.3)]
    assert W.sweep(store, clips(spark, "a"), grid(spark, (0.5, 0.1)), KNOBS, "model", spy) == 1
    asked = W.wanted(clips(spark, "a", "d"), grid(spark, (0.5, 0.1)), KNOBS, "model")
    assert [(r.clip_id, r.value) for r in W.results(store, asked).collect()] == [("a", 1.0)]
    assert [r.n for r in W.gaps(store, asked).collect()] == [1]


def test_a_sweep_that_fails_leaves_nothing(spark, store):
    with pytest.raises(Exception, match="broken"):
        W.sweep(store, clips(spark, "a"), grid(spark, (0.5, 0.1)), KNOBS, "geometric", Spy(fails=True))
    assert store.keys().count() == store.rows().count() == 0
    # rows without their keys, as of a driver that was lost between the two
    todo = W.missing(store, W.wanted(clips(spark, "a"), grid(spark, (0.5, 0.1)), KNOBS, "geometric"))
    with pytest.raises(Exception, match="broken"):
        store.add(todo.withColumn("setting", F.raise_error(F.lit("broken"))), Spy()(todo))
    assert store.rows().count() == 0
    assert W.sweep(store, clips(spark, "a"), grid(spark, (0.5, 0.1)), KNOBS, "geometric", Spy()) == 1
    assert [r.value for r in store.rows().collect()] == [1.0]


def test_two_sweeps_at_once_count_once(spark, store):
    todo = W.missing(store, W.wanted(clips(spark, "a"), grid(spark, (0.5, 0.1)), KNOBS, "geometric"))
    for _ in range(2):
        store.add(todo, Spy()(todo))
    assert store.keys().count() == store.rows().count() == 1


def test_setting_keys(spark):
    row = spark.range(1).select(W.setting_key({"b": F.lit(1), "a": 0.25}).alias("x"), W.setting_key({"a": F.lit(0.25), "b": 1.0}).alias("y")).first()
    assert row.x == row.y == '{"a": 0.25, "b": 1.0}'
    named = spark.range(1).select(W.digest(F.lit("j1"), F.lit("x")).alias("x"), W.digest(F.lit("j"), F.lit("1x")).alias("y")).first()
    assert named.x != named.y and len(named.x) == 16


def test_what_is_missing_is_found_once(spark, store):
    plans = []

    def compute(todo):
        plans.append(todo._jdf.queryExecution().toString())
        return todo.select("clip_id", "judge", "digest", (F.col("tau") * 10).alias("value"))

    assert W.sweep(store, clips(spark, "a", "b"), grid(spark, (0.5, 0.1)), KNOBS, "geometric", compute) == 2
    assert "Join" not in plans[0]  # each reader would join clips, settings and stored keys anew
