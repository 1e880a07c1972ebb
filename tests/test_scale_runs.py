"""Runs and streams at size: what is stored once, how files are dealt, and groups of clips that arrive one after another."""

import pytest

from kinograph import queries  # noqa: F401  (registers what the other module builds on)
from kinograph import queries_runs as Q
from kinograph.sources import documents as D

FOLDER = "/root/testdata/sf0.001"


def test_a_run_numbers_the_events_once(spark):
    run, clips = Q._run(spark, FOLDER)
    for df in (clips, run.inventory, run.candidates, run.interactions):
        assert "events.parquet" not in df._jdf.queryExecution().toString()


def test_debug_documents_are_read_with_the_others(spark, tmp_path):
    (tmp_path / "a.debug.json").write_text('{"clip_id": "a"}')
    (tmp_path / "b.json").write_text("[1]")
    assert {r.name: (r.status, r.value) for r in D.read_documents(spark, str(tmp_path)).collect()} == {"a.debug": ("debug", '{"clip_id": "a"}'), "b": ("other", None)}


def test_partitions_hold_a_number_of_files(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "PARTITION_FILES", 4)
    for k in range(10):
        (tmp_path / f"{k}.json").write_text("{}")
    assert [len(p.paths) for p in D.DocumentReader({"path": str(tmp_path)}).partitions()] == [4, 4, 2]


@pytest.mark.parametrize("together", [1, 4])
def test_spans_of_a_stream_do_not_depend_on_the_groups_in_which_clips_arrive(spark, monkeypatch, together):
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled")}
    expected = sorted(Q.streamed_pair_spans(spark, FOLDER).collect())
    monkeypatch.setattr(Q, "TOGETHER", together)
    assert sorted(Q.streamed_pair_spans(spark, FOLDER).collect()) == expected and expected
    assert settings == {k: spark.conf.get(k, None) for k in settings}
