"""JSON sources and sinks, configuration, streaming spans and tracks."""

import json

import pytest
from pyspark.sql import functions as F

from kinograph import config as C
from kinograph.sources import records as R
from kinograph.streaming.contacts import stream_contact_spans
from kinograph.streaming.tracks import track


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_clips_and_events(spark, tmp_path):
    got = R.clips(spark, put(tmp_path / "c.json", {"a": {"width": 4, "height": 2, "fps": 6.5, "n_frames": 9, "more": 1}})).collect()
    assert [tuple(r) for r in got] == [("a", 4, 2, 6.5, 9)]
    event = {"event_id": "e1", "clip_id": "a", "type": "pass_by", "frame_start": 1, "frame_end": 2}
    row = R.labelled_events(spark, put(tmp_path / "g.json", {"events": [event]})).first()
    assert (row.event_group_id, row.ambiguous, row.note, row.person_anchor) == ("e1", False, "", None)
    with pytest.raises(Exception, match="unknown type"):
        R.labelled_events(spark, put(tmp_path / "b.json", {"events": [event | {"type": "dance"}]})).collect()


def test_predictions_by_shape_and_back(spark, tmp_path):
    one = {"interaction_id": "a__i001", "type": "enter_vehicle", "frame_start": 1, "frame_end": 5, "person": {"track_id": 1}, "vehicle": {"track_id": 2, "class": "car"}}
    put(tmp_path / "a.json", {"clip_id": "a", "config_hash": "h", "interactions": [one]})
    put(tmp_path / "a.debug.json", {"clip_id": "a", "interactions": []})
    put(tmp_path / "broken.json", "{")
    put(tmp_path / "other.json", {"x": 1})
    rows, rejected = R.predictions(spark, f"{tmp_path}/*.json")
    got = rows.collect()
    assert [(r.clip_id, r.vehicle.cls, r.confidence, r.event_group_id) for r in got] == [("a", "car", 0.0, "a__i001")]
    assert rejected.count() == 3
    clips = spark.createDataFrame([("a", 4, 2, 6.5, 9), ("b", 4, 2, 6.5, 9)], "clip_id string, " + R.CLIP)
    docs = {r.clip_id: json.loads(r.value) for r in R.clip_documents(rows, clips).collect()}
    assert docs["a"]["interactions"][0]["vehicle"]["class"] == "car" and docs["b"]["interactions"] == []
    R.write_documents(R.clip_documents(rows, clips), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2


def test_rates_and_upserts(spark):
    rates = spark.createDataFrame([("30000/1001",), ("25",), ("x/1",), ("1/0",)], "r string").select(R.rate(F.col("r")).alias("v")).collect()
    assert [round(r.v, 2) if r.v is not None else None for r in rates] == [29.97, 25.0, None, None]
    cache = spark.createDataFrame([("k", "old"), ("l", "kept")], "key string, raw string")
    assert {tuple(r) for r in R.upsert(cache, spark.createDataFrame([("k", "new")], cache.schema)).collect()} == {("k", "new"), ("l", "kept")}


def test_config():
    base = C.Config()
    assert base.with_tunables(tau_near=0.06).hash != base.hash == C.load({}).hash == C.parse("").hash
    assert C.load({"tunable": {"tau_near": 0.06}}, {"tunable": {"tau_far": 0.3}}).tunable.tau_far == 0.3
    assert base.with_tunables(context_pad_s=2).hash == base.with_tunables(context_pad_s=2.0).hash
    for bad in ({"tau_near": 0.3}, {"tau_far": 0.9}, {"nothing": 1}, {"det_conf": "high"}, {"n_vlm_frames": True}):
        with pytest.raises(C.ConfigError):
            base.with_tunables(**bad)
    for bad in ({"nothing": 1}, {"vlm": {"temperature": 0.5}}, {"vlm": {"batch_size": 2}}, {"tracker": {"det_floor": 0.7}}, {"tracker": {"gmc": 3}}):
        with pytest.raises(C.ConfigError):
            C.load(bad)
    with pytest.raises(C.ConfigError, match="tau_far.*;.*below"):
        C.load({"tunable": {"tau_near": 0.4, "tau_far": 0.05}})
    with pytest.raises(C.ConfigError):
        C.parse("[1, 2]")


def test_configurations_as_text():
    pytest.importorskip("yaml")
    config = C.parse("tunable:\n  tau_near: 0.12\npaths:\n  outputs: there\n", {"tunable": {"n_vlm_frames": 8}})
    assert (config.tunable.tau_near, config.tunable.n_vlm_frames, config.paths.outputs, config.tracker.det_floor) == (0.12, 8, "there", 0.1)
    assert C.parse(C.dumped(config)).hash == config.hash


def test_streamed_spans(spark, tmp_path):
    rows = [(1, f, d, f) for f, d in enumerate([0.9, 0.05, 0.2, 0.2, 0.9, 0.01, 0.02])] + [(2, 0, 0.9, 0), (3, 0, 0.9, 4000)]
    df = spark.createDataFrame(rows, "pair_id long, frame long, d_norm double, s long").select("pair_id", "frame", "d_norm", F.timestamp_seconds("s").alias("ts"))
    for part, where in enumerate(["s < 3", "s between 3 and 100", "s > 100"]):
        df.where(where).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_contact_spans(stream, 0.1, 0.25, "1 minute").writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.pair_id, r.frame_start, r.frame_end) for r in spark.table("spans").collect())
    assert (1, 1, 3) in got and (1, 5, 6) in got and len(got) == 2


def test_tracks(spark):
    walk = [("c", f, 0, 10.0 + f, 0.0, 20.0 + f, 30.0, 0.9) for f in range(6) if f != 3]
    car = [("c", f, 2 if f < 4 else 7, 100.0, 0.0, 150.0, 40.0, 0.8) for f in range(6)]
    noise = [("c", 2, 0, 400.0, 0.0, 410.0, 30.0, 0.9)]
    dets = spark.createDataFrame(walk + car + noise, "clip_id string, frame int, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    clips = spark.createDataFrame([("c", 6.0)], "clip_id string, fps double")
    got = track(dets, clips).collect()
    assert {r.track_id for r in got} == {0, 10_000} and {r.cls for r in got if r.track_id} == {2}
    assert sorted(r.frame for r in got if r.track_id == 0) == [1, 2, 4, 5]  # the number comes with the second frame
