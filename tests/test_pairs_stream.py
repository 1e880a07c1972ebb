"""Two streams of persons and vehicles against the batch job of the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinograph.operators import proposal as P
from kinograph.operators import series as O
from kinograph.streaming.late import LateRows
from kinograph.streaming.pairs import Follower, stream_pair_spans

OBS = "clip_id string, track_id int, frame int, x1 double, y1 double, x2 double, y2 double"
KEYS = ["clip_id", "p_id", "v_id"]


def walks(seed, frames=40):
    rng = np.random.default_rng(seed)
    out = []
    for clip in ("a", "b"):
        for track in (1, 2):
            x = rng.normal(size=frames) * 40 + rng.uniform(0, 20)
            out += [(clip, track, f, float(x[f]), 0.0, float(x[f]) + 10, 20.0) for f in range(frames) if rng.random() < 0.8]
    return out


def pieces(rows, order, seed):
    """Three runs of rows, by frame or mixed within eight frames."""
    at = np.array([r[2] for r in rows]) + (np.random.default_rng(seed).integers(0, 9, len(rows)) if order == "mixed" else 0)
    return np.array_split(np.argsort(at, kind="stable"), 3)


@pytest.mark.parametrize("order", ["in order", "mixed"])
def test_equals_the_batch_in_any_order_within_the_delay(spark, tmp_path, order):
    fps, n = 6.0, 44
    sides = {"p": walks(1), "v": walks(2)}
    clips = spark.createDataFrame([(c, fps, n) for c in "ab"], "clip_id string, fps double, n_frames int")
    series = P.pair_series(spark.createDataFrame(sides["p"], OBS), spark.createDataFrame(sides["v"], OBS), clips)
    expected = sorted((*[r[k] for k in KEYS], r.frame_start, r.frame_end, round(r.min_d, 9)) for r in O.contact_spans(series, KEYS, "d_norm", 0.3, 0.9).collect())
    assert len(expected) > 10
    schema = OBS + ", fps double, n_frames int, ts timestamp"
    timed = lambda rows: pd.DataFrame([(*r, fps, n, pd.Timestamp(1_000_000 + round(r[2] * 1e6 / fps), unit="us")) for r in rows], columns=[c.split()[0] for c in schema.split(", ")])
    late = sides["p"][0]
    streams = {}
    for side, rows in sides.items():
        end = timed([("end", 1, 0, 0.0, 0.0, 1.0, 1.0)]).assign(ts=pd.Timestamp(9000, unit="s"))
        parts = [timed([rows[k] for k in part]) for part in pieces(rows, order, 3)] + [end, end, timed([late]) if side == "p" else end, end]
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{side}/{k}")
        streams[side] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}/*")
    name, counted = f"spans{len(order)}", LateRows()
    spark.streams.addListener(counted)
    spans = stream_pair_spans(streams["p"], streams["v"].drop("fps", "n_frames"), 0.3, 0.9, delay="3 seconds")
    q = spans.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        progress = q.lastProgress
    finally:
        q.stop()
        spark.streams.removeListener(counted)
    got = sorted((*[r[k] for k in KEYS], r.frame_start, r.frame_end, round(r.min_d, 9)) for r in spark.table(name).where("clip_id <> 'end'").collect())
    assert got == expected
    assert counted.total(name) >= 1  # the row that came when all had been answered
    assert sum(o.numRowsTotal for o in progress.stateOperators) <= 8  # nothing of the ended clips is held


def test_frames_are_judged_when_their_window_is_complete():
    f = Follower(0.5, 1.0, 1, 10)
    f.add(0, 0.2), f.add(1, 0.2)
    assert f.judge(0) == [] and f.following == 0
    assert f.judge(1) == [] and (f.start, f.following) == (0, 1)
    f.add(2, 4.0)
    assert f.judge(3) == [(0, 0, 0.2)] and f.start is None  # 1.47 at frame 1
    f.add(8, 0.1)
    assert f.close() == [(7, 9, 0.1)]


def test_thresholds_have_to_be_apart(spark):
    df = spark.createDataFrame([], OBS)
    with pytest.raises(ValueError):
        stream_pair_spans(df, df, 0.5, 0.5)
