"""Queries of tracking, streams, sweeps and stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinograph import fixtures as X
from kinograph.operators import camera as Z
from kinograph.operators import series as O
from kinograph.config import Config
from kinograph.plans import evaluation as E
from kinograph.plans import run as N
from kinograph.plans import sweep as W
from kinograph.registry import query
from kinograph.session import Steps, shared_dir
from kinograph.sources import documents as J
from kinograph.sources import records as R
from kinograph.sources import responses as Y
from kinograph.streaming import pairs as V
from kinograph.streaming import tracks as K

# --- tracking: every pair of the signal is an object that moves at its own speed; a seventh of its boxes is missing ---

X.SQL["planted"] = """planted AS (SELECT pair_id // 6 AS clip_id, pair_id, frame, CASE WHEN pair_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 7 ELSE 2 END AS cls,
    (300 * (pair_id % 6) + frame * (pair_id % 4 - 1.5))::DOUBLE AS x1, (50 + frame * (pair_id % 3))::DOUBLE AS y1, (300 * (pair_id % 6) + frame * (pair_id % 4 - 1.5) + 60)::DOUBLE AS x2, (50 + frame * (pair_id % 3) + 120)::DOUBLE AS y2,
    0.3::DOUBLE + (event_id % 70) / 100 AS conf FROM sig WHERE event_id % 7 <> 0)"""


def planted(spark, d, more=()):
    """(clip_id, pair_id, frame, cls, x1..y2, conf): six objects a clip, far apart; pair_id is the truth. more: columns of the signal."""
    p, f = F.col("pair_id"), F.col("frame")
    x, y = (300 * (p % 6) + f * (p % 4 - 1.5)).cast("double"), (50 + f * (p % 3)).cast("double")
    cls = F.when(p % 3 == 0, 0).when(F.col("event_id") % 5 == 0, 7).otherwise(2)
    rows = X.sig(spark, d).where("event_id % 7 <> 0")
    return rows.select(F.floor(p / 6).alias("clip_id"), "pair_id", "frame", cls.alias("cls"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 120).alias("y2"), (0.3 + (F.col("event_id") % 70) / 100).alias("conf"), *more)


# a track begins with a trusted box, gets its number in the next frame, and holds all that comes after
X.SQL["truth"] = """seen AS (SELECT *, cls = 0 AS person, lead(frame) OVER (PARTITION BY pair_id ORDER BY frame) AS nf FROM planted),
  begun AS (SELECT pair_id, min(frame + 1) AS first FROM seen WHERE conf >= 0.65 AND nf = frame + 1 GROUP BY 1),
  born AS (SELECT s.clip_id, s.person, s.pair_id, first, row_number() OVER (PARTITION BY s.clip_id, s.person ORDER BY first, conf DESC, x1, y1) - 1 + CASE WHEN person THEN 0 ELSE 10000 END AS track_id FROM seen s JOIN begun b ON b.pair_id = s.pair_id AND b.first = s.frame),
  followed AS (SELECT s.*, b.track_id FROM seen s JOIN born b ON b.pair_id = s.pair_id AND s.frame >= b.first),
  kinds AS (SELECT clip_id, track_id, cls FROM (SELECT clip_id, track_id, cls, count(*) AS n, min(frame) AS f FROM followed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY n DESC, f, cls) = 1)"""


@query("clip_id:l track_id:l cls:l frame:l x1:d y1:d x2:d y2:d", "sig planted truth", "SELECT f.clip_id, f.track_id, k.cls, f.frame, x1, y1, x2, y2 FROM followed f JOIN kinds k ON k.clip_id = f.clip_id AND k.track_id = f.track_id")
def tracked_objects(spark, d):
    # stored, so that the signal is numbered once and not for each reader
    dets = Steps(spark).keep(planted(spark, d))
    return K.track(dets, dets.select("clip_id", F.lit(25.0).alias("fps")).distinct())


# --- sweeps: each clip's spans under each setting are computed once and kept ---

KNOBS = ["det_conf", "tau_near", "tau_far"]


def _spans_of(spark, d):
    """The spans of the signal under the settings that are missing, for the clips that lack them."""

    def compute(todo):
        grid = sorted(tuple(r) for r in todo.select(*KNOBS).distinct().collect())  # as many as the grid has
        settings = spark.createDataFrame([(k, *r) for k, r in enumerate(grid)], "pos int, det_conf double, tau_near double, tau_far double")
        sig = X.sig(spark, d).withColumn("clip_id", F.col("pair_id").cast("string")).withColumn("conf", 0.3 + (F.col("event_id") % 70) / 100)
        sig = sig.join(todo.select("clip_id").distinct(), "clip_id", "left_semi")
        spans = O.contact_spans_grid(sig, ["clip_id"], "d_norm", [(k, near, far, conf) for k, (conf, near, far) in enumerate(grid)], "conf")
        return spans.join(F.broadcast(settings), "pos").join(todo, ["clip_id", *KNOBS]).select("clip_id", "judge", "digest", "sid", "frame_start", "frame_end", "min_d")

    return compute


def _store(spark):
    return W.Store(spark, shared_dir(spark), "sid long, frame_start long, frame_end long, min_d double")


def _signal_clips(spark, d):
    return X.sig(spark, d).select(F.col("pair_id").cast("string").alias("clip_id")).distinct()


@query(
    "run:s computed:l stored:l", "sig gt grid loco",
    """SELECT run, n * m AS computed, (SELECT count(*) FROM sps WHERE pos < upto) AS stored FROM (SELECT count(DISTINCT pair_id) AS n FROM sig), (VALUES ('a few', 20, 20), ('all', 25, 45), ('again', 0, 45)) r(run, m, upto)""",
)
def sweep_runs(spark, d):
    """What three sweeps over one store compute: some settings, all, and all again."""
    store, grid, clips = _store(spark), E.settings_grid(spark), _signal_clips(spark, d)
    out = []
    for run, settings in (("a few", grid.where("pos < 20")), ("all", grid), ("again", grid)):
        out.append((run, W.sweep(store, clips, settings, KNOBS, "geometric", _spans_of(spark, d)), store.rows().count()))
    return spark.createDataFrame(out, "run string, computed long, stored long")


@query("fold:l pos:l tp:l fp:l fn:l fit_f1:d", "sig gt grid loco", "SELECT * FROM folds")
def rescored_folds(spark, d):
    """Held-out settings from stored spans: the store is filled in two sweeps, and scoring reads it."""
    store, grid, clips = _store(spark), E.settings_grid(spark), _signal_clips(spark, d)
    for settings in (grid.where("det_conf < 0.5"), grid):
        W.sweep(store, clips, settings, KNOBS, "geometric", _spans_of(spark, d))
    stored = W.results(store, W.wanted(clips, grid, KNOBS, "geometric")).join(F.broadcast(grid), KNOBS).withColumn("pair_id", F.col("clip_id").cast("long"))
    counts = E.setting_counts(X.pred_of(stored), X.gt(spark, d), clips.select(F.col("clip_id").cast("long").alias("clip_id")), grid)
    return E.leave_one_out(counts)


# --- documents: a JSON file a clip, written all or none, read back by shape ---


def _interactions(spark, d):
    """The predicted spans as a clip document's interactions."""
    clip, number = F.col("clip_id").cast("string"), F.format_string("%s__i%03d", F.col("clip_id").cast("string"), F.col("pred_id"))
    subject = F.struct(F.lit(1).alias("track_id"), F.lit("").alias("description"), F.lit(None).cast("map<string,string>").alias("attributes"))
    vehicle = F.struct(F.lit(10_000).alias("track_id"), F.lit("car").alias("cls"), F.lit("").alias("description"), F.lit(None).cast("map<string,string>").alias("attributes"))
    return X.pred(spark, d).select(
        clip.alias("clip_id"), F.lit("h").alias("config_hash"), number.alias("interaction_id"), number.alias("event_group_id"), "type", F.col("frame_start").cast("int"), F.col("frame_end").cast("int"),
        (F.col("frame_start") / 25).alias("time_start_s"), (F.col("frame_end") / 25).alias("time_end_s"), subject.alias("person"), vehicle.alias("vehicle"), F.lit("").alias("note"), F.col("px1").alias("confidence"), F.create_map(F.lit("rule"), F.lit("R1_dwell")).alias("evidence"),
    )


@query(
    "name:s status:s clip:s interactions:l frames:l confidence:d", "sig pred clips",
    """SELECT CASE WHEN clip_id % 10 = 4 THEN 'of_' || clip_id ELSE clip_id::VARCHAR END AS name, CASE clip_id % 10 WHEN 3 THEN 'damaged' WHEN 4 THEN 'mismatch' WHEN 5 THEN 'other' ELSE 'document' END AS status, CASE WHEN clip_id % 10 NOT IN (3, 5) THEN clip_id::VARCHAR END AS clip,
         CASE WHEN clip_id % 10 NOT IN (3, 5) THEN n END AS interactions, CASE WHEN clip_id % 10 NOT IN (3, 5) THEN f END AS frames, CASE WHEN clip_id % 10 NOT IN (3, 5) THEN p END AS confidence
       FROM clips LEFT JOIN (SELECT clip_id, count(*) AS n0, sum(frame_end - frame_start + 1) AS f0, max(px1) AS p FROM pred GROUP BY 1) USING (clip_id), LATERAL (SELECT coalesce(n0, 0) AS n, coalesce(f0, 0) AS f) WHERE clip_id % 10 <> 6
       UNION ALL SELECT clip_id::VARCHAR, 'missing', NULL, NULL, NULL, NULL FROM clips WHERE clip_id % 10 IN (4, 6)""",
)
def stored_documents(spark, d):
    """Documents of all clips, written and read back: some damaged, of another shape, named after another clip, or missing."""
    clips = X.clips(spark, d).withColumn("number", F.col("clip_id")).withColumn("clip_id", F.col("clip_id").cast("string"))
    docs = R.clip_documents(_interactions(spark, d), clips).join(clips.select("clip_id", "number"), "clip_id").where("number % 10 <> 6")
    k = F.col("number") % 10
    name = F.concat(F.when(k == 4, "of_").otherwise(""), "clip_id", F.lit(".json"))
    text = F.when(k == 3, F.left("value", F.lit(20))).when(k == 5, F.lit('{"clips": []}')).otherwise(F.col("value"))
    folder = shared_dir(spark)
    J.write_documents(docs.select(name.alias("name"), text.alias("value")), folder)
    files = J.with_missing(J.read_documents(spark, folder), clips).withColumn("d", F.from_json("value", R.DOCUMENT))
    length = F.aggregate("d.interactions", F.lit(0).cast("long"), lambda a, i: a + i["frame_end"] - i["frame_start"] + 1)
    most = F.array_max(F.transform("d.interactions", lambda i: i["confidence"]))
    known = F.col("d").isNotNull()
    return files.select("name", "status", F.col("clip_id").alias("clip"), F.when(known, F.size("d.interactions")).alias("interactions"), F.when(known, length).alias("frames"), F.when(known, most).alias("confidence"))


# --- streams: persons and vehicles arrive apart; the first batch job's rows are what the stream has to give ---

_HALF = "CASE WHEN greatest(3, round_even(0.4::DOUBLE * fps, 0))::INT // 2 = {} THEN avg(d) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {} PRECEDING AND {} FOLLOWING) END"
X.SQL["apart"] = f"""apart AS (SELECT a.clip_id, a.frame, coalesce({", ".join(_HALF.format(h, h, h) for h in (1, 5, 6))}) AS d_norm FROM (
    SELECT a.clip_id, a.frame, a.fps, CASE WHEN p.frame IS NOT NULL AND v.frame IS NOT NULL THEN sqrt(greatest(v.x1 - p.x2, p.x1 - v.x2, 0) ** 2 + greatest(v.y1 - p.y2, p.y1 - v.y2, 0) ** 2) / sqrt((v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2) END AS d
    FROM (SELECT clip_id, fps, unnest(range(n_frames)) AS frame FROM clips) a LEFT JOIN det p ON p.clip_id = a.clip_id AND p.frame = a.frame AND p.cls = 1 LEFT JOIN det v ON v.clip_id = a.clip_id AND v.frame = a.frame AND v.cls = 2) a)"""
X.SQL["apart_spans"] = X.spans_sql("apart_spans", "2.0", "4.0", "apart", "clip_id")


#: The clips that begin at one time: so many bound what a stream's state holds, however many clips there are.
TOGETHER = 20_000
#: Seconds from one beginning to the next: more than the delay and the longest clip.
APART_S = 7200


def _arrivals(spark, rows, folder: str, sides: dict[str, int], starts: int):
    """Streams of rows (cls tells the side, start the group of clips) by side, and a generator that lets one group after the other
    arrive, then two late rows a side: the first moves the watermark past all rows, and the batch of the second sees that."""
    ready = f"{folder}/ready"
    rows.withColumn("track_id", F.col("cls")).write.partitionBy("start", "cls").parquet(ready)
    kinds = rows.withColumn("track_id", F.col("cls")).drop("start", "cls").schema
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(ready).getFileSystem(spark._jsc.hadoopConfiguration())
    for side, cls in sides.items():
        files.mkdirs(path(f"{folder}/{side}"))
        for k in (starts, starts + 1):
            last = spark.read.schema(rows.withColumn("track_id", F.col("cls")).schema).parquet(ready).where(f"cls = {cls} and start < {starts}").limit(1).drop("start", "cls")
            last.withColumns({"clip_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit((starts + 10) * APART_S))}).coalesce(1).write.parquet(f"{ready}/start={k}/cls={cls}")

    def arrive():
        for k in range(starts + 2):
            for side, cls in sides.items():
                if files.exists(path(f"{ready}/start={k}/cls={cls}")):
                    files.rename(path(f"{ready}/start={k}/cls={cls}"), path(f"{folder}/{side}/{k}"))
            yield k

    return {side: spark.readStream.schema(kinds).parquet(f"{folder}/{side}/*") for side in sides}, arrive()


def _started(writer):
    """The stream, started: what a batch ends goes with the next batch of rows, without one of no rows between them, and there is a
    partition of state a core, as a group of clips is bounded. The session's own settings stay."""
    spark = writer._spark
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return writer.start()  # takes the settings with it
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query("clip_id:l frame_start:l frame_end:l min_d:d", "det clips apart apart_spans", "SELECT clip_id, frame_start, frame_end, min_d FROM apart_spans")
def streamed_pair_spans(spark, d):
    """Contact spans of the first two classes of each clip, by a join of two streams; the result is read from the stream's files."""
    clips = X.clips(spark, d).select("clip_id", "fps", "n_frames")
    starts = max(2, -(-clips.count() // TOGETHER))
    start = F.pmod(F.hash("clip_id"), F.lit(starts))
    # frames beyond a clip's end have no part in its spans
    seen = X.det(spark, d).where("cls in (1, 2)").join(clips, "clip_id").where("frame < n_frames").withColumn("start", start)
    seen = seen.withColumn("ts", F.timestamp_micros((1e9 + F.col("start") * APART_S * 1e6 + F.col("frame") * 1e6 / F.col("fps")).cast("long")))
    seen = seen.select("clip_id", "cls", F.col("frame").cast("int").alias("frame"), "x1", "y1", "x2", "y2", "ts", "fps", "n_frames", "start")
    folder = shared_dir(spark)
    streams, arrive = _arrivals(spark, seen, folder, {"persons": 1, "vehicles": 2}, starts)
    spans = V.stream_pair_spans(streams["persons"], streams["vehicles"].drop("fps", "n_frames"), 2.0, 4.0, delay="1 hour")
    run = None
    try:
        for _ in arrive:
            run = run or _started(spans.writeStream.format("parquet").option("path", f"{folder}/spans").option("checkpointLocation", f"{folder}/checkpoint"))
            run.processAllAvailable()
    finally:
        if run is not None:
            run.stop()
    return spark.read.schema(spans.schema).parquet(f"{folder}/spans").where("clip_id >= 0")


# --- a whole run: planted detections and doors to interactions with all their evidence ---

RUN = Config().with_tunables(tau_near=0.40, tau_far=0.80, min_dwell_s=0.5)
X.SQL["runclips"] = "runclips AS (SELECT clip_id, 1920 AS width, 1080 AS height, 25.0::DOUBLE AS fps, (max(frame) + 11)::INT AS n_frames FROM close GROUP BY 1)"
# persons are moved next to the vehicle after them, so that they meet
X.SQL["close"] = """close AS (SELECT clip_id, pair_id, frame, cls, x1 + CASE WHEN cls = 0 THEN 230 ELSE 0 END AS x1, y1, x2 + CASE WHEN cls = 0 THEN 230 ELSE 0 END AS x2, y2, conf FROM planted)"""
X.SQL["truth_close"] = X.SQL["truth"].replace("FROM planted", "FROM close")
_GAP = "greatest(v.x1 - p.x2, p.x1 - v.x2, 0) ** 2 + greatest(v.y1 - p.y2, p.y1 - v.y2, 0) ** 2"
_MEET = "greatest(0, least(p.x2, v.x2) - greatest(p.x1, v.x1)) * greatest(0, least(p.y2, v.y2) - greatest(p.y1, v.y1))"
_EDGE = lambda f: f"{f}(x1, frame) <= 21.6 OR {f}(y1, frame) <= 21.6 OR {f}(x2, frame) >= 1920 - 21.6 OR {f}(y2, frame) >= 1080 - 21.6"
_SHARE = lambda who: ", ".join(f"printf('%.5f', {f}({c}) / {side}.0)::DOUBLE AS {who}{c}" for f, c, side in (("min", "x1", 1920), ("min", "y1", 1080), ("max", "x2", 1920), ("max", "y2", 1080)))
X.SQL["run"] = (
    f"""trk AS (SELECT f.clip_id, f.track_id, f.person, k.cls, frame, x1, y1, x2, y2 FROM followed f JOIN kinds k ON k.clip_id = f.clip_id AND k.track_id = f.track_id),
  inv AS (SELECT clip_id, track_id, any_value(cls) AS cls, min(frame) AS birth, max(frame) AS death, CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(stddev_pop((x1 + x2) / 2) ** 2 + stddev_pop((y1 + y2) / 2) ** 2) / avg(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) END < 0.05 AS static,
    {_EDGE("arg_min")} AS born_edge, {_EDGE("arg_max")} AS died_edge FROM trk GROUP BY 1, 2),
  met AS (SELECT p.clip_id, p.track_id AS p_id, v.track_id AS v_id, p.frame, sqrt({_GAP}) / sqrt((v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2) AS d, {_MEET} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (v.x2 - v.x1) * (v.y2 - v.y1) - {_MEET}) AS iou FROM trk p JOIN trk v ON p.clip_id = v.clip_id AND p.frame = v.frame WHERE p.person AND NOT v.person),
  axis AS (SELECT k.*, unnest(range(n_frames)) AS frame FROM (SELECT DISTINCT clip_id, p_id, v_id FROM met) k JOIN runclips USING (clip_id)),
  pser AS (SELECT a.*, iou, avg(d) OVER (PARTITION BY a.clip_id, a.p_id, a.v_id ORDER BY a.frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS d_norm FROM axis a LEFT JOIN met m ON m.clip_id = a.clip_id AND m.p_id = a.p_id AND m.v_id = a.v_id AND m.frame = a.frame),"""
    + X.spans_sql("rsp", "0.40", "0.80", "pser", "clip_id, p_id, v_id")
    + """,
  doors AS (SELECT c.clip_id, c.frame, x1 + 5 AS x1, y1 + 40 AS y1, x1 + 30 AS x2, y1 + 100 AS y2, (event_id % 100) / 100 AS conf FROM close c JOIN sig s ON s.pair_id = c.pair_id AND s.frame = c.frame WHERE cls <> 0 AND event_type = 'purchase'),
  cue AS (SELECT v.clip_id, v.track_id, v.frame, max(o.conf) AS cue FROM trk v JOIN doors o ON v.clip_id = o.clip_id AND v.frame = o.frame WHERE NOT v.person AND greatest(0, least(v.x2, o.x2) - greatest(v.x1, o.x1)) * greatest(0, least(v.y2, o.y2) - greatest(v.y1, o.y1)) / ((o.x2 - o.x1) * (o.y2 - o.y1)) >= 0.5 GROUP BY ALL),
  said AS (SELECT r.clip_id, r.p_id, r.v_id, r.sid, max(iou) AS mi, max(cue) AS door FROM rsp r JOIN pser s ON s.clip_id = r.clip_id AND s.p_id = r.p_id AND s.v_id = r.v_id AND s.frame BETWEEN r.frame_start AND r.frame_end LEFT JOIN cue c ON c.clip_id = r.clip_id AND c.track_id = r.v_id AND c.frame = s.frame GROUP BY 1, 2, 3, 4),
  hit AS (SELECT r.*, mi, p.birth, p.death, p.born_edge, p.died_edge, v.static, v.cls, n_frames, list_filter([CASE WHEN (r.frame_end - r.frame_start + 1) / 25.0 >= 0.5 THEN 'R1_dwell' END, CASE WHEN abs(p.death - r.frame_end) <= 9 THEN 'R2_death_near' END, CASE WHEN abs(p.birth - r.frame_start) <= 9 THEN 'R3_birth_near' END, CASE WHEN door >= 0.3 THEN 'R4_door_change' END], lambda x: x IS NOT NULL) AS rules
    FROM rsp r JOIN said s USING (clip_id, p_id, v_id, sid) JOIN inv p ON p.clip_id = r.clip_id AND p.track_id = r.p_id JOIN inv v ON v.clip_id = r.clip_id AND v.track_id = r.v_id JOIN runclips c ON c.clip_id = r.clip_id),
  taken AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_start, frame_end, p_id, v_id) AS n FROM hit WHERE len(rules) > 0),"""
    + f"""
  pbox AS (SELECT t.clip_id, n, {_SHARE("p")} FROM taken t JOIN trk k ON k.clip_id = t.clip_id AND k.track_id = t.p_id AND k.frame BETWEEN t.frame_start AND t.frame_end GROUP BY 1, 2),
  vbox AS (SELECT t.clip_id, n, {_SHARE("v")} FROM taken t JOIN trk k ON k.clip_id = t.clip_id AND k.track_id = t.v_id AND k.frame BETWEEN t.frame_start AND t.frame_end GROUP BY 1, 2)"""
)
_FIRST = "CASE WHEN list_contains(rules, 'R2_death_near') THEN 'R2_death_near' WHEN list_contains(rules, 'R3_birth_near') THEN 'R3_birth_near' WHEN list_contains(rules, 'R4_door_change') THEN 'R4_door_change' ELSE 'R1_dwell' END"


def _run(spark, d):
    steps = Steps(spark)
    moved = F.when(F.col("cls") == 0, 230).otherwise(0)
    # stored, both: a run reads them in many joins, and each would number all events again
    dets = steps.keep(planted(spark, d, ["event_type", "event_id"]).withColumns({"x1": F.col("x1") + moved, "x2": F.col("x2") + moved}))
    clips = dets.groupBy("clip_id").agg((F.max("frame") + 11).cast("int").alias("n_frames")).withColumns({"width": F.lit(1920), "height": F.lit(1080), "fps": F.lit(25.0)})
    clips = steps.keep(clips)
    opened = dets.where("cls <> 0 and event_type = 'purchase'")
    doors = opened.select("clip_id", "frame", (F.col("x1") + 5).alias("door_x1"), (F.col("y1") + 40).alias("door_y1"), (F.col("x1") + 30).alias("door_x2"), (F.col("y1") + 100).alias("door_y2"), ((F.col("event_id") % 100) / 100).alias("door_conf"))
    return N.clip_run(dets.drop("pair_id", "event_type", "event_id"), clips, RUN, doors, steps=steps), clips


@query(
    "interaction_id:s event_group_id:s type:s rule:s rules:s frame_start:l frame_end:l time_start_s:d time_end_s:d p_id:l v_id:l vehicle_cls:l confidence:d min_d_norm:d dwell_s:d max_iou:d vehicle_is_static:b person_birth:l person_death:l birth_at_clip_start:b death_at_clip_end:b born_at_frame_edge:b died_at_frame_edge:b px1:d py1:d px2:d py2:d vx1:d vy1:d vx2:d vy2:d",
    "sig planted close runclips truth_close run",
    f"""SELECT printf('%d__i%03d', clip_id, n) AS interaction_id, printf('%d__g%03d', clip_id, n) AS event_group_id, CASE rule WHEN 'R1_dwell' THEN 'attend_vehicle' WHEN 'R2_death_near' THEN 'enter_vehicle' WHEN 'R3_birth_near' THEN 'exit_vehicle' ELSE 'open_close_door' END AS type, rule, list_aggregate(list_sort(rules), 'string_agg', ',') AS rules,
       frame_start, frame_end, round(frame_start / 25.0, 3) AS time_start_s, round(frame_end / 25.0, 3) AS time_end_s, p_id, v_id, cls AS vehicle_cls, 0.5 AS confidence, printf('%.4f', min_d)::DOUBLE AS min_d_norm, round((frame_end - frame_start + 1) / 25.0, 3) AS dwell_s, printf('%.4f', mi)::DOUBLE AS max_iou, static AS vehicle_is_static,
       birth AS person_birth, death AS person_death, birth <= 9 AS birth_at_clip_start, death >= n_frames - 1 - 9 AS death_at_clip_end, born_edge AS born_at_frame_edge, died_edge AS died_at_frame_edge, px1, py1, px2, py2, vx1, vy1, vx2, vy2
       FROM (SELECT *, {_FIRST} AS rule FROM taken) JOIN pbox USING (clip_id, n) JOIN vbox USING (clip_id, n)""",
)
def clip_run(spark, d):
    """Everything a run says of its interactions, from detections and doors."""
    run, _ = _run(spark, d)
    boxes = {f"{who}{c}": F.get(f"{who}_box_norm", F.lit(k)) for who in "pv" for k, c in enumerate(("x1", "y1", "x2", "y2"))}
    return run.interactions.withColumns(boxes | {"rules": F.array_join("rules", ",")})


@query(
    "name:s n_tracks:l n_candidates:l n_interactions:l first:s", "sig planted close runclips truth_close run",
    """SELECT clip_id::VARCHAR AS name, (SELECT count(*) FROM inv i WHERE i.clip_id = c.clip_id) AS n_tracks, count(t.n) AS n_candidates, count(t.n) AS n_interactions, CASE WHEN count(t.n) > 0 THEN printf('%d__i001', clip_id) END AS first FROM runclips c LEFT JOIN taken t USING (clip_id) GROUP BY clip_id""",
)
def run_documents(spark, d):
    """A run's documents, written to a folder and read back: both of each clip."""
    run, clips = _run(spark, d)
    folder = shared_dir(spark)
    # dealt by number: files are small, and Spark would put thousands of them into one task by their size
    J.write_documents(N.documents(run, clips, RUN).repartition(2 * spark.sparkContext.defaultParallelism), folder)
    # stored, so that each file is opened once
    files = Steps(spark).keep(J.read_documents(spark, folder).select("name", "status", "clip_id", "value", "path"))
    told = J.pooled_documents(J.with_missing(files, clips), R.DOCUMENT).select("name", F.size("document.interactions").alias("n_interactions"), F.get("document.interactions", F.lit(0))["interaction_id"].alias("first"))
    debug = files.where("status = 'debug'").select(F.from_json("value", "clip_id string, n_candidates long, tracks array<struct<id: int>>, rejected array<struct<reason: string>>").alias("d"))
    return told.join(debug.select(F.col("d.clip_id").alias("name"), F.size("d.tracks").alias("n_tracks"), "d.n_candidates"), "name")


# --- responses: batches of a keyed store, some repeated, some older than what they meet ---


@query(
    "event_id:l raw:s batch:s rows_kept:l", "",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'second ' ELSE 'first ' END || event_id AS raw, CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'first' END AS batch, (SELECT count(*) FROM events) AS rows_kept FROM events""",
)
def upserted_responses(spark, d):
    """Each event's response from a store: a first batch, a later one of a third of the keys that is written twice, a compaction, and one
    that is older than both."""
    events = X.sig(spark, d).select("event_id")
    store = Y.Responses(spark, shared_dir(spark))

    def put(rows, batch: str, at: int):
        text = F.concat(F.lit(f"{batch} "), F.col("event_id").cast("string"))
        key = Y.salted(F.col("event_id").cast("string"), F.lit("model"), F.lit("1"), F.lit(512), F.lit(None))
        columns = {"key": key, "at": F.timestamp_seconds(F.lit(at)), "model_id": F.lit("model"), "revision": F.lit("1"), "max_pixels_per_frame": F.lit(None).cast("int"), "frame_indices": F.array(F.lit(0)), "raw": text, "parsed": F.lit(batch)}
        store.append(rows.withColumns(columns), batch)

    put(events, "first", 100)
    for _ in range(2):
        put(events.where("event_id % 3 = 0"), "second", 200)
    store.compact()
    put(events.where("event_id % 5 = 0"), "older", 50)
    kept = store.read()
    n = kept.agg(F.count("*").alias("rows_kept"))
    return kept.join(F.broadcast(n)).select(F.split_part("raw", F.lit(" "), F.lit(2)).cast("long").alias("event_id"), "raw", F.col("parsed").alias("batch"), "rows_kept")


# --- camera motion: a grid of points of each planted homography; every fifth point of the second frame is somewhere else ---

_GRID = 36
X.SQL["shaken"] = "shaken AS (SELECT vec_id AS clip_id, [1 + 0.1 * embedding[1]::DOUBLE, 0.1 * embedding[2]::DOUBLE, 10 * embedding[3]::DOUBLE, 0.1 * embedding[4]::DOUBLE, 1 + 0.1 * embedding[5]::DOUBLE, 10 * embedding[6]::DOUBLE] AS h FROM embeddings)"


def _shaken(spark, d):
    """Points of two frames a second apart, of one clip for each planted homography."""
    k = F.col("k")
    rows = X.homographies(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1))))
    rows = rows.select(F.col("vec_id").alias("clip_id"), "h", k.alias("point_id"), (100 * (k % 6)).cast("double").alias("x"), (80 * F.floor(k / 6)).cast("double").alias("y"))
    at = lambda i: F.get("h", F.lit(i))
    away = F.when(F.col("point_id") % 5 == 4, 40 + 7 * (F.col("point_id") % 11)).otherwise(0)
    first = rows.select("clip_id", F.lit(0).alias("frame"), "point_id", "x", "y")
    second = rows.select("clip_id", F.lit(25).alias("frame"), "point_id", (at(0) * F.col("x") + at(1) * F.col("y") + at(2) + away).alias("x"), (at(3) * F.col("x") + at(4) * F.col("y") + at(5) - 2 * away).alias("y"))
    clips = rows.select("clip_id").distinct().withColumns({"fps": F.lit(25.0), "n_frames": F.lit(26), "width": F.lit(1280)})
    return first.unionByName(second), clips


@query(
    "clip_id:l frame_a:l frame_b:l h00:d h01:d h02:d h10:d h11:d h12:d n_matches:l n_inliers:l ok:b", "shaken",
    """SELECT clip_id, 0 AS frame_a, 25 AS frame_b, h[1] AS h00, h[2] AS h01, h[3] AS h02, h[4] AS h10, h[5] AS h11, h[6] AS h12, 36 AS n_matches, 29 AS n_inliers, true AS ok FROM shaken""",
)
def camera_motion(spark, d):
    """The homography of each clip's sampled frames, found again from points of which a fifth is wrong."""
    points, clips = _shaken(spark, d)
    found = Z.homographies(Z.lagged_points(points, Z.sampled_pairs(clips)))
    # + 0.0: no negative zeros
    return found.withColumns({f"h{i}{j}": F.round(F.get("h", F.lit(3 * i + j)), 6) + 0.0 for i in (0, 1) for j in (0, 1, 2)})


@query(
    "clip_id:l pairs:l estimated:l median_shift:d static:b", "shaken",
    "SELECT clip_id, 1 AS pairs, 1 AS estimated, sqrt(h[3] ** 2 + h[6] ** 2) AS median_shift, sqrt(h[3] ** 2 + h[6] ** 2) / 1280 < 0.004 AS static FROM shaken",
)
def motion_report(spark, d):
    points, clips = _shaken(spark, d)
    return Z.motion_report(Z.homographies(Z.lagged_points(points, Z.sampled_pairs(clips))), clips)
