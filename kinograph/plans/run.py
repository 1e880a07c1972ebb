"""A run from detections to interactions and documents: tracks, pair series, contact spans, candidates, judgement, evidence."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.config import Config
from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.functions.text import CLASS_NAMES
from kinograph.operators import detections as D
from kinograph.operators import proposal as P
from kinograph.operators import series as O
from kinograph.plans import reports as R
from kinograph.session import Steps
from kinograph.sources import records
from kinograph.streaming import tracks as K

PAIR = ["clip_id", "p_id", "v_id"]
#: What a candidate's evidence says besides its rule.
EVIDENCE = ["min_d_norm", "dwell_s", "vehicle_is_static", "person_birth", "person_death", "birth_at_clip_start", "death_at_clip_end", "born_at_frame_edge", "died_at_frame_edge", "max_iou"]


class Run(NamedTuple):
    """inventory: a row a track; candidates with rules and evidence, judged; interactions: the accepted ones, numbered."""

    inventory: DataFrame
    candidates: DataFrame
    interactions: DataFrame


def class_name(cls: Column) -> Column:
    """The name of a class, its number where it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv]), cls), cls.cast("string"))


def inventory(tracks: DataFrame, clips: DataFrame) -> DataFrame:
    """Each track's life, class and motion, and whether its first and last box are at the picture's border."""
    keys = ["clip_id", "track_id"]
    box = F.struct("x1", "y1", "x2", "y2")
    ends = tracks.groupBy(*keys).agg(F.first("cls").alias("cls"), F.min_by(box, "frame").alias("a"), F.max_by(box, "frame").alias("b"))
    sized = D.track_inventory(tracks, keys).join(ends, keys).join(clips.select("clip_id", "width", "height"), "clip_id")
    edge = lambda e: B.at_edge(B.Box(*(F.col(f"{e}.{c}") for c in K.BOX)), F.col("width"), F.col("height"))
    return sized.withColumns({"born_at_frame_edge": edge("a"), "died_at_frame_edge": edge("b")}).drop("a", "b", "width", "height")


def propose(tracks: DataFrame, known: DataFrame, clips: DataFrame, config: Config, doors: DataFrame | None, steps: Steps) -> DataFrame:
    """Candidates of every person and vehicle that meet, with the evidence of their series and tracks.

    known: inventory() of the tracks. doors: clip_id, frame, door_x1..door_y2, door_conf; without it no door was looked for.
    """
    t = config.tunable
    person = F.col("cls") == 0
    series = steps.keep(P.pair_series(tracks.where(person), tracks.where(~person), clips, window_s=t.smooth_window_s))
    spans = O.contact_spans(series, PAIR, "d_norm", t.tau_near, t.tau_far)
    measured = series.select(*PAIR, "frame", "iou")
    if doors is None:
        measured = measured.withColumn("cue", F.lit(None).cast("double"))
    else:
        cue = D.door_cue(tracks.where(~person), doors).withColumnRenamed("track_id", "v_id")
        measured = measured.join(cue, ["clip_id", "v_id", "frame"], "left")
    inside = spans.select(*PAIR, "sid", "frame_start", "frame_end").join(measured, PAIR).where(F.col("frame").between(F.col("frame_start"), F.col("frame_end")))
    signal = inside.groupBy(*PAIR, "sid").agg(F.max("iou").alias("max_iou"), F.max("cue").alias("max_door"))
    of = lambda p, **more: known.select("clip_id", F.col("track_id").alias(p), *[F.col(c).alias(n) for n, c in more.items()])
    spans = spans.join(signal, [*PAIR, "sid"], "left").join(of("p_id", birth="birth", death="death", born_at_frame_edge="born_at_frame_edge", died_at_frame_edge="died_at_frame_edge"), ["clip_id", "p_id"])
    spans = spans.join(of("v_id", vehicle_is_static="static"), ["clip_id", "v_id"]).join(clips.select("clip_id", "fps", "n_frames"), "clip_id")
    found = P.candidates(P.fired(spans, t.min_dwell_s, t.door_conf_thresh), PAIR)
    return found.join(of("v_id", vehicle_cls="cls"), ["clip_id", "v_id"])


def clip_run(
    dets: DataFrame, clips: DataFrame, config: Config | None = None, doors: DataFrame | None = None, camera: DataFrame | None = None,
    judge: Callable[[DataFrame], DataFrame] = P.geometric_judge, steps: Steps | None = None,
) -> Run:
    """dets: clip_id, frame, cls, x1..y2, conf, down to the floor; clips: clip_id, width, height, fps, n_frames.

    judge adds rule, type and confidence to candidates, and may add accepted; one without a verdict (accepted NULL) is neither an
    interaction nor a rejection. Interactions are numbered in each clip by start, end, person and vehicle.
    """
    config, steps = config or Config(), steps or Steps(dets.sparkSession)
    # the tracker's rows are read by several joins
    tracks = steps.keep(K.track(dets, clips, config.tunable.det_conf, camera, steps=steps))
    known = steps.keep(inventory(tracks, clips))
    judged = judge(propose(tracks, known, clips, config, doors, steps))
    judged = steps.keep(judged if "accepted" in judged.columns else judged.withColumn("accepted", F.lit(True)))
    order = Window.partitionBy("clip_id").orderBy("frame_start", "frame_end", "p_id", "v_id")
    taken = judged.where("accepted").withColumn("_n", F.row_number().over(order)).join(clips.select("clip_id", "fps"), "clip_id")
    named = lambda kind: F.format_string(f"%s__{kind}%03d", F.col("clip_id").cast("string"), F.col("_n"))
    timed = {f"time_{x}_s": S.to_seconds(F.col(f"frame_{x}"), F.col("fps")) for x in ("start", "end")}
    out = taken.withColumns({"interaction_id": named("i"), "event_group_id": named("g"), **timed}).drop("_n", "fps", "accepted")
    for who in ("p", "v"):
        boxes = R.span_boxes(out.select("clip_id", F.col(f"{who}_id").alias("track_id"), "frame_start", "frame_end").distinct(), tracks.drop("cls"), clips)
        box = F.when(F.col("x1").isNotNull(), F.array(*K.BOX)).alias(f"{who}_box_norm")
        out = out.join(boxes.select("clip_id", F.col("track_id").alias(f"{who}_id"), "frame_start", "frame_end", box), ["clip_id", f"{who}_id", "frame_start", "frame_end"], "left")
    return Run(known, judged, out)


def _text(value: Column, kind: str) -> Column:
    return F.to_json(value) if kind.startswith(("array", "struct")) else value.cast("string")


def _evidence(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.map_from_entries(F.array(*[F.struct(F.lit(c), _text(F.col(c), kinds[c])) for c in columns]))


def documents(run: Run, clips: DataFrame, config: Config) -> DataFrame:
    """(name, value): each clip's document of interactions, and its debug document of tracks and candidates that weren't accepted.

    Both are lists of one clip; clips without any have empty ones. Clips are named by text, whatever their ids are.
    """
    as_text = lambda df: df.withColumn("clip_id", F.col("clip_id").cast("string"))
    run, clips = Run(*map(as_text, run)), as_text(clips)
    none, blank = F.lit(None).cast("map<string,string>").alias("attributes"), F.lit("").alias("description")
    rows = run.interactions.withColumns(
        {
            "config_hash": F.lit(config.hash),
            "person": F.struct(F.col("p_id").alias("track_id"), blank, none),
            "vehicle": F.struct(F.col("v_id").alias("track_id"), class_name(F.col("vehicle_cls")).alias("cls"), blank, none),
            "note": F.lit(""),
        }
    )
    rows = rows.withColumn("evidence", _evidence(rows, ["rule", *EVIDENCE, "p_box_norm", "v_box_norm"]))
    columns = ["clip_id", "config_hash", "interaction_id", "event_group_id", "type", "frame_start", "frame_end", "time_start_s", "time_end_s", "person", "vehicle", "note", "confidence", "evidence"]
    told = records.clip_documents(rows.select(columns), clips).select(F.concat(F.col("clip_id").cast("string"), F.lit(".json")).alias("name"), "value")

    track = F.struct(F.col("track_id").alias("id"), class_name(F.col("cls")).alias("cls"), "birth", "death", F.col("observed").alias("n_observed"), F.col("span").alias("span_frames"), "gap_frames", S.rounded(F.col("motion"), 4).alias("centroid_motion"), F.col("static").alias("is_static"))
    lives = run.inventory.groupBy("clip_id").agg(F.array_sort(F.collect_list(track)).alias("tracks"), F.count_if(F.col("cls") == 0).alias("n_person_tracks"), F.count_if(F.col("cls") != 0).alias("n_vehicle_tracks"))
    no = ~F.coalesce("accepted", F.lit(False))
    reason = F.when(F.col("accepted").isNull(), "could not judge").otherwise("rejected").alias("reason")
    refused = F.struct("frame_start", "frame_end", F.col("p_id").alias("person_id"), F.col("v_id").alias("vehicle_id"), "rules", _evidence(run.candidates, EVIDENCE).alias("evidence"), F.col("type").alias("verdict_type"), S.rounded(F.col("confidence"), 4).alias("verdict_confidence"), reason)
    listed = F.array_sort(F.collect_list(F.when(no, F.struct("frame_start", "frame_end", F.col("p_id").alias("p"), F.col("v_id").alias("v"), F.to_json(refused).alias("row")))))
    judged = run.candidates.groupBy("clip_id").agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"), F.transform(listed, lambda x: x["row"]).alias("rejected"))
    whole = clips.select("clip_id").join(lives, "clip_id", "left").join(judged, "clip_id", "left").fillna(0, ["n_person_tracks", "n_vehicle_tracks", "n_candidates", "n_accepted"])
    head = F.to_json(F.struct("clip_id", "n_person_tracks", "n_vehicle_tracks", "n_candidates", "n_accepted", F.coalesce("tracks", F.array()).alias("tracks")))
    # the rejected ones are JSON objects already, each with the fields that it has
    value = F.concat(F.left(head, F.length(head) - 1), F.lit(',"rejected":['), F.array_join(F.coalesce("rejected", F.array().cast("array<string>")), ","), F.lit("]}"))
    debug = whole.select(F.concat(F.col("clip_id").cast("string"), F.lit(".debug.json")).alias("name"), value.alias("value"))
    return told.unionByName(debug)
