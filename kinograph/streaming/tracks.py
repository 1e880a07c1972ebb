"""Tracks from detections, frame by frame: boxes move at constant velocity, and each frame's boxes are assigned in two passes.

Trusted detections are assigned first, then the others to the tracks that are left, so that a track outlives weak detections; an
assignment is the one-to-one choice with the greatest total overlap of boxes and predicted boxes. Persons and vehicles are tracked
apart. What is held of a clip is its live tracks, in a batch job as in a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions.assignment import heaviest_pairs
from kinograph.session import Steps, ship_package

#: Vehicles' numbers begin here, so that they can't meet persons'.
VEHICLES_FROM = 10_000
BOX = ["x1", "y1", "x2", "y2"]
#: Standard deviations as shares of a box's height: of a measured place, and of a frame's change of place and of velocity.
PLACE, VELOCITY = 1 / 20, 1 / 160
#: Up to so many pairs of boxes are compared one by one, and more by arrays.
FEW = 64


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    return inter / np.maximum(area(a)[:, None] + area(b)[None] - inter, 1e-12)


def _area(box: list[float]) -> float:
    w, h = box[2] - box[0], box[3] - box[1]
    return (0.0 if w < 0 else w) * (0.0 if h < 0 else h)


def _pairs(boxes: list, predicted: list, least: float) -> list[tuple[int, int]]:
    """heaviest_pairs() of the boxes' overlaps, which are taken one by one where they are few. Where no two pairs of enough overlap
    share a box, they are the choice themselves."""
    if not boxes or not predicted:
        return []
    few = len(boxes) * len(predicted) <= FEW and least > 0
    if few:
        enough = []
        areas = [_area(p) for p in predicted]
        for i, box in enumerate(boxes):
            own = _area(box)
            for k, p in enumerate(predicted):
                w, h = (box[2] if box[2] < p[2] else p[2]) - (box[0] if box[0] > p[0] else p[0]), (box[3] if box[3] < p[3] else p[3]) - (box[1] if box[1] > p[1] else p[1])
                if w > 0 and h > 0 and w * h / max(own + areas[k] - w * h, 1e-12) >= least:
                    enough.append((i, k))
    else:
        iou = _iou(np.array(boxes, float), np.array(predicted, float))
        enough = list(zip(*(x.tolist() for x in np.nonzero(iou >= least))))
    if len({i for i, _ in enough}) == len(enough) == len({k for _, k in enough}) and least > 0:
        return enough
    return heaviest_pairs(_iou(np.array(boxes, float), np.array(predicted, float)) if few else iou, least)


class Tracker:
    """The live tracks of one clip and kind.

    Of each track: its number (-1 until it has been seen in `least_seen` frames after each other), last frame, frames seen after
    each other, filtered place and velocity of its box (centre and size), and their covariance (place, both, velocity) in squared
    box heights. A track ends when it hasn't been seen for more than `lost_after` frames, one without a number when it misses one.
    Most frames have a few boxes, so that tracks are lists of numbers and not columns of arrays.
    """

    def __init__(self, lost_after: int, trusted: float, least_iou: tuple[float, float] = (0.2, 0.5), least_seen: int = 2):
        self.lost_after, self.trusted, self.least_iou, self.least_seen = lost_after, trusted, least_iou, least_seen
        self.following = 0
        #: number, last, streak, place (x, y, w, h), velocity (x, y, w, h), covariance (pp, pv, vv)
        self.tracks: list[list] = []

    def _predict(self, frame: int) -> None:
        for t in self.tracks:
            dt = float(frame - t[1])
            pp, pv, vv = t[11:]
            for k in (3, 4, 5, 6):
                t[k] += dt * t[k + 4]
            t[11:] = pp + 2 * dt * pv + dt * dt * vv + dt * PLACE**2, pv + dt * vv, vv + dt * VELOCITY**2

    def warp(self, h: np.ndarray) -> None:
        """Moves all tracks as the picture moved (a 3 x 3 homography from the frame before)."""
        if not self.tracks:
            return
        h = np.asarray(h, float).reshape(3, 3)
        place, velocity = np.array([t[3:5] for t in self.tracks], float), np.array([t[7:9] for t in self.tracks], float)
        ends = np.concatenate([place, place + velocity])
        moved = np.concatenate([ends, np.ones((len(ends), 1))], 1) @ h.T
        moved = moved[:, :2] / np.where(np.abs(moved[:, 2:]) < 1e-12, 1e-12, moved[:, 2:])
        n = len(self.tracks)
        for t, at, by in zip(self.tracks, moved[:n].tolist(), (moved[n:] - moved[:n]).tolist()):
            t[3:5], t[7:9] = at, by

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Track numbers of a frame's boxes, -1 where there is none (yet). Frames have to ascend."""
        return np.array(self.follow(frame, np.asarray(boxes, float).tolist(), np.asarray(conf, float).tolist()), np.int64)

    def follow(self, frame: int, boxes: list[list[float]], conf: list[float]) -> list[int]:
        """step() of lists."""
        self.tracks = [t for t in self.tracks if frame - t[1] <= self.lost_after and (t[0] >= 0 or frame - t[1] <= 1)]
        if not boxes:
            return []
        # the time of prediction doesn't outlast the frame: what isn't seen keeps its state
        before = [t.copy() for t in self.tracks]
        self._predict(frame)
        predicted = []
        for t in self.tracks:
            x, y, w, h = t[3:7]
            w, h = (0.0 if w < 0 else w) / 2, (0.0 if h < 0 else h) / 2
            predicted.append((x - w, y - h, x + w, y + h))
        of_box, free = [-1] * len(boxes), [True] * len(predicted)
        sure = [c >= self.trusted for c in conf]
        for trusted, least in zip((True, False), self.least_iou):
            chosen = [i for i, s in enumerate(sure) if s is trusted]
            left = [k for k, f in enumerate(free) if f]
            for r, c in _pairs([boxes[i] for i in chosen], [predicted[k] for k in left], least):
                of_box[chosen[r]] = left[c]
                free[left[c]] = False
        for k, unseen in enumerate(free):
            if unseen:
                self.tracks[k] = before[k]
        for i, (x1, y1, x2, y2) in enumerate(boxes):
            measured = ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)
            if of_box[i] >= 0:
                t = self.tracks[of_box[i]]
                pp, pv, vv = t[11:]
                total = pp + PLACE**2
                gain, turn = pp / total, pv / total
                for k in range(4):
                    off = measured[k] - t[3 + k]
                    t[3 + k] += gain * off
                    t[7 + k] += turn * off
                t[11:] = pp * PLACE**2 / total, pv * PLACE**2 / total, vv - pv * pv / total
                t[2] = t[2] + 1 if t[1] == frame - 1 else 1
                t[1] = frame
            elif sure[i]:
                # tracks begin with trusted boxes alone
                of_box[i] = len(self.tracks)
                self.tracks.append([-1, frame, 1, *measured, 0.0, 0.0, 0.0, 0.0, (2 * PLACE) ** 2, 0.0, (10 * VELOCITY) ** 2])
        numbers = [-1] * len(boxes)
        for i, k in enumerate(of_box):
            if k >= 0:
                t = self.tracks[k]
                if t[0] < 0 and t[2] >= self.least_seen:
                    t[0], self.following = self.following, self.following + 1
                numbers[i] = t[0]
        return numbers


def lost_frames(fps: float) -> int:
    """A second's frames, five at least."""
    return max(5, int(np.rint(fps)))


def _numbered(batches: Iterator[pa.RecordBatch], trusted: float, least_seen: int) -> Iterator[pa.RecordBatch]:
    """Rows come by clip, kind and frame; the last frame of a batch waits for the next batch, which may go on with it."""
    clip, tracker, waiting = None, None, None

    def followed(rows: pa.Table, of_frame: np.ndarray) -> pa.Table:
        nonlocal clip, tracker
        numbers = []
        clips, persons, frames, fps, conf = (rows.column(c).to_pylist() for c in ("clip_id", "person", "frame", "fps", "conf"))
        boxes, warps = list(zip(*(rows.column(c).to_pylist() for c in BOX))), rows.column("h")
        for a, b in zip(of_frame[:-1].tolist(), of_frame[1:].tolist()):
            now = (clips[a], persons[a])
            if now != clip:
                clip, tracker = now, Tracker(lost_frames(fps[a]), trusted, least_seen=least_seen)
            # rows without a confidence are the camera's, and come last
            end = b
            while end > a and conf[end - 1] is None:
                end -= 1
            for k in range(end, b):
                tracker.warp(warps[k].as_py())
            found = tracker.follow(frames[a], boxes[a:end], conf[a:end])
            first = 0 if now[1] else VEHICLES_FROM
            numbers += [n + first if n >= 0 else None for n in found] + [None] * (b - end)
        of_track = pa.array(numbers, pa.int32())
        return rows.drop_columns(["person", "fps", "h"]).append_column("track_id", of_track).filter(pc.is_valid(of_track))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([waiting, rows]) if waiting is not None else rows).combine_chunks()
        if not len(rows):
            continue
        differs = np.zeros(len(rows) - 1, bool)
        for c in ("clip_id", "person", "frame"):
            x = rows.column(c)
            differs |= pc.not_equal(x.slice(1), x.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(differs) + 1])
        waiting = rows.slice(int(begins[-1]))
        if len(begins) > 1:
            yield from followed(rows.slice(0, int(begins[-1])), begins).to_batches()
    if waiting is not None:
        yield from followed(waiting, np.array([0, len(waiting)])).to_batches()


def observed(dets: DataFrame, clips: DataFrame, trusted: float = 0.65, camera: DataFrame | None = None, least_seen: int = 2) -> DataFrame:
    """dets (clip_id, frame, cls, x1..y2, conf) that belong to a track, with track_id.

    camera: clip_id, frame, h (nine numbers, the homography from the frame before); tracks are moved by it before they are
    predicted. Detections of clips that aren't in clips, and ones without a frame, box or confidence, are left out. A clip's
    frames of a kind follow one another in one task, which holds a frame and the live tracks; no clip is ever held whole.
    """
    ship_package(dets.sparkSession)
    rates = clips.select("clip_id", "fps")
    good = F.col("frame").isNotNull() & F.col("conf").isNotNull()
    for c in BOX:
        good = good & F.col(c).isNotNull()
    rows = dets.where(good).select("clip_id", (F.col("cls") == 0).alias("person"), F.col("frame").cast("int"), F.col("cls").cast("int"), *[F.col(c).cast("double") for c in (*BOX, "conf")], F.lit(None).cast("array<double>").alias("h"))
    if camera is not None:
        none = [F.lit(None).cast("double").alias(c) for c in (*BOX, "conf")]
        rows = rows.unionByName(camera.select("clip_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("person"), F.col("frame").cast("int"), F.lit(None).cast("int").alias("cls"), *none, F.col("h").cast("array<double>")))
    rows = rows.join(rates, "clip_id").repartition("clip_id", "person").sortWithinPartitions("clip_id", "person", "frame", F.desc("conf"), *BOX, "cls")
    kind = dict(dets.dtypes)["clip_id"]
    return rows.mapInArrow(lambda it: _numbered(it, trusted, least_seen), f"clip_id {kind}, frame int, cls int, x1 double, y1 double, x2 double, y2 double, conf double, track_id int")


def with_majority_class(rows: DataFrame) -> DataFrame:
    """Each track's class is its most frequent one, the first seen of equally frequent ones."""
    counts = rows.groupBy("clip_id", "track_id", "cls").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    of_track = counts.groupBy("clip_id", "track_id").agg(F.min_by("cls", F.struct((-F.col("n")).alias("n"), "first", "cls")).alias("cls"))
    return rows.drop("cls").join(of_track, ["clip_id", "track_id"])


def track(dets: DataFrame, clips: DataFrame, trusted: float = 0.65, camera: DataFrame | None = None, least_seen: int = 2, steps: Steps | None = None) -> DataFrame:
    """Tracks (clip_id, track_id, cls, frame, x1..y2) of persons (class 0) and of vehicles, with one class each.

    What the tracker finds is kept in the shared folder, since it is read twice: for the classes, and for the rows.
    """
    found = with_majority_class((steps or Steps(dets.sparkSession)).keep(observed(dets, clips, trusted, camera, least_seen)))
    return found.select("clip_id", "track_id", "cls", "frame", *BOX)


def stream_tracks(dets: DataFrame, trusted: float = 0.65, delay: str = "10 seconds", idle: str = "1 hour", least_seen: int = 2) -> DataFrame:
    """observed() of a streaming DataFrame (clip_id, cls, frame, x1..y2, conf, fps, ts).

    ts is the time of a row's frame. Rows wait until the watermark has passed their frame, so that the result doesn't depend on
    their order of arrival within `delay`; those that come later are left out and counted (see late.LateRows).
    State of a clip and kind: its live tracks and the rows that wait. It goes when the watermark is `idle` past the last frame.
    """
    ship_package(dets.sparkSession)
    kind = dict(dets.dtypes)["clip_id"]
    columns = ["clip_id", "frame", "cls", *BOX, "conf"]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker, waiting, newest = pickle.loads(state.get[0]) if state.exists else (None, {}, 0)
        passed = state.getCurrentWatermarkMs()
        rows = pd.concat([pd.DataFrame(waiting), *([] if state.hasTimedOut else list(batches))])
        if not len(rows):  # only a time-out comes without rows
            state.remove()
            return
        if tracker is None:
            tracker = Tracker(lost_frames(rows["fps"].iloc[0]), trusted, least_seen=least_seen)
        out = []
        ready = rows[rows["ms"] <= passed].sort_values(["frame", "conf", *BOX, "cls"], ascending=[True, False, *[True] * 5], kind="stable")
        for frame, now in ready.groupby("frame", sort=True):
            numbers = tracker.step(int(frame), now[BOX].to_numpy(float), now["conf"].to_numpy(float))
            now = now[columns].assign(track_id=numbers + (0 if key[1] else VEHICLES_FROM))
            out.append(now[numbers >= 0])
        newest = max(newest, int(rows["ms"].max()))
        rows = rows[rows["ms"] > passed]
        state.update((pickle.dumps((tracker, rows.to_dict("list"), newest)),))
        state.setTimeoutTimestamp(int(rows["ms"].min()) if len(rows) else max(newest + idle_ms, passed + 1))
        yield pd.concat(out) if out else pd.DataFrame(columns=[*columns, "track_id"])

    watched = dets.withWatermark("ts", delay).select("clip_id", (F.col("cls") == 0).alias("person"), "frame", "cls", *BOX, "conf", "fps", F.unix_millis("ts").alias("ms"), "ts")
    schema = f"clip_id {kind}, frame int, cls int, x1 double, y1 double, x2 double, y2 double, conf double, track_id int"
    return watched.groupBy("clip_id", "person").applyInPandasWithState(step, schema, "held binary", "append", "EventTimeTimeout")
