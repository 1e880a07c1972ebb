"""Camera motion from points that were found in two frames: a lagged join over sampled frames, and a homography by consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions import boxes as B
from kinograph.session import ship_package

# How many pairs of frames of a clip are looked at, and the fewest points that have to agree
SAMPLED, LEAST_INLIERS = 12, 12
#: Samples of four points, and pixels within which a point agrees.
TRIALS, WITHIN = 400, 3.0
#: Trials whose points are projected at once, so that a frame of very many points takes bounded memory.
POINTS_AT_ONCE = 1 << 20
OUTPUT = "frame_a int, frame_b int, h array<double>, n_matches int, n_inliers int"


def sampled_pairs(clips: DataFrame, n: int = SAMPLED, seconds: float = 1.0) -> DataFrame:
    """(clip_id, frame_a, frame_b): frames `seconds` apart, spread over each clip: drift adds up over such a lag, jitter doesn't.

    Clips that are shorter than the lag have none.
    """
    gap = F.greatest(F.lit(1), F.rint(F.col("fps") * seconds).cast("int"))
    last = F.col("n_frames") - 1 - gap
    step = F.greatest(F.lit(1), F.floor(last / n).cast("int"))
    starts = clips.withColumns({"_gap": gap, "_last": last, "_step": step}).where("_last >= 0")
    return starts.select("clip_id", F.explode(F.expr("sequence(0, _last, _step)")).alias("frame_a"), "_gap").select("clip_id", "frame_a", (F.col("frame_a") + F.col("_gap")).alias("frame_b"))


def lagged_points(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(clip_id, frame_a, frame_b, xa, ya, xb, yb): the points (clip_id, frame, point_id, x, y) that both frames of a pair have.

    point_id is what makes a point known again, such as a hash of its description; one that a frame has twice is left out.
    """
    once = points.groupBy("clip_id", "frame", "point_id").agg(F.count("*").alias("_n"), F.first("x").alias("x"), F.first("y").alias("y")).where("_n = 1")
    side = lambda p: once.select("clip_id", F.col("frame").cast("int").alias(f"frame_{p}"), "point_id", F.col("x").cast("double").alias(f"x{p}"), F.col("y").cast("double").alias(f"y{p}"))
    found = pairs.join(side("a"), ["clip_id", "frame_a"]).join(side("b"), ["clip_id", "frame_b", "point_id"])
    return found.where("xa is not null and ya is not null and xb is not null and yb is not null")


def _normal(p: np.ndarray) -> np.ndarray:
    """The similarity that centres points at the origin, at a mean distance of sqrt(2)."""
    centre = p.mean(0)
    scale = np.sqrt(2) / max(np.hypot(*(p - centre).T).mean(), 1e-12)
    return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1.0]])


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The linear equations of a homography from a to b (..., n, 2), as (..., 2 n, 9)."""
    one, zero = np.ones(a.shape[:-1]), np.zeros(a.shape[:-1])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    first = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1)
    second = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)
    return np.concatenate([first, second], -2)


def _errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (trials, n) of the points b from a under homographies h (trials, 3, 3); infinite behind the horizon."""
    moved = np.concatenate([a, np.ones((len(a), 1))], 1) @ h.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = moved[..., :2] / moved[..., 2:]
    out = np.hypot(flat[..., 0] - b[:, 0], flat[..., 1] - b[:, 1])
    return np.where(np.isfinite(out) & (moved[..., 2] > 1e-12), out, np.inf)


def consensus(a: np.ndarray, b: np.ndarray, seed: int = 0, trials: int = TRIALS, within: float = WITHIN) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography from points a to points b (n, 2) on which the most points agree, and which points do.

    Samples of four points are drawn by the seed alone; the best one is fitted again to all points that agree until they stay
    the same. None where no sample has four points in general position.
    """
    n = len(a)
    agree = np.zeros(n, bool)
    if n < 4:
        return None, agree
    na, nb = _normal(a), _normal(b)
    there = lambda t, p: p @ t[:2, :2].T + t[:2, 2]
    sa, sb = there(na, a), there(nb, b)
    rng = np.random.default_rng(seed)
    picks = rng.integers(0, n, (trials, 4))
    picks = picks[(np.diff(np.sort(picks, 1), axis=1) > 0).all(1)]
    equations = _rows(sa[picks], sb[picks])
    fit = np.abs(np.linalg.det(equations[..., :8])) > 1e-9
    best, most = None, -1
    if fit.any():
        solved = np.linalg.solve(equations[fit][..., :8], -equations[fit][..., 8:])[..., 0]
        normal = np.concatenate([solved, np.ones((len(solved), 1))], 1).reshape(-1, 3, 3)
        h = np.linalg.inv(nb) @ normal @ na
        for i in range(0, len(h), max(1, POINTS_AT_ONCE // n)):
            counts = (_errors(h[i : i + max(1, POINTS_AT_ONCE // n)], a, b) <= within).sum(1)
            if counts.max() > most:
                best, most = h[i + int(counts.argmax())], int(counts.max())
    if best is None:
        return None, agree
    agree = _errors(best[None], a, b)[0] <= within
    for _ in range(10):
        if agree.sum() < 4:
            break
        ta, tb = _normal(a[agree]), _normal(b[agree])
        fitted = np.linalg.inv(tb) @ np.linalg.svd(_rows(there(ta, a[agree]), there(tb, b[agree])))[2][-1].reshape(3, 3) @ ta
        if abs(fitted[2, 2]) < 1e-12:
            break
        fitted = fitted / fitted[2, 2]
        now = _errors(fitted[None], a, b)[0] <= within
        if now.sum() < agree.sum():
            break
        best, same, agree = fitted, (now == agree).all(), now
        if same:
            break
    return best / best[2, 2], agree


def _estimated(batches: Iterator[pa.RecordBatch], trials: int, within: float) -> Iterator[pa.RecordBatch]:
    """Rows come by clip and pair of frames; the last pair of a batch waits for the next batch, which may go on with it."""
    waiting = None

    def found(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        xy = np.stack([rows.column(c).to_numpy() for c in ("xa", "ya", "xb", "yb")], 1)
        frames = rows.column("frame_a").to_numpy(), rows.column("frame_b").to_numpy()
        hs, inliers = [], []
        for i, j in zip(begins[:-1].tolist(), begins[1:].tolist()):
            # in an order of their own, so that the samples don't depend on how the rows came
            p = xy[i:j][np.lexsort(xy[i:j].T)]
            h, agree = consensus(p[:, :2], p[:, 2:], int(frames[0][i]), trials, within)
            hs.append(None if h is None else h.reshape(-1).tolist())
            inliers.append(int(agree.sum()))
        at = begins[:-1]
        columns = [rows.column("clip_id").take(pa.array(at)).combine_chunks(), pa.array(frames[0][at], pa.int32()), pa.array(frames[1][at], pa.int32()), pa.array(hs, pa.list_(pa.float64())), pa.array(np.diff(begins), pa.int32()), pa.array(inliers, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["clip_id", "frame_a", "frame_b", "h", "n_matches", "n_inliers"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([waiting, rows]) if waiting is not None else rows).combine_chunks()
        if not len(rows):
            continue
        differs = np.zeros(len(rows) - 1, bool)
        for c in ("clip_id", "frame_a", "frame_b"):
            x = rows.column(c)
            differs |= pc.not_equal(x.slice(1), x.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(differs) + 1])
        waiting = rows.slice(int(begins[-1]))
        if len(begins) > 1:
            yield found(rows.slice(0, int(begins[-1])), begins)
    if waiting is not None:
        yield found(waiting, np.array([0, len(waiting)]))


def homographies(matches: DataFrame, least: int = LEAST_INLIERS, trials: int = TRIALS, within: float = WITHIN, most_scale: float = 1.5) -> DataFrame:
    """(clip_id, frame_a, frame_b, h, n_matches, n_inliers, ok, reason) of matched points (see lagged_points).

    ok: enough points agree and the homography can be one camera's move (see boxes.plausible); else reason says why not. A pair
    of frames is worked on by one task, which holds that pair's points.
    """
    ship_package(matches.sparkSession)
    keys = ["clip_id", "frame_a", "frame_b"]
    kind = dict(matches.dtypes)["clip_id"]
    dealt = matches.select(*keys, "xa", "ya", "xb", "yb").repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(lambda it: _estimated(it, trials, within), f"clip_id {kind}, {OUTPUT}")
    fine, why = B.plausible([F.get("h", F.lit(k)) for k in range(9)], most_scale)
    reason = F.when(F.col("n_matches") < least, "too few matches").when(F.col("h").isNull(), "no homography").when(F.col("n_inliers") < least, "too few inliers").otherwise(why)
    return found.withColumn("reason", reason).withColumn("ok", (F.col("reason") == "ok") & fine)


def motion_report(estimates: DataFrame, clips: DataFrame, below: float = 0.004) -> DataFrame:
    """(clip_id, pairs, estimated, median_shift, median_share, static): how far the picture moves over a lag, as pixels and as a share
    of its width; a clip without an estimate is static."""
    shift = F.when(F.col("ok"), F.hypot(F.get("h", F.lit(2)), F.get("h", F.lit(5))))
    moved = estimates.groupBy("clip_id").agg(F.count("*").alias("pairs"), F.count_if("ok").alias("estimated"), F.median(shift).alias("median_shift"))
    share = F.try_divide(F.col("median_shift"), F.col("width"))
    out = clips.select("clip_id", "width").join(moved, "clip_id", "left").fillna(0, ["pairs", "estimated"])
    return out.select("clip_id", "pairs", "estimated", "median_shift", share.alias("median_share"), F.coalesce(share < below, F.lit(True)).alias("static"))
