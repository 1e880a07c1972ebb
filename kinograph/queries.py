"""The registered queries, by name, with the SQL that gives the same rows (see registry.query)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinograph import fixtures as X
from kinograph.functions import boxes as B
from kinograph.functions import spans as S
from kinograph.functions import text as T
from kinograph.operators import detections as D
from kinograph.operators import matching as M
from kinograph.operators import proposal as P
from kinograph.operators import series as O
from kinograph.plans import audit as A
from kinograph.plans import evaluation as E
from kinograph.plans import reports as R
from kinograph.plans import sweep as W
from kinograph.registry import ORACLES, QUERIES, query
from kinograph.session import table

# --- series ---


def _near(spark, d):
    return O.contact_spans(X.sig(spark, d), ["pair_id"], "d_norm", 0.10, 0.25)


SPANS = X.spans_sql("sp", "0.10", "0.25")
X.SQL["sp"] = SPANS


@query("pair_id:l sid:l frame_start:l frame_end:l min_d:d", "sig sp", "SELECT * FROM sp")
def contact_spans(spark, d):
    return _near(spark, d)


X.SQL["sp_gap"] = X.spans_sql("sp_gap", "0.15", "0.30", "gapped")


@query("pair_id:l sid:l frame_start:l frame_end:l min_d:d", "sig gapped sp_gap", "SELECT * FROM sp_gap")
def contact_spans_with_gaps(spark, d):
    return O.contact_spans(X.gapped(spark, d), ["pair_id"], "d_norm", 0.15, 0.30)


@query("pair_id:l frame:l d_norm:d", "sig gapped", "SELECT pair_id, frame, avg(d_norm) OVER (PARTITION BY pair_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d_norm FROM gapped")
def smoothed_series(spark, d):
    seen = X.gapped(spark, d).where("d_norm is not null").select("pair_id", "frame", "d_norm")
    last = X.sig(spark, d).groupBy("pair_id").agg(F.max("frame").alias("last"))
    dense = O.dense_axis(seen.join(last, "pair_id"), ["pair_id"], F.col("last"))
    return O.smooth(dense, ["pair_id"], "d_norm", 1)


# every fourth frame of a track has no box
X.SQL["detgap"] = "detgap AS (SELECT * REPLACE (frame + frame // 3 AS frame) FROM det)"


def _detgap(spark, d):
    return X.det(spark, d).withColumn("frame", F.col("frame") + F.floor(F.col("frame") / 3))


@query(
    "clip_id:l cls:l frame:l speed:d", "det detgap clips",
    """SELECT clip_id, cls, frame, CASE WHEN px1 IS NULL THEN NULL WHEN (h0 + h1) / 2 <= 0 THEN 'inf'::DOUBLE
         ELSE sqrt(((x1 + x2 - px1 - px2) / 2) ** 2 + ((y1 + y2 - py1 - py2) / 2) ** 2) / ((h0 + h1) / 2) / ((frame - pf) / fps) END AS speed
       FROM (SELECT d.*, fps, greatest(0, y2 - y1) AS h1, lag(frame) OVER w AS pf, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2,
               lag(greatest(0, y2 - y1)) OVER w AS h0 FROM detgap d JOIN clips USING (clip_id) WINDOW w AS (PARTITION BY clip_id, cls ORDER BY frame))""",
)
def speed_prev_visible(spark, d):
    prev = O.previous_visible(_detgap(spark, d), ["clip_id", "cls"], ["frame", "x1", "y1", "x2", "y2"]).join(X.clips(spark, d), "clip_id")
    return prev.withColumn("speed", B.speed(B.box("prev_"), B.box(), (F.col("frame") - F.col("prev_frame")) / F.col("fps")))


@query(
    "cust:l island:l frame_start:l frame_end:l n:l", "",
    """SELECT cust, island, min(s) AS frame_start, max(e) AS frame_end, count(*) AS n FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
       FROM (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
       FROM (SELECT o_custkey AS cust, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 90 AS e FROM orders))) GROUP BY cust, island""",
)
def merged_islands(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01"))
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), day.alias("frame_start"), (day + F.col("o_orderkey") % 90).alias("frame_end"))
    return O.merge_islands(spans, ["cust"], 1)


@query(
    "pair_id:l sid:l frame:l", "sig sp",
    """SELECT DISTINCT pair_id, sid, CASE WHEN frame_end - frame_start + 1 <= 5 THEN frame_start + k ELSE round_even(frame_start + k * (frame_end - frame_start) / 4.0::DOUBLE, 0) END AS frame
       FROM sp, range(0, 5) r(k) WHERE frame_end - frame_start + 1 > 5 OR k <= frame_end - frame_start""",
)
def sampled_frames(spark, d):
    return _near(spark, d).select("pair_id", "sid", F.explode(S.sample(F.col("frame_start"), F.col("frame_end"), 5)).alias("frame"))


@query(
    "pair_id:l frame:l", "sig sp",
    """SELECT DISTINCT s.pair_id, f.frame FROM (SELECT *, greatest(0, frame_start - 3) AS lo, least(n - 1, frame_end + 3) AS hi FROM sp JOIN (SELECT pair_id, max(frame) + 1 AS n FROM sig GROUP BY 1) USING (pair_id)) s
       JOIN sig f ON f.pair_id = s.pair_id AND f.frame BETWEEN lo AND hi""",
)
def near_frames(spark, d):
    n = X.sig(spark, d).groupBy("pair_id").agg((F.max("frame") + 1).alias("n"))
    return O.near_frames(_near(spark, d).join(n, "pair_id"), ["pair_id"], 3, F.col("n"))


@query(
    "pair_id:l missing:l", "sig gapped",
    """SELECT pair_id, count(*) AS missing FROM gapped WHERE d_norm IS NULL GROUP BY pair_id""",
)
def frame_gap_check(spark, d):
    seen = X.gapped(spark, d).where("d_norm is not null").select("pair_id", "frame")
    return X.sig(spark, d).select("pair_id", "frame").join(seen, ["pair_id", "frame"], "left_anti").groupBy("pair_id").agg(F.count("*").alias("missing"))


# --- boxes ---

X.SQL["pairs"] = """pairs AS (SELECT p.clip_id, p.frame, p.det_id AS p_id, v.det_id AS v_id, p.x1 AS ax1, p.y1 AS ay1, p.x2 AS ax2, p.y2 AS ay2, v.x1 AS bx1, v.y1 AS by1, v.x2 AS bx2, v.y2 AS by2
  FROM det p JOIN det v ON p.clip_id = v.clip_id AND p.frame = v.frame WHERE p.cls = 1 AND v.cls = 2)"""
_INTER = "greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1))"
_AREA = "greatest(0, ax2 - ax1) * greatest(0, ay2 - ay1)", "greatest(0, bx2 - bx1) * greatest(0, by2 - by1)"


def _pairs(spark, d):
    det = X.det(spark, d)
    side = lambda cls, p: det.where(F.col("cls") == cls).select("clip_id", "frame", F.col("det_id").alias(f"{p}id"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    return D.pairs(side(1, "p_"), side(2, "v_"))


@query("clip_id:l frame:l p_id:l v_id:l d_norm:d", "det pairs", "SELECT clip_id, frame, p_id, v_id, sqrt(greatest(bx1 - ax2, ax1 - bx2, 0) ** 2 + greatest(by1 - ay2, ay1 - by2, 0) ** 2) / sqrt((bx2 - bx1) ** 2 + (by2 - by1) ** 2) AS d_norm FROM pairs")
def pair_distance(spark, d):
    return _pairs(spark, d).withColumn("d_norm", B.d_norm(B.box("p_"), B.box("v_")))


@query("clip_id:l frame:l p_id:l v_id:l iou:d ios:d", "det pairs", f"SELECT clip_id, frame, p_id, v_id, ({_INTER}) / ({_AREA[0]} + {_AREA[1]} - {_INTER}) AS iou, ({_INTER}) / least({_AREA[0]}, {_AREA[1]}) AS ios FROM pairs")
def pair_iou_ios(spark, d):
    return _pairs(spark, d).withColumns({"iou": B.iou(B.box("p_"), B.box("v_")), "ios": B.ios(B.box("p_"), B.box("v_"))})


@query(
    "clip_id:l x1:d y1:d x2:d y2:d", "det clips",
    """SELECT clip_id, greatest(0, a - (c - a) * 0.25) AS x1, greatest(0, b - (e - b) * 0.25) AS y1, least(width, c + (c - a) * 0.25) AS x2, least(height, e + (e - b) * 0.25) AS y2
       FROM (SELECT clip_id, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS e FROM det WHERE cls <= 2 GROUP BY 1) JOIN clips USING (clip_id)""",
)
def union_and_crop(spark, d):
    whole = X.det(spark, d).where("cls <= 2").groupBy("clip_id").agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    crop = B.dilate(B.box(), 0.25, (F.col("width"), F.col("height")))
    return whole.join(X.clips(spark, d), "clip_id").select("clip_id", *[v.alias(n) for v, n in zip(crop, ("x1", "y1", "x2", "y2"))])


@query("clip_id:l cls:l frame:l x1:l y1:l x2:l y2:l", "det", "SELECT clip_id, cls, frame, round_even(x1 / 4, 0) AS x1, round_even(y1 / 4, 0) AS y1, round_even(x2 / 4, 0) AS x2, round_even(y2 / 4, 0) AS y2 FROM det")
def quantized_boxes(spark, d):
    q = B.quantize(B.Box(*(v / 4 for v in B.box())))
    return X.det(spark, d).select("clip_id", "cls", "frame", *[v.alias(n) for v, n in zip(q, ("x1", "y1", "x2", "y2"))])


@query("clip_id:l cls:l frame:l edge:b", "det clips", "SELECT clip_id, cls, frame, x1 <= e OR y1 <= e OR x2 >= width - e OR y2 >= height - e AS edge FROM (SELECT d.*, width, height, least(width, height) * 0.02::DOUBLE AS e FROM det d JOIN clips USING (clip_id))")
def edge_flags(spark, d):
    return X.det(spark, d).join(X.clips(spark, d), "clip_id").withColumn("edge", B.at_edge(B.box(), F.col("width"), F.col("height")))


X.SQL["hom"] = """hom AS (SELECT vec_id, [1 + 0.1 * embedding[1]::DOUBLE, 0.1 * embedding[2]::DOUBLE, 10 * embedding[3]::DOUBLE, 0.1 * embedding[4]::DOUBLE, 1 + 0.1 * embedding[5]::DOUBLE, 10 * embedding[6]::DOUBLE, 0, 0, 1]::DOUBLE[] AS h FROM embeddings)"""


@query(
    "vec_id:l ok:b reason:s identity:b", "hom",
    """SELECT vec_id, reason = 'ok' AS ok, reason, abs(h[1] - 1) <= 0.01 AND abs(h[2]) <= 0.01 AND abs(h[3]) <= 0.01 AND abs(h[4]) <= 0.01 AND abs(h[5] - 1) <= 0.01 AND abs(h[6]) <= 0.01 AS identity FROM (
       SELECT *, CASE WHEN h[1] * h[5] - h[2] * h[4] <= 0 THEN 'mirrored' WHEN sqrt(h[1] * h[5] - h[2] * h[4]) < 1 / 1.01::DOUBLE OR sqrt(h[1] * h[5] - h[2] * h[4]) > 1.01 THEN 'scale' ELSE 'ok' END AS reason FROM hom)""",
)
def homography_gate(spark, d):
    h = [F.get("h", F.lit(k)) for k in range(9)]
    ok, reason = B.plausible(h, 1.01)
    return X.homographies(spark, d).select("vec_id", ok.alias("ok"), reason.alias("reason"), B.is_identity(h, 0.01).alias("identity"))


_CORNERS = [("0", "0"), ("100", "0"), ("100", "50"), ("0", "50")]
_XS = ", ".join(f"(h[1] * {x} + h[2] * {y} + h[3])" for x, y in _CORNERS)
_YS = ", ".join(f"(h[4] * {x} + h[5] * {y} + h[6])" for x, y in _CORNERS)


@query("vec_id:l x1:d y1:d x2:d y2:d", "hom", f"SELECT vec_id, least({_XS}) AS x1, least({_YS}) AS y1, greatest({_XS}) AS x2, greatest({_YS}) AS y2 FROM hom")
def warp_boxes(spark, d):
    out = B.warp(B.Box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)), [F.get("h", F.lit(k)) for k in range(9)])
    return X.homographies(spark, d).select("vec_id", *[v.alias(n) for v, n in zip(out, ("x1", "y1", "x2", "y2"))])


@query(
    "clip_id:l static:b", "clips hom",
    """SELECT clip_id, coalesce(shift / width < 0.004, true) AS static FROM clips LEFT JOIN (SELECT vec_id % 40 + 1 AS clip_id, median(sqrt(h[3] ** 2 + h[6] ** 2)) AS shift FROM hom GROUP BY 1) USING (clip_id)""",
)
def camera_static(spark, d):
    h = X.homographies(spark, d).select((F.col("vec_id") % 40 + 1).alias("clip_id"), F.get("h", F.lit(2)).alias("h02"), F.get("h", F.lit(5)).alias("h12"), F.lit(True).alias("ok"))
    return D.static_cameras(h, X.clips(spark, d))


# --- detections ---


@query("clip_id:l cls:l x1:d y1:d x2:d y2:d conf:d", "det", "SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY clip_id, cls ORDER BY conf DESC, x1, y1, x2, y2) <= 5")
def topk_per_class(spark, d):
    return D.top_k(X.det(spark, d), ["clip_id", "cls"], 5)


def _overlap(a, b):
    inter = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda o: f"({o}.x2 - {o}.x1) * ({o}.y2 - {o}.y1)"
    return f"({inter}) / ({area(a)} + {area(b)} - {inter}) >= 0.2 OR ({inter}) / least({area(a)}, {area(b)}) >= 0.4"


def _kept(source: str, keys: str, test) -> str:
    order = "conf DESC, (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2"
    return f"""SELECT {keys}, k.x1, k.y1, k.x2, k.y2, k.conf FROM (SELECT {keys}, unnest(list_reduce(list_transform(l, lambda c: [c]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda o: {test('o', 'c[1]')})) > 0 THEN acc ELSE list_append(acc, c[1]) END)) AS k
        FROM (SELECT {keys}, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}} ORDER BY {order}) AS l FROM {source} GROUP BY ALL))"""


# 25 boxes of a class of a clip are a picture
X.SQL["pictures"] = "pictures AS (SELECT * REPLACE (frame // 25 AS frame) FROM det)"


def _pictures(spark, d):
    return X.det(spark, d).withColumn("frame", F.floor(F.col("frame") / 25))


@query("clip_id:l frame:l cls:l x1:d y1:d x2:d y2:d conf:d", "det pictures", _kept("pictures", "clip_id, frame, cls", _overlap))
def nms_survivors(spark, d):
    return D.suppress(_pictures(spark, d), ["clip_id", "frame", "cls"], 0.2, 0.4)


X.SQL["merged"] = "merged AS (SELECT clip_id, frame, cls, CASE WHEN det_id % 3 > 0 THEN x1 + 40 * (det_id % 3) ELSE x1 END AS x1, CASE WHEN det_id % 3 > 0 THEN y1 + 30 ELSE y1 END AS y1, CASE WHEN det_id % 3 > 0 THEN x2 + 40 * (det_id % 3) ELSE x2 END AS x2, CASE WHEN det_id % 3 > 0 THEN y2 + 30 ELSE y2 END AS y2, conf FROM pictures)"


@query("clip_id:l frame:l cls:l x1:d y1:d x2:d y2:d conf:d", "det pictures merged", _kept("merged", "clip_id, frame, cls", _overlap))
def merged_tiles(spark, d):
    boxes = _pictures(spark, d)
    local = boxes.where("det_id % 3 > 0").withColumns({"x0": 40 * (F.col("det_id") % 3), "y0": F.lit(30)})
    return D.merge_tiled(local, boxes.where("det_id % 3 = 0"), 0.2, 0.4)


@query(
    "clip_id:l x0:l y0:l x1:l y1:l", "clips",
    """SELECT clip_id, x0, y0, least(x0 + 704, width) AS x1, least(y0 + 704, height) AS y1 FROM (SELECT *, unnest(CASE WHEN width <= 704 THEN [0] ELSE list_distinct(list_append(range(0, width - 704 + 1, 528), width - 704)) END) AS x0
       FROM (SELECT *, unnest(CASE WHEN height <= 704 THEN [0] ELSE list_distinct(list_append(range(0, height - 704 + 1, 528), height - 704)) END) AS y0 FROM clips))""",
)
def tile_grid(spark, d):
    return D.tiles(X.clips(spark, d), 704, 0.25)


@query(
    "user_id:l cls:s n:l", "",
    "SELECT user_id, event_type AS cls, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
)
def track_majority_class(spark, d):
    return D.majority_class(table(spark, d, "events").withColumnRenamed("event_type", "cls"), ["user_id"], "event_id")


@query(
    "clip_id:l cls:l birth:l death:l observed:l span:l gap_frames:l motion:d static:b", "det detgap",
    """SELECT *, motion < 0.05 AS static FROM (SELECT clip_id, cls, min(frame) AS birth, max(frame) AS death, count(*) AS observed, max(frame) - min(frame) + 1 AS span, max(frame) - min(frame) + 1 - count(*) AS gap_frames,
       CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(stddev_pop((x1 + x2) / 2) ** 2 + stddev_pop((y1 + y2) / 2) ** 2) / avg(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) END AS motion FROM detgap GROUP BY 1, 2)""",
)
def track_inventory(spark, d):
    return D.track_inventory(_detgap(spark, d), ["clip_id", "cls"])


@query(
    "clip_id:l frame:l cue:d", "det",
    """SELECT v.clip_id, v.frame, coalesce(max(CASE WHEN greatest(0, least(v.x2, o.x2) - greatest(v.x1, o.x1)) * greatest(0, least(v.y2, o.y2) - greatest(v.y1, o.y1)) / ((o.x2 - o.x1) * (o.y2 - o.y1)) >= 0.2 THEN o.conf END), 0) AS cue
       FROM det v LEFT JOIN det o ON v.clip_id = o.clip_id AND v.frame = o.frame AND o.cls > 2 WHERE v.cls = 2 GROUP BY 1, 2""",
)
def door_cue(spark, d):
    det = X.det(spark, d)
    doors = det.where("cls > 2").select("clip_id", "frame", *[F.col(c).alias(f"door_{c}") for c in ("x1", "y1", "x2", "y2", "conf")])
    return D.door_cue(det.where("cls = 2").withColumnRenamed("cls", "track_id"), doors, 0.2)


@query("cls:l model_id:l", "", "SELECT cls, min(id) AS model_id FROM (SELECT unnest([{'c': 0, 'n': 'person'}, {'c': 1, 'n': 'bicycle'}, {'c': 2, 'n': 'car'}, {'c': 3, 'n': 'motorbike'}, {'c': 5, 'n': 'bus'}, {'c': 7, 'n': 'truck'}]) AS k), (SELECT n_nationkey AS id, (['Person ', 'aeroplane', 'motorbike', 'CAR', 'lorry', 'bus', 'bike'])[(n_nationkey % 7 + 1)::INT] AS name FROM nation) m, LATERAL (SELECT CASE WHEN trim(lower(name)) = 'lorry' THEN 7 WHEN trim(lower(name)) = 'bike' THEN 1 WHEN trim(lower(name)) = k.n THEN k.c END AS cls) WHERE cls = k.c GROUP BY cls")
def class_map(spark, d):
    names = F.array(*[F.lit(x) for x in ("Person ", "aeroplane", "motorbike", "CAR", "lorry", "bus", "bike")])
    labels = table(spark, d, "nation").select(F.col("n_nationkey").alias("model_id"), F.element_at(names, (F.col("n_nationkey") % 7 + 1).cast("int")).alias("name"))
    return D.class_map(labels, spark)


# --- proposal and judging ---

X.SQL["fired"] = """fired AS (SELECT s.*, fps, n_frames, birth, death, door, greatest(1, round_even(0.35 * fps, 0)) AS tol,
    list_filter([CASE WHEN (frame_end - frame_start + 1) / fps >= 0.5 THEN 'R1_dwell' END, CASE WHEN abs(death - frame_end) <= greatest(1, round_even(0.35 * fps, 0)) THEN 'R2_death_near' END,
      CASE WHEN abs(birth - frame_start) <= greatest(1, round_even(0.35 * fps, 0)) THEN 'R3_birth_near' END, CASE WHEN door >= 0.3 THEN 'R4_door_change' END], lambda r: r IS NOT NULL) AS rules
  FROM sp s JOIN (SELECT pair_id, min(frame) AS birth, max(frame) AS death FROM sig GROUP BY 1) USING (pair_id) JOIN clips c ON c.clip_id = s.pair_id % 100 + 1
  LEFT JOIN (SELECT p.pair_id, p.sid, max(CASE WHEN event_type = 'purchase' THEN (event_id % 100) / 100 END) AS door FROM sp p JOIN sig g ON g.pair_id = p.pair_id AND g.frame BETWEEN p.frame_start AND p.frame_end GROUP BY 1, 2) d ON d.pair_id = s.pair_id AND d.sid = s.sid)"""
_TOL = "greatest(1, round_even(0.35 * fps, 0))"
X.SQL["cands"] = f"""cands AS (SELECT pair_id AS clip_id, sid, frame_start, frame_end, list_sort(rules) AS rules, round_even(min_d, 4) AS min_d_norm, round_even((frame_end - frame_start + 1) / fps, 3) AS dwell_s,
    birth <= {_TOL} AS birth_at_clip_start, death >= n_frames - 1 - {_TOL} AS death_at_clip_end FROM fired WHERE len(rules) > 0)"""
_RULE = "CASE WHEN list_contains(rules, 'R2_death_near') THEN 'R2_death_near' WHEN list_contains(rules, 'R3_birth_near') THEN 'R3_birth_near' WHEN list_contains(rules, 'R4_door_change') THEN 'R4_door_change' ELSE 'R1_dwell' END"


def _fired(spark, d):
    sig, near = X.sig(spark, d), _near(spark, d)
    life = sig.groupBy("pair_id").agg(F.min("frame").alias("birth"), F.max("frame").alias("death"))
    inside = near.select("pair_id", "sid", "frame_start", "frame_end").join(sig, "pair_id").where("frame between frame_start and frame_end")
    door = inside.groupBy("pair_id", "sid").agg(F.max(F.when(F.col("event_type") == "purchase", (F.col("event_id") % 100) / 100)).alias("max_door"))
    met = near.join(life, "pair_id").join(door, ["pair_id", "sid"], "left")
    met = met.withColumn("clip", F.col("pair_id") % 100 + 1).join(X.clips(spark, d).select(F.col("clip_id").alias("clip"), "fps", "n_frames"), "clip")
    return P.fired(met)


@query("pair_id:l frame_start:l frame_end:l rules:s min_d_norm:d dwell_s:d birth_at_clip_start:b death_at_clip_end:b", "sig sp clips fired cands", "SELECT * REPLACE (list_aggregate(rules, 'string_agg', ',') AS rules), clip_id AS pair_id FROM cands")
def proposed_candidates(spark, d):
    return P.candidates(_fired(spark, d), ["pair_id"]).withColumn("rules", F.array_join("rules", ","))


X.SQL["evidence"] = """evidence AS (SELECT c.clip_id AS pair_id, c.frame_start, f.birth AS person_birth, f.death AS person_death, round_even(max((event_id % 977) / 977), 4) AS max_iou, c.clip_id % 3 = 0 AS born_at_frame_edge, c.clip_id % 4 = 0 AS died_at_frame_edge
  FROM cands c JOIN (SELECT DISTINCT pair_id, birth, death FROM fired) f ON f.pair_id = c.clip_id JOIN sig g ON g.pair_id = c.clip_id AND g.frame BETWEEN c.frame_start AND c.frame_end GROUP BY ALL)"""


@query("pair_id:l frame_start:l person_birth:l person_death:l max_iou:d born_at_frame_edge:b died_at_frame_edge:b", "sig sp clips fired cands evidence", "SELECT * FROM evidence")
def candidate_evidence(spark, d):
    spans = _fired(spark, d)
    inside = spans.select("pair_id", "sid", "frame_start", "frame_end").join(X.sig(spark, d), "pair_id").where("frame between frame_start and frame_end")
    iou = inside.groupBy("pair_id", "sid").agg(F.max((F.col("event_id") % 977) / 977).alias("max_iou"))
    spans = spans.join(iou, ["pair_id", "sid"], "left").withColumns({"born_at_frame_edge": F.col("pair_id") % 3 == 0, "died_at_frame_edge": F.col("pair_id") % 4 == 0})
    return P.candidates(spans, ["pair_id"])


_HALF = "CASE WHEN greatest(3, round_even(0.4::DOUBLE * fps, 0))::INT // 2 = {} THEN avg(d_norm) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {} PRECEDING AND {} FOLLOWING) END"


@query(
    "clip_id:l frame:l visible:b d_norm:d iou:d speed_bl_s:d", "det clips pairs",
    f"""SELECT clip_id, frame, visible, coalesce({', '.join(_HALF.format(h, h, h) for h in (1, 5, 6))}) AS d_norm, iou, speed_bl_s FROM (
       SELECT a.clip_id, a.frame, a.fps, p.clip_id IS NOT NULL AS visible, CASE WHEN p.clip_id IS NOT NULL THEN sqrt(greatest(bx1 - ax2, ax1 - bx2, 0) ** 2 + greatest(by1 - ay2, ay1 - by2, 0) ** 2) / sqrt((bx2 - bx1) ** 2 + (by2 - by1) ** 2) END AS d_norm, CASE WHEN p.clip_id IS NOT NULL THEN ({_INTER}) / ({_AREA[0]} + {_AREA[1]} - {_INTER}) END AS iou,
         sqrt(((ax1 + ax2 - qx1 - qx2) / 2) ** 2 + ((ay1 + ay2 - qy1 - qy2) / 2) ** 2) / ((ay2 - ay1 + qy2 - qy1) / 2) / ((a.frame - qf) / fps) AS speed_bl_s
       FROM (SELECT c.clip_id, fps, unnest(range(n_frames)) AS frame FROM clips c WHERE clip_id IN (SELECT clip_id FROM pairs)) a
       LEFT JOIN (SELECT *, lag(frame) OVER w AS qf, lag(ax1) OVER w AS qx1, lag(ax2) OVER w AS qx2, lag(ay1) OVER w AS qy1, lag(ay2) OVER w AS qy2 FROM pairs WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) p ON p.clip_id = a.clip_id AND p.frame = a.frame)""",
)
def pair_series(spark, d):
    det = X.det(spark, d)
    side = lambda c: det.where(F.col("cls") == c).select("clip_id", F.col("cls").alias("track_id"), "frame", "x1", "y1", "x2", "y2")
    return P.pair_series(side(1), side(2), X.clips(spark, d))


@query(
    "pair_id:l frame_start:l rule:s type:s confidence:d", "sig sp clips fired cands",
    f"""SELECT clip_id AS pair_id, frame_start, rule, CASE rule WHEN 'R1_dwell' THEN 'attend_vehicle' WHEN 'R2_death_near' THEN 'enter_vehicle' WHEN 'R3_birth_near' THEN 'exit_vehicle' ELSE 'open_close_door' END AS type, 0.5 AS confidence
        FROM (SELECT *, {_RULE} AS rule FROM cands)""",
)
def primary_rule_type(spark, d):
    return P.geometric_judge(P.candidates(_fired(spark, d), ["pair_id"]))


@query("clip_id:l frame_start:l interaction_id:s event_group_id:s", "sig sp clips fired cands", "SELECT clip_id, frame_start, i AS interaction_id, i AS event_group_id FROM (SELECT *, printf('%d__i%03d', clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_start, frame_end)) AS i FROM cands)")
def interaction_ids(spark, d):
    return P.numbered(P.geometric_judge(P.candidates(_fired(spark, d), ["pair_id"])).withColumnRenamed("pair_id", "clip_id"), ["frame_start", "frame_end"])


@query(
    "pair_id:l frame_start:l evidence:s", "sig sp clips fired cands",
    """SELECT clip_id AS pair_id, frame_start, coalesce(list_aggregate(list_transform(list_filter([CASE WHEN list_contains(rules, 'R3_birth_near') THEN CASE WHEN frame_start % 2 = 0 THEN 'first seen at the edge of the picture' ELSE 'first seen at the vehicle in open view' END END,
       CASE WHEN list_contains(rules, 'R2_death_near') THEN CASE WHEN frame_end % 2 = 0 THEN 'last seen at the edge of the picture' ELSE 'last seen at the vehicle in open view' END END, CASE WHEN list_contains(rules, 'R4_door_change') THEN 'a door was seen open' END,
       CASE WHEN birth_at_clip_start THEN 'the clip begins here' END], lambda x: x IS NOT NULL), lambda x: '- ' || x), 'string_agg', chr(10)), '') AS evidence FROM cands""",
)
def tracking_evidence(spark, d):
    c = P.candidates(_fired(spark, d), ["pair_id"])
    return c.withColumn("evidence", P.evidence_text(F.col("rules"), F.col("frame_start") % 2 == 0, F.col("frame_end") % 2 == 0, F.col("birth_at_clip_start")))


# --- evaluation ---

X.SQL["cand3"] = "cand3 AS (SELECT * FROM cand WHERE tiou >= 0.3)"
X.SQL["matches"] = X.greedy_sql("matches", "cand3", "clip_id")
X.SQL["typed"] = "typed AS (SELECT m.clip_id, p.type AS p_type, g.type AS g_type, p.frame_start - g.frame_start AS s, p.frame_end - g.frame_end AS e FROM matches m JOIN pred p ON p.clip_id = m.clip_id AND p.pred_id = m.pred_id JOIN gt g ON g.clip_id = m.clip_id AND g.gt_id = m.gt_id WHERE NOT negative)"
_MATCHED = "sig pred gt cand cand3 matches"


def _matches(spark, d):
    return M.match_events(X.pred(spark, d), X.gt(spark, d), ["clip_id"])


@query("clip_id:l pred_id:l gt_id:l tiou:d agree:b", "sig pred gt cand", "SELECT * FROM cand")
def tiou_pairs(spark, d):
    return M.overlap_pairs(X.pred(spark, d), X.gt(spark, d), ["clip_id"])


@query("agree:b n:l", "sig pred gt cand", "SELECT agree, count(*) AS n FROM cand GROUP BY 1")
def anchor_agreement(spark, d):
    return M.overlap_pairs(X.pred(spark, d), X.gt(spark, d), ["clip_id"]).groupBy("agree").agg(F.count("*").alias("n"))


X.SQL["pred4"] = """pred4 AS (SELECT *, ((3 * clip_id + 5 * pred_id) % 70) / 100 AS py1, ((3 * clip_id + 5 * pred_id) % 70) / 100 + 0.2::DOUBLE AS py2, CASE WHEN pred_id % 9 <> 4 THEN ((11 * clip_id + 3 * pred_id) % 60) / 100 END AS vx1,
    ((11 * clip_id + 3 * pred_id) % 60) / 100 + 0.3::DOUBLE AS vx2, ((5 * clip_id + 17 * pred_id) % 50) / 100 AS vy1, ((5 * clip_id + 17 * pred_id) % 50) / 100 + 0.25::DOUBLE AS vy2 FROM pred)"""
X.SQL["gt4"] = "gt4 AS (SELECT *, CASE WHEN gt_id % 7 <> 0 THEN ((3 * clip_id + 5 * gt_id) % 75) / 100 + 0.05::DOUBLE END AS ay, CASE WHEN gt_id % 4 <> 1 THEN ((11 * clip_id + 3 * gt_id) % 70) / 100 + 0.1::DOUBLE END AS vax, ((5 * clip_id + 17 * gt_id) % 60) / 100 + 0.05::DOUBLE AS vay FROM gt)"
_HOLDS = lambda a, p: f"CASE WHEN {a}x IS NULL OR {a}y IS NULL OR {p}x1 IS NULL OR {p}y1 IS NULL OR {p}x2 IS NULL OR {p}y2 IS NULL THEN true ELSE {a}x BETWEEN {p}x1 - ({p}x2 - {p}x1) * 0.25::DOUBLE AND {p}x2 + ({p}x2 - {p}x1) * 0.25::DOUBLE AND {a}y BETWEEN {p}y1 - ({p}y2 - {p}y1) * 0.25::DOUBLE AND {p}y2 + ({p}y2 - {p}y1) * 0.25::DOUBLE END"
X.SQL["cand4"] = "cand4 AS (SELECT c.* REPLACE (" + _HOLDS("a", "p") + " AND " + _HOLDS("va", "v") + " AS agree) FROM cand c JOIN pred4 USING (clip_id, pred_id) JOIN gt4 USING (clip_id, gt_id) WHERE tiou >= 0.3)"
X.SQL["matches4"] = X.greedy_sql("matches4", "cand4", "clip_id")


@query("clip_id:l pred_id:l gt_id:l tiou:d negative:b agree:b", "sig pred gt pred4 gt4 cand cand4 matches4", "SELECT * FROM matches4")
def matches_by_both_anchors(spark, d):
    p, s, g = F.col("clip_id"), F.col("pred_id"), F.col("gt_id")
    y, vx, vy = ((3 * p + 5 * s) % 70) / 100, ((11 * p + 3 * s) % 60) / 100, ((5 * p + 17 * s) % 50) / 100
    preds = X.pred(spark, d).withColumns({"py1": y, "py2": y + 0.2, "vx1": F.when(s % 9 != 4, vx), "vx2": vx + 0.3, "vy1": vy, "vy2": vy + 0.25})
    ay, vax, vay = ((3 * p + 5 * g) % 75) / 100 + 0.05, ((11 * p + 3 * g) % 70) / 100 + 0.1, ((5 * p + 17 * g) % 60) / 100 + 0.05
    gts = X.gt(spark, d).withColumns({"ay": F.when(g % 7 != 0, ay), "vax": F.when(g % 4 != 1, vax), "vay": vay})
    return M.match_events(preds, gts, ["clip_id"])


@query("clip_id:l pred_id:l gt_id:l tiou:d negative:b agree:b", _MATCHED, "SELECT * FROM matches")
def greedy_matches(spark, d):
    return _matches(spark, d)


@query("clip_id:l pred_id:l gt_id:l tiou:d negative:b agree:b", _MATCHED, "SELECT * FROM matches")
def dominant_matches(spark, d):
    """The greedy matches by rounds of first choices, as for clips whose overlaps no task could hold."""
    pairs = M.overlap_pairs(X.pred(spark, d), X.gt(spark, d), ["clip_id"]).where("tiou >= 0.3").withColumn("negative", F.col("g_type") == "pass_by")
    return M.dominant_matches(pairs, ["clip_id"])


X.SQL["cand_same"] = "cand_same AS (SELECT * FROM cand WHERE tiou >= 0.3 AND (negative OR p_type = g_type))"
X.SQL["matches_same"] = X.greedy_sql("matches_same", "cand_same", "clip_id")


@query("clip_id:l pred_id:l gt_id:l tiou:d negative:b", "sig pred gt cand cand_same matches_same", "SELECT * FROM matches_same")
def greedy_matches_same_type(spark, d):
    return M.match_events(X.pred(spark, d), X.gt(spark, d), ["clip_id"], same_type=True)


@query("clip_id:l pred_id:l", _MATCHED, "SELECT clip_id, pred_id FROM pred ANTI JOIN matches USING (clip_id, pred_id)")
def unmatched_pred(spark, d):
    return M.unmatched(X.pred(spark, d), _matches(spark, d), ["clip_id"], "pred_id")


@query("clip_id:l gt_id:l", _MATCHED, "SELECT clip_id, gt_id FROM gt ANTI JOIN matches USING (clip_id, gt_id) WHERE type <> 'pass_by'")
def unmatched_gt(spark, d):
    return M.unmatched(X.gt(spark, d).where("type <> 'pass_by'"), _matches(spark, d), ["clip_id"], "gt_id")


def _prf(tp="tp", fp="fp", fn="fn"):
    return f"round_even(coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0), 4) AS precision, round_even(coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0), 4) AS recall, round_even(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 0), 4) AS f1"


@query(
    "tp:l fp:l fn:l precision:d recall:d f1:d", _MATCHED,
    f"SELECT *, {_prf()} FROM (SELECT tp, n_pred - tp AS fp, n_pos - tp AS fn FROM (SELECT (SELECT count(*) FROM matches WHERE NOT negative) AS tp, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gt WHERE type <> 'pass_by') AS n_pos))",
)
def detection_prf(spark, d):
    return E.with_prf(E.totals(E.detection_counts(X.pred(spark, d), X.gt(spark, d), _matches(spark, d), ["clip_id"]), []))


X.SQL["cand_v"] = "cand_v AS (SELECT * FROM cand, (SELECT unnest([0.3, 0.5])::DOUBLE AS least_tiou), (SELECT unnest([false, true]) AS confident) WHERE tiou >= least_tiou AND (NOT confident OR NOT ambiguous))"
X.SQL["matches_v"] = X.greedy_sql("matches_v", "cand_v", "clip_id, least_tiou, confident")


@query(
    "least_tiou:d confident:b tp:l fp:l fn:l precision:d recall:d f1:d", "sig pred gt cand cand_v matches_v",
    f"""SELECT *, {_prf()} FROM (SELECT least_tiou, confident, tp, (SELECT count(*) FROM pred) - tp AS fp, (SELECT count(*) FROM gt WHERE type <> 'pass_by' AND (NOT confident OR NOT ambiguous)) - tp AS fn
        FROM (SELECT least_tiou, confident, count(*) FILTER (WHERE NOT negative) AS tp FROM matches_v GROUP BY 1, 2))""",
)
def prf_by_variant(spark, d):
    return E.variants(X.pred(spark, d), X.gt(spark, d))


X.SQL["report"] = """rk AS (SELECT unnest([0.3, 0.5])::DOUBLE AS least_tiou, unnest([false, false]) AS confident UNION ALL SELECT unnest([0.3, 0.5])::DOUBLE, unnest([true, true])),
  rp AS (SELECT coalesce(clip_id::VARCHAR, 'POOLED') AS scope, least_tiou, confident, count(*) AS n_pred, count(*) FILTER (WHERE type = 'enter_vehicle') AS p_enter FROM pred, rk GROUP BY GROUPING SETS ((clip_id, least_tiou, confident), (least_tiou, confident))),
  rg AS (SELECT coalesce(clip_id::VARCHAR, 'POOLED') AS scope, least_tiou, confident, count(*) FILTER (WHERE type <> 'pass_by') AS n_pos, count(*) FILTER (WHERE type = 'pass_by') AS n_neg, count(*) FILTER (WHERE type = 'enter_vehicle') AS g_enter, count(*) FILTER (WHERE type = 'load_unload') AS n_load FROM gt, rk WHERE NOT confident OR NOT ambiguous GROUP BY GROUPING SETS ((clip_id, least_tiou, confident), (least_tiou, confident))),
  rm AS (SELECT m.*, p.type AS p_type, g.type AS g_type, p.frame_start - g.frame_start AS s, p.frame_end - g.frame_end AS e FROM matches_v m JOIN pred p ON p.clip_id = m.clip_id AND p.pred_id = m.pred_id JOIN gt g ON g.clip_id = m.clip_id AND g.gt_id = m.gt_id),
  rh AS (SELECT coalesce(clip_id::VARCHAR, 'POOLED') AS scope, least_tiou, confident, count(*) FILTER (WHERE NOT negative) AS tp, count(*) FILTER (WHERE negative) AS fired, count(*) FILTER (WHERE NOT negative AND p_type = g_type AND p_type = 'enter_vehicle') AS tp_enter, median(s) FILTER (WHERE NOT negative) AS signed_start, median(abs(e)) FILTER (WHERE NOT negative) AS abs_end, median(tiou) FILTER (WHERE NOT negative) AS mt,
     sum(gt_id) FILTER (WHERE negative) AS fired_sum FROM rm GROUP BY GROUPING SETS ((clip_id, least_tiou, confident), (least_tiou, confident))),
  rc AS (SELECT scope, least_tiou, confident, string_agg(g_type || '>' || p_type || ':' || n, ' ' ORDER BY g_type, p_type) AS confusion FROM (SELECT coalesce(clip_id::VARCHAR, 'POOLED') AS scope, least_tiou, confident, g_type, p_type, count(*) AS n FROM rm WHERE NOT negative GROUP BY GROUPING SETS ((clip_id, least_tiou, confident, g_type, p_type), (least_tiou, confident, g_type, p_type))) GROUP BY 1, 2, 3)"""


@query(
    "scope:s least_tiou:d confident:b n_clips:l n_positives:l n_predictions:l tp:l fp:l fn:l precision:d recall:d f1:d negatives:l fired:l fired_sum:l enter_tp:l enter_fp:l enter_fn:l load:l confusion:s signed_start:d abs_end:d tiou:d", "sig pred gt cand cand_v matches_v report",
    f"""SELECT *, {_prf()} FROM (SELECT scope, least_tiou, confident, CASE WHEN scope = 'POOLED' THEN (SELECT count(*) FROM (SELECT clip_id FROM pred UNION SELECT clip_id FROM gt)) ELSE 1 END AS n_clips, coalesce(n_pos, 0) AS n_positives, coalesce(n_pred, 0) AS n_predictions, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_pos, 0) - coalesce(tp, 0) AS fn,
        coalesce(n_neg, 0) AS negatives, coalesce(fired, 0) AS fired, coalesce(fired_sum, 0) AS fired_sum, coalesce(tp_enter, 0) AS enter_tp, coalesce(p_enter, 0) - coalesce(tp_enter, 0) AS enter_fp, coalesce(g_enter, 0) - coalesce(tp_enter, 0) AS enter_fn, coalesce(n_load, 0) AS load, coalesce(confusion, '') AS confusion, signed_start, abs_end, printf('%.4f', mt)::DOUBLE AS tiou
        FROM rp FULL JOIN rg USING (scope, least_tiou, confident) LEFT JOIN rh USING (scope, least_tiou, confident) LEFT JOIN rc USING (scope, least_tiou, confident))""",
)
def full_report(spark, d):
    """The whole report of each clip and of all, in every variant."""
    r = E.full_report(X.pred(spark, d), X.gt(spark, d))
    cells = F.array_join(F.transform("confusion", lambda x: F.concat(x["g_type"], F.lit(">"), x["p_type"], F.lit(":"), x["n"].cast("string"))), " ")
    fired = F.aggregate("negatives.ids", F.lit(0).cast("long"), lambda a, x: a + x["gt_id"])
    enter = {f"enter_{c}": F.col(f"per_type.enter_vehicle.{c}") for c in ("tp", "fp", "fn")}
    return r.select(*r.columns[:6], "detection.*", F.col("negatives.n").alias("negatives"), "negatives.fired", fired.alias("fired_sum"), *[v.alias(k) for k, v in enter.items()], F.col("rare.load_unload").alias("load"), cells.alias("confusion"), "localization.signed_start", "localization.abs_end", "localization.tiou")


@query("n_negatives:l n_hit:l rate:d", _MATCHED, "SELECT n_negatives, n_hit, round_even(n_hit / n_negatives::DOUBLE, 4) AS rate FROM (SELECT (SELECT count(*) FROM gt WHERE type = 'pass_by') AS n_negatives, (SELECT count(*) FROM matches WHERE negative) AS n_hit)")
def pass_by_report(spark, d):
    return E.pass_by_report(X.gt(spark, d), _matches(spark, d))


def _typed(spark, d):
    return E.matched_types(X.pred(spark, d), X.gt(spark, d), _matches(spark, d))


_TYPES = "(SELECT unnest(" + str(T.TYPES) + ") AS {})"


@query("g_type:s p_type:s n:l", _MATCHED + " typed", f"SELECT a.g_type, b.p_type, count(t.clip_id) AS n FROM {_TYPES.format('g_type')} a CROSS JOIN {_TYPES.format('p_type')} b LEFT JOIN typed t ON t.g_type = a.g_type AND t.p_type = b.p_type GROUP BY 1, 2")
def type_confusion(spark, d):
    return E.type_confusion(_typed(spark, d))


@query(
    "type:s tp:l fp:l fn:l precision:d recall:d f1:d", _MATCHED + " typed",
    f"SELECT *, {_prf()} FROM (SELECT type, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM (SELECT type, (SELECT count(*) FROM typed t WHERE t.p_type = t.g_type AND t.p_type = k.type) AS tp, (SELECT count(*) FROM pred p WHERE p.type = k.type) AS n_pred, (SELECT count(*) FROM gt g WHERE g.type = k.type) AS n_gt FROM {_TYPES.format('type')} k))",
)
def per_type_prf(spark, d):
    return E.per_type(X.pred(spark, d), X.gt(spark, d), _typed(spark, d))


@query("n:l abs_start:d abs_end:d signed_start:d signed_end:d", _MATCHED + " typed", "SELECT count(*) AS n, median(abs(s)) AS abs_start, median(abs(e)) AS abs_end, median(s) AS signed_start, median(e) AS signed_end FROM typed")
def localization_error(spark, d):
    return E.localization(_typed(spark, d))


X.SQL["grid"] = "grid AS (SELECT row_number() OVER (ORDER BY det_conf, tau_near, tau_far) - 1 AS pos, * FROM (SELECT unnest([0.35, 0.5, 0.65])::DOUBLE AS det_conf), (SELECT unnest([0.06, 0.1, 0.15, 0.22])::DOUBLE AS tau_near), (SELECT unnest([0.18, 0.25, 0.32, 0.45])::DOUBLE AS tau_far) WHERE tau_far > tau_near)"


@query("det_conf:d tau_near:d tau_far:d setting:s clips:l", "sig grid", """SELECT det_conf, tau_near, tau_far, printf('{"det_conf": %s, "tau_far": %s, "tau_near": %s}', det_conf::VARCHAR, tau_far::VARCHAR, tau_near::VARCHAR) AS setting, (SELECT count(DISTINCT pair_id) FROM sig) AS clips FROM grid""")
def grid_settings(spark, d):
    """The settings of a sweep over the signal's clips, with their keys and for how many clips each is asked."""
    clips = X.sig(spark, d).select(F.col("pair_id").cast("string").alias("clip_id"))
    asked = W.wanted(clips, E.settings_grid(spark), ["det_conf", "tau_near", "tau_far"], "geometric")
    return asked.groupBy("det_conf", "tau_near", "tau_far", "setting").agg(F.count("*").alias("clips"))


X.SQL["loco"] = (
    "sig_s AS (SELECT s.* REPLACE (CASE WHEN 0.3::DOUBLE + (event_id % 70) / 100 >= det_conf THEN d_norm END AS d_norm), pos, tau_near, tau_far FROM sig s, grid),"
    + X.spans_sql("sps", "tau_near", "tau_far", "sig_s", "pos, pair_id")
    + f""", pred_s AS (SELECT pos, pair_id AS clip_id, sid AS pred_id, frame_start, frame_end, ((7 * pair_id + 13 * sid) % 80) / 100 AS px1, ((7 * pair_id + 13 * sid) % 80) / 100 + 0.1::DOUBLE AS px2 FROM sps),
    cand_s AS ({X.SQL['cand'].split('AS (', 1)[1].rsplit(')', 1)[0].replace('FROM pred p', 'FROM pred_s p').replace('SELECT p.clip_id,', 'SELECT p.pos, p.clip_id,').replace('p.type AS p_type,', '')}),
    cand_s3 AS (SELECT * FROM cand_s WHERE tiou >= 0.3)"""
    + ", " + X.greedy_sql("matches_s", "cand_s3", "pos, clip_id")
    + """, counts AS (SELECT c.pos, c.clip_id, coalesce(m.tp, 0) AS tp, coalesce(p.n, 0) - coalesce(m.tp, 0) AS fp, coalesce(g.n, 0) - coalesce(m.tp, 0) AS fn
      FROM (SELECT pos, clip_id FROM grid, (SELECT DISTINCT pair_id AS clip_id FROM sig)) c LEFT JOIN (SELECT pos, clip_id, count(*) AS n FROM pred_s GROUP BY 1, 2) p USING (pos, clip_id)
      LEFT JOIN (SELECT clip_id, count(*) FILTER (WHERE type <> 'pass_by') AS n FROM gt GROUP BY 1) g USING (clip_id) LEFT JOIN (SELECT pos, clip_id, count(*) FILTER (WHERE NOT negative) AS tp FROM matches_s GROUP BY 1, 2) m USING (pos, clip_id)),
    folds AS (SELECT clip_id AS fold, pos, tp, fp, fn, fit_f1 FROM (SELECT *, coalesce(2.0::DOUBLE * otp / nullif(2.0::DOUBLE * otp + ofp + ofn, 0), 0) AS fit_f1 FROM (SELECT *, sum(tp) OVER w - tp AS otp, sum(fp) OVER w - fp AS ofp, sum(fn) OVER w - fn AS ofn FROM counts WINDOW w AS (PARTITION BY pos)))
      QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY fit_f1 DESC, pos) = 1)"""
)


def _loco_counts(spark, d):
    grid = E.settings_grid(spark)
    sig = X.sig(spark, d).withColumn("conf", 0.3 + (F.col("event_id") % 70) / 100)
    settings = [(r.pos, r.tau_near, r.tau_far, r.det_conf) for r in E.grid_rows()]
    preds = X.pred_of(O.contact_spans_grid(sig, ["pair_id"], "d_norm", settings, "conf"))
    return E.setting_counts(preds, X.gt(spark, d), sig.select(F.col("pair_id").alias("clip_id")), grid)


_LOCO = "sig gt grid loco"


@query("fold:l pos:l tp:l fp:l fn:l fit_f1:d", _LOCO, "SELECT * FROM folds")
def loco_selection(spark, d):
    return E.leave_one_out(_loco_counts(spark, d))


@query(
    "held_tp:l held_fp:l held_fn:l held_f1:d all_pos:l all_tp:l all_fp:l all_fn:l all_f1:d gap:d", _LOCO,
    """SELECT h.*, a.*, round_even(all_f1 - held_f1, 4) AS gap FROM (SELECT tp AS held_tp, fp AS held_fp, fn AS held_fn, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS held_f1 FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM folds)) h,
       (SELECT pos AS all_pos, tp AS all_tp, fp AS all_fp, fn AS all_fn, round_even(k, 4) AS all_f1 FROM (SELECT pos, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, coalesce(2.0::DOUBLE * sum(tp) / nullif(2.0::DOUBLE * sum(tp) + sum(fp) + sum(fn), 0), 0) AS k FROM counts GROUP BY 1) ORDER BY k DESC, pos LIMIT 1) a""",
)
def loco_summary(spark, d):
    return E.loco_summary(_loco_counts(spark, d))


@query(
    "knob:s n_values:l modal:d n_modal:l", _LOCO,
    """SELECT knob, count(*) AS n_values, arg_max(value, n * 1000000 - f) AS modal, max(n) AS n_modal FROM (SELECT knob, value, count(*) AS n, min(fold) AS f FROM (SELECT fold, 'tau_near' AS knob, tau_near AS value FROM folds JOIN grid USING (pos) UNION ALL SELECT fold, 'tau_far', tau_far FROM folds JOIN grid USING (pos) UNION ALL SELECT fold, 'det_conf', det_conf FROM folds JOIN grid USING (pos)) GROUP BY 1, 2) GROUP BY 1""",
)
def fold_agreement(spark, d):
    return E.fold_agreement(E.leave_one_out(_loco_counts(spark, d)), E.settings_grid(spark), ["det_conf", "tau_near", "tau_far"])


# --- text and JSON ---

X.SQL["descs"] = f"""descs AS (SELECT k, CASE WHEN k % 6 = 2 THEN 'young boy' ELSE concat_ws(', ', {X._pick(["adult man", "adult woman", "young boy", "girl", "adult male", "baby"], "k % 6")},
    {X._pick(["dark", "white", "gray", "blue and white", "red"], "k % 5")} || ' ' || {X._pick(["shirt", "jacket", "clothes", "hoodie"], "k % 4")}, {X._pick(["light", "black", "navy"], "k % 3")} || ' ' || {X._pick(["pants", "jeans", "skirt"], "k // 3 % 3")},
    CASE WHEN k % 7 < 3 THEN 'black bag' END) END AS person_desc,
    {X._pick(["white", "silver", "dark blue", "red and black"], "k % 4")} || CASE WHEN k % 7 = 0 THEN ' ' ELSE ',' END || {X._pick(["sedan", "hatchback", "minivan", "SUV", "cart"], "k % 5")} || ', ' || {X._pick(["parked", "driving", "stopped", "starting to drive", "moving", "turning"], "k % 6")} AS vehicle_desc
  FROM (SELECT c_custkey AS k FROM customer))"""


def _colour_set(text: str) -> str:
    return f"nullif(list_sort(list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: list_contains({T.COLOURS}, w)))), [])"


def _any(words: str, names: list[str]) -> str:
    return f"list_has_any({words}, {names})"


X.SQL["person"] = f"""person0 AS (SELECT *, list_filter(list_transform(string_split(person_desc, ','), lambda t: lower(trim(t))), lambda t: t <> '') AS parts FROM descs),
  person1 AS (SELECT *, regexp_split_to_array(coalesce(parts[1], ''), '\\s+') AS who, regexp_split_to_array(coalesce(parts[2], ''), '\\s+') AS w1, regexp_split_to_array(coalesce(parts[3], ''), '\\s+') AS w2, {_colour_set("parts[2]")} AS c1, {_colour_set("parts[3]")} AS c2 FROM person0),
  person2 AS (SELECT *, CASE WHEN {_any("w1", ["clothes", "clothing"])} THEN 'both' WHEN {_any("w1", T.UPPER)} THEN 'upper' WHEN {_any("w1", T.LOWER)} THEN 'lower' END AS k1 FROM person1),
  person3 AS (SELECT *, CASE WHEN k1 IS NULL OR k1 = 'both' THEN NULL WHEN {_any("w2", ["clothes", "clothing"])} THEN 'both' WHEN {_any("w2", T.UPPER)} AND NOT (k1 = 'upper' AND c1 IS NOT NULL) THEN 'upper' WHEN {_any("w2", T.LOWER)} AND NOT (k1 = 'lower' AND c1 IS NOT NULL) THEN 'lower' END AS k2 FROM person2),
  person AS (SELECT k, CASE WHEN {_any("who", ["man", "male", "boy"])} THEN 'male' WHEN {_any("who", ["woman", "female", "girl"])} THEN 'female' END AS sex, CASE WHEN {_any("who", ["adult"])} THEN 'adult' WHEN {_any("who", ["young", "child", "boy", "girl", "baby"])} THEN 'child' END AS age,
    CASE WHEN k2 IN ('both', 'upper') THEN c2 WHEN k1 IN ('both', 'upper') THEN c1 END AS upper, CASE WHEN k2 IN ('both', 'lower') THEN c2 WHEN k1 IN ('both', 'lower') THEN c1 END AS lower,
    CASE WHEN k1 IS NOT NULL THEN len(parts) - 1 > CASE WHEN k1 = 'both' OR k2 IS NULL OR k2 = 'both' THEN 1 ELSE 2 END END AS carrying FROM person3)"""
X.SQL["vehicle"] = f"""vehicle AS (SELECT k, {_colour_set("vehicle_desc")} AS color, map({list(T.BODIES)}, {list(T.BODIES.values())})[list_filter(regexp_extract_all(lower(vehicle_desc), '[a-z]+'), lambda w: list_contains({list(T.BODIES)}, w))[1]] AS body_type,
    CASE {" ".join(f"WHEN contains(lower(vehicle_desc), '{p}') THEN '{s}'" for p, s in T.STATES)} END AS state FROM descs)"""


@query("k:l sex:s age:s upper:s lower:s carrying:b", "descs person", "SELECT * REPLACE (list_aggregate(upper, 'string_agg', '|') AS upper, list_aggregate(lower, 'string_agg', '|') AS lower) FROM person")
def gt_person_slots(spark, d):
    s = X.descs(spark, d).withColumn("s", T.person_slots(F.col("person_desc")))
    return s.select("k", "s.sex", "s.age", F.array_join("s.upper_color", "|").alias("upper"), F.array_join("s.lower_color", "|").alias("lower"), "s.carrying")


@query("k:l color:s body_type:s state:s", "descs vehicle", "SELECT * REPLACE (list_aggregate(color, 'string_agg', '|') AS color) FROM vehicle")
def gt_vehicle_slots(spark, d):
    s = X.descs(spark, d).withColumn("s", T.vehicle_slots(F.col("vehicle_desc")))
    return s.select("k", F.array_join("s.color", "|").alias("color"), "s.body_type", "s.state")


_COLS = ["dark", "white", "grey", "blue", "red", "unknown", "silver"]
X.SQL["attrs"] = f"""attrs AS (SELECT k, {X._pick(["male", "female", "unknown"], "k % 3")} AS sex, {X._pick(["adult", "child"], "k % 2")} AS age, {X._pick(_COLS, "k % 7")} AS upper_color, {X._pick(["shirt", "unknown"], "k % 2")} AS upper_garment, {X._pick(_COLS, "k // 2 % 7")} AS lower_color,
   {X._pick(["pants", "unknown", "skirt"], "k % 3")} AS lower_garment, {X._pick(["yes", "no", "unknown"], "k // 4 % 3")} AS carrying, {X._pick(_COLS, "k // 3 % 7")} AS color, {X._pick(["sedan", "van", "suv", "unknown", "hatchback"], "k // 2 % 5")} AS body_type, {X._pick(["parked", "moving", "stopped", "unknown"], "k % 4")} AS state FROM (SELECT c_custkey AS k FROM customer))"""


def _exact(truth: str, predicted: str) -> str:
    return f"CASE WHEN {truth} IS NULL THEN NULL WHEN {predicted} = 'unknown' THEN 'abstain' WHEN {truth} = {predicted} THEN 'correct' ELSE 'wrong' END"


def _hue_sql(truth: str, p: str) -> str:
    hues = f"list_transform(list_filter({truth}, lambda c: c NOT IN ('dark', 'light')), lambda c: CASE WHEN c IN ('silver', 'gray') THEN 'grey' ELSE c END)"
    return f"CASE WHEN {truth} IS NULL OR len({hues}) = 0 THEN NULL WHEN {p} IN ('unknown', 'dark', 'light') THEN 'abstain' WHEN list_contains({hues}, CASE WHEN {p} IN ('silver', 'gray') THEN 'grey' ELSE {p} END) THEN 'correct' ELSE 'wrong' END"


def _light_sql(truth: str, p: str) -> str:
    dark, light = T.DARK + T.EITHER, T.LIGHT + T.EITHER
    return f"CASE WHEN {truth} IS NULL THEN NULL WHEN {p} = 'unknown' THEN 'abstain' WHEN (list_contains({dark}, {p}) AND list_has_any({truth}, {dark})) OR (list_contains({light}, {p}) AND list_has_any({truth}, {light})) THEN 'correct' ELSE 'wrong' END"


_SLOT_SQL = {
    "person.sex": _exact("p.sex", "a.sex"), "person.age": _exact("p.age", "a.age"),
    "person.upper_color.hue": _hue_sql("p.upper", "a.upper_color"), "person.upper_color.lightness": _light_sql("p.upper", "a.upper_color"),
    "person.lower_color.hue": _hue_sql("p.lower", "a.lower_color"), "person.lower_color.lightness": _light_sql("p.lower", "a.lower_color"),
    "person.carrying": "CASE WHEN p.carrying IS NULL THEN NULL WHEN a.carrying = 'unknown' THEN 'abstain' WHEN (a.carrying = 'yes') = p.carrying THEN 'correct' ELSE 'wrong' END",
    "vehicle.color.hue": _hue_sql("v.color", "a.color"), "vehicle.color.lightness": _light_sql("v.color", "a.color"), "vehicle.body_type": _exact("v.body_type", "a.body_type"),
    "vehicle.state": _exact("v.state", "CASE WHEN a.state IN ('parked', 'stopped') THEN 'static' ELSE a.state END"),
}
X.SQL["scores"] = "scores AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT k, '{s}' AS slot, {e} AS outcome FROM person p JOIN vehicle v USING (k) JOIN attrs a USING (k)" for s, e in _SLOT_SQL.items()) + ") WHERE outcome IS NOT NULL)"


def _scores(spark, d):
    both = X.descs(spark, d).join(X.attrs(spark, d), "k")
    both = both.withColumns({"gp": T.person_slots(F.col("person_desc")), "gv": T.vehicle_slots(F.col("vehicle_desc"))})
    return both.select("k", F.explode(T.score_slots(F.col("gp"), F.col("gv"), F.col("pa"), F.col("va"))).alias("slot", "outcome"))


@query("k:l slot:s outcome:s", "descs person vehicle attrs scores", "SELECT * FROM scores")
def slot_scores(spark, d):
    return _scores(spark, d)


@query(
    "side:s slot:s correct:l wrong:l abstain:l accuracy:d coverage:d", "descs person vehicle attrs scores",
    """SELECT *, round_even(correct / nullif(correct + wrong, 0)::DOUBLE, 4) AS accuracy, round_even((correct + wrong) / nullif(correct + wrong + abstain, 0)::DOUBLE, 4) AS coverage FROM (SELECT split_part(slot, '.', 1) AS side, slot, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'wrong') AS wrong,
       count(*) FILTER (WHERE outcome = 'abstain') AS abstain FROM scores GROUP BY GROUPING SETS ((1, 2), (1)))""",
)
def slot_rollup(spark, d):
    return E.slot_rollup(_scores(spark, d))


@query(
    "k:l person:s vehicle:s", "attrs",
    """SELECT k, concat_ws(', ', concat_ws(' ', age, nullif(sex, 'unknown')), nullif(concat_ws(' ', nullif(upper_color, 'unknown'), nullif(upper_garment, 'unknown')), ''), nullif(concat_ws(' ', nullif(lower_color, 'unknown'), nullif(lower_garment, 'unknown')), ''), CASE WHEN carrying = 'yes' THEN 'carrying an object' END) AS person,
       coalesce(nullif(concat_ws(', ', nullif(color, 'unknown'), nullif(body_type, 'unknown'), nullif(state, 'unknown')), ''), 'vehicle') AS vehicle FROM attrs""",
)
def rendered_descriptions(spark, d):
    return X.attrs(spark, d).select("k", T.render_person(F.col("pa")).alias("person"), T.render_vehicle(F.col("va")).alias("vehicle"))


X.SQL["resp"] = f"""resp0 AS (SELECT event_id, '{{"type": "' || {X._pick([*T.TYPES, T.NEGATIVE, "dance"], "CASE WHEN event_id % 6 = 3 THEN 6 ELSE event_id % 6 END")} || '", "confidence": ' || CASE WHEN event_id % 6 = 4 THEN (event_id % 100)::VARCHAR || '.5' ELSE '0.' || lpad((event_id % 100)::VARCHAR, 2, '0') END || ', "note": "n' || (event_id % 10)::VARCHAR || '"}}' AS body FROM events),
  resp AS (SELECT event_id, sha256(concat_ws('|', 'req', event_id::VARCHAR)) AS key, CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'I think: ' || body || ' as asked.' WHEN 2 THEN 'no idea' ELSE body END AS raw FROM resp0),
  parsed AS (SELECT *, json_extract_string(j, '$.type') AS t, greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0))) AS c, json_extract_string(j, '$.note') AS note FROM (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS j FROM resp)),
  verdicts AS (SELECT event_id, key, CASE WHEN t IN {tuple([*T.TYPES, T.NEGATIVE])} THEN t END AS type, CASE WHEN t IN {tuple([*T.TYPES, T.NEGATIVE])} THEN c END AS confidence, CASE WHEN t IN {tuple([*T.TYPES, T.NEGATIVE])} THEN note END AS note FROM parsed)"""


@query("event_id:l type:s confidence:d note:s", "resp", "SELECT * FROM verdicts")
def parsed_responses(spark, d):
    return X.responses(spark, d).withColumn("v", T.parse_verdict(F.col("raw"))).select("event_id", "v.type", "v.confidence", "v.note")


@query("event_id:l hit:b accepted:b", "resp", "SELECT r.event_id, v.key IS NOT NULL AS hit, v.type <> 'pass_by' AND v.confidence >= 0.5 AS accepted FROM resp r LEFT JOIN (SELECT * FROM verdicts WHERE event_id % 3 <> 0) v USING (key)")
def cache_hits(spark, d):
    r = X.responses(spark, d)
    return P.judged_from_cache(r.select("event_id", "key"), r.where("event_id % 3 <> 0").select("key", "raw"))


@query("accepted:b type:s n:l", "resp", "SELECT type <> 'pass_by' AND confidence >= 0.5 AS accepted, type, count(*) AS n FROM verdicts GROUP BY 1, 2")
def accepted_rejected(spark, d):
    r = X.responses(spark, d)
    j = P.judged_from_cache(r.select("event_id", "key"), r.select("key", "raw"))
    return j.groupBy("accepted", F.col("verdict.type").alias("type")).agg(F.count("*").alias("n"))


@query("r_name:s prompt:s", "", "SELECT r_name, string_agg(lower(trim(n_name)) || '.', ' ' ORDER BY n_name) AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def prompt_phrases(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).select("r_name", T.prompt(F.transform("names", lambda x: F.concat(F.lit(" "), x, F.lit("..")))).alias("prompt"))


@query(
    "severity:s rule:s key:s", "sig gt clips",
    """SELECT * FROM (WITH g AS (SELECT clip_id, CASE WHEN gt_id = 7 THEN 6 ELSE gt_id END AS gt_id, frame_start, CASE WHEN gt_id % 50 = 3 THEN frame_start - 1 ELSE frame_end END AS frame_end, CASE gt_id % 5 WHEN 0 THEN 'man, dark shirt, bag' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'man' END AS d FROM gt),
       k AS (SELECT g.*, fps, n_frames, g.clip_id::VARCHAR || '/' || gt_id::VARCHAR AS key FROM g LEFT JOIN clips USING (clip_id)),
       r AS (SELECT *, max(frame_end) OVER (PARTITION BY clip_id, d ORDER BY frame_start, frame_end, gt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, clip_id::VARCHAR || '/' || gt_id::VARCHAR AS key FROM g)
       SELECT 'error' AS severity, 'duplicate_id' AS rule, key FROM r GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'error', 'unknown_clip', key FROM k WHERE fps IS NULL UNION ALL SELECT 'error', 'span_order', key FROM k WHERE frame_end < frame_start AND fps IS NOT NULL
       UNION ALL SELECT 'error', 'span_range', key FROM k WHERE frame_start < 0 OR frame_end >= n_frames OR frame_start >= n_frames OR frame_end < 0 UNION ALL SELECT 'warning', 'short', key FROM k WHERE (frame_end - frame_start + 1) / fps < 0.5 UNION ALL SELECT 'warning', 'few_parts', key FROM k WHERE d <> '' AND len(string_split(d, ',')) < 3 AND fps IS NOT NULL
       UNION ALL SELECT 'error', 'empty_desc', key FROM k WHERE coalesce(d, '') = '' AND fps IS NOT NULL UNION ALL SELECT 'warning', 'overlap', key FROM r WHERE frame_start <= reach UNION ALL SELECT 'warning', 'abuts', key FROM r WHERE frame_start = reach + 1 UNION ALL SELECT 'info', 'no_labels', clip_id::VARCHAR FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM g))""",
)
def audit_findings(spark, d):
    i = F.col("gt_id")
    desc = F.when(i % 5 == 0, "man, dark shirt, bag").when(i % 5 == 1, "").when(i % 5 == 2, None).otherwise("man")
    g = X.gt(spark, d).withColumns({"desc": desc, "frame_end": F.when(i % 50 == 3, F.col("frame_start") - 1).otherwise(F.col("frame_end"))})
    return A.findings(g.withColumn("gt_id", F.when(i == 7, 6).otherwise(i)), X.clips(spark, d))


_LABEL_RULES = [
    ("error", "time_start_s", "abs(t0 - round(frame_start / fps, 3)) > 0.011"), ("error", "time_end_s", "abs(t1 - round(frame_end / fps, 3)) > 0.011"), ("warning", "short", "t1 - t0 < 0.5"), ("error", "span_range", "NOT (frame_start BETWEEN 0 AND n_frames - 1 AND frame_end BETWEEN 0 AND n_frames - 1)"),
    ("error", "empty_vehicle_desc", "coalesce(v, '') = ''"), ("warning", "few_vehicle_parts", "v <> '' AND len(string_split(v, ',')) < 3"), ("warning", "no_person_anchor_frame", "pa IS NULL"), ("warning", "person_anchor_frame_outside", "pa NOT BETWEEN frame_start AND frame_end"),
]


@query(
    "severity:s rule:s key:s", "sig gt clips",
    """SELECT severity, rule, key FROM (WITH g AS (SELECT *, clip_id::VARCHAR || '/' || gt_id::VARCHAR AS key, frame_start / fps + CASE WHEN gt_id % 11 = 0 THEN 0.02 ELSE 0.004 END AS t0, frame_end / fps AS t1, CASE gt_id % 6 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'car, red' ELSE 'car, red, parked' END AS v, CASE WHEN gt_id % 8 > 0 THEN frame_start + gt_id % 8 - 2 END AS pa FROM gt LEFT JOIN clips USING (clip_id)),
       r AS (SELECT *, max(frame_end) OVER (PARTITION BY clip_id ORDER BY frame_start, frame_end, gt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g) """
    + " UNION ALL ".join(f"SELECT '{severity}' AS severity, '{rule}' AS rule, key FROM g WHERE fps IS NOT NULL AND ({hit})" for severity, rule, hit in _LABEL_RULES)
    + """ UNION ALL SELECT 'error', 'unknown_clip', key FROM g WHERE fps IS NULL UNION ALL SELECT 'warning', 'overlap', key FROM r WHERE frame_start <= reach UNION ALL SELECT 'warning', 'abuts', key FROM r WHERE frame_start = reach + 1
       UNION ALL SELECT 'info', 'no_labels', clip_id::VARCHAR FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM gt))""",
)
def audit_labels(spark, d):
    i, clips = F.col("gt_id"), X.clips(spark, d)
    g = X.gt(spark, d).join(clips.select("clip_id", "fps"), "clip_id", "left")
    vehicle = F.when(i % 6 == 1, "").when(i % 6 == 2, None).when(i % 6 == 3, "car, red").otherwise("car, red, parked")
    more = {"desc": F.lit("man, dark shirt, bag"), "time_start_s": F.col("frame_start") / F.col("fps") + F.when(i % 11 == 0, 0.02).otherwise(0.004), "time_end_s": F.col("frame_end") / F.col("fps")}
    g = g.withColumns(more | {"vehicle_desc": vehicle, "person_anchor_frame": F.when(i % 8 > 0, F.col("frame_start") + i % 8 - 2)}).drop("fps")
    return A.findings(g, clips)


@query(
    "events:l labelled_clips:l clips:l positives:l negatives:l ambiguous:l groups:l grouped_events:l", "sig gt clips",
    """SELECT (SELECT count(*) FROM gt) AS events, (SELECT count(DISTINCT clip_id) FROM gt) AS labelled_clips, (SELECT count(*) FROM clips) AS clips, (SELECT count(*) FROM gt WHERE type <> 'pass_by') AS positives, (SELECT count(*) FROM gt WHERE type = 'pass_by') AS negatives,
       (SELECT count(*) FROM gt WHERE ambiguous) AS ambiguous, count(*) AS groups, sum(n) AS grouped_events FROM (SELECT clip_id, gt_id // 4, count(*) AS n FROM gt GROUP BY 1, 2 HAVING count(*) > 1)""",
)
def label_summary(spark, d):
    group = F.concat_ws("/", F.col("clip_id").cast("string"), F.floor(F.col("gt_id") / 4).cast("string"))
    return A.label_summary(X.gt(spark, d).withColumn("event_group_id", group), X.clips(spark, d))


@query(
    "clip_id:l first_id:l second_id:l kind:s grouped:b", "sig gt",
    """SELECT a.clip_id, a.gt_id AS first_id, b.gt_id AS second_id, CASE WHEN b.frame_start <= a.frame_end THEN 'overlap' ELSE 'abut' END AS kind, a.gt_id // 4 = b.gt_id // 4 AS grouped FROM gt a JOIN gt b ON a.clip_id = b.clip_id AND a.gt_id % 3 = b.gt_id % 3 AND (a.frame_start, a.gt_id) < (b.frame_start, b.gt_id) AND b.frame_start <= a.frame_end + 1""",
)
def audit_touching(spark, d):
    return A.touching_pairs(X.gt(spark, d).withColumns({"desc": (F.col("gt_id") % 3).cast("string"), "event_group_id": F.floor(F.col("gt_id") / 4)}))


@query("clip_id:l frame_start:l interaction_id:s", "sig sp clips fired cands", "SELECT clip_id, frame_start, printf('%d__i%03d', clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_start, frame_end)) AS interaction_id FROM cands")
def pooled_interactions(spark, d):
    c = P.numbered(P.geometric_judge(P.candidates(_fired(spark, d), ["pair_id"])).withColumnRenamed("pair_id", "clip_id"), ["frame_start", "frame_end"])
    c = c.withColumn("config_hash", F.lit("a"))
    return A.pooled(c, c.select("clip_id").distinct())


# --- reports ---


@query("clip_id:l tile:b asked:b", "clips", "SELECT clip_id, width >= 1920 AS tile, coalesce(CASE WHEN clip_id % 3 = 0 THEN clip_id % 2 = 0 END, width >= 1920) AS asked FROM clips")
def tiling_choice(spark, d):
    k = F.col("clip_id")
    return X.clips(spark, d).select("clip_id", R.should_tile(F.col("width")).alias("tile"), R.should_tile(F.col("width"), F.when(k % 3 == 0, k % 2 == 0)).alias("asked"))


X.SQL["tspans"] = "tspans AS (SELECT clip_id, n AS frame_start, n + 4 AS frame_end FROM (SELECT clip_id, unnest([0, 7, 20, 100000]) AS n FROM clips))"


def _tspans(spark, d):
    return X.clips(spark, d).select("clip_id", F.explode(F.array(*[F.lit(n) for n in (0, 7, 20, 100000)])).alias("frame_start")).select("clip_id", F.lit(1).alias("track_id"), "frame_start", (F.col("frame_start") + 4).alias("frame_end"))


@query(
    "clip_id:l frame_start:l x1:d y1:d x2:d y2:d", "det clips tspans",
    # printed, because round_even() rounds a product that has lost the value's last digits
    """SELECT s.clip_id, frame_start, printf('%.5f', min(x1) / any_value(width))::DOUBLE AS x1, printf('%.5f', min(y1) / any_value(height))::DOUBLE AS y1, printf('%.5f', max(x2) / any_value(width))::DOUBLE AS x2, printf('%.5f', max(y2) / any_value(height))::DOUBLE AS y2
       FROM tspans s JOIN clips USING (clip_id) LEFT JOIN det t ON t.clip_id = s.clip_id AND t.cls = 1 AND t.frame BETWEEN frame_start AND frame_end GROUP BY 1, 2""",
)
def span_boxes(spark, d):
    obs = X.det(spark, d).where("cls = 1").withColumnRenamed("cls", "track_id")
    return R.span_boxes(_tspans(spark, d), obs, X.clips(spark, d))


@query(
    "clip_id:l frame_start:l frames:s boxes:s", "det clips tspans",
    """SELECT clip_id, frame_start, string_agg(f::BIGINT::VARCHAR, ',' ORDER BY f) AS frames, string_agg(coalesce(b, '-'), ' ' ORDER BY f) AS boxes FROM (SELECT q.*, round_even(x1, 0)::BIGINT::VARCHAR || ':' || round_even(y2, 0)::BIGINT::VARCHAR AS b FROM (SELECT DISTINCT clip_id, frame_start, CASE WHEN hi - lo + 1 <= 5 THEN lo + k ELSE round_even(lo + k * (hi - lo) / 4.0::DOUBLE, 0) END AS f
       FROM (SELECT clip_id, frame_start, greatest(0, frame_start - round_even(fps, 0)) AS lo, least(n_frames - 1, frame_end + round_even(fps, 0)) AS hi FROM tspans JOIN clips USING (clip_id)), range(0, 5) r(k) WHERE hi >= lo AND (hi - lo + 1 > 5 OR k <= hi - lo)) q
       LEFT JOIN det t ON t.clip_id = q.clip_id AND t.frame = q.f AND t.cls = 1) GROUP BY 1, 2""",
)
def request_bundles(spark, d):
    obs = X.det(spark, d).where("cls = 1").withColumnRenamed("cls", "track_id")
    b = R.bundles(_tspans(spark, d), obs, X.clips(spark, d), 1.0, 5)
    text = F.transform(F.transform("boxes", lambda x: F.when(x.isNotNull(), F.concat_ws(":", x[0].cast("string"), x[3].cast("string")))), lambda s: F.coalesce(s, F.lit("-")))
    return b.withColumns({"frames": F.array_join("frames", ","), "boxes": F.array_join(text, " ")})


@query(
    "judge:s clip:s tp:l fp:l fn:l precision:d recall:d f1:d", "sig pred gt cand cand_v matches_v",
    f"""SELECT judge, clip, tp, fp, fn, {_prf()} FROM (SELECT judge, coalesce(clip_id::VARCHAR, 'POOLED') AS clip, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
        SELECT CASE WHEN least_tiou = 0.3 THEN 'loose' ELSE 'strict' END AS judge, k.clip_id, coalesce(m.tp, 0) AS tp, coalesce(p.n, 0) - coalesce(m.tp, 0) AS fp, coalesce(g.n, 0) - coalesce(m.tp, 0) AS fn
        FROM (SELECT clip_id, least_tiou FROM (SELECT clip_id FROM pred UNION SELECT clip_id FROM gt), (SELECT unnest([0.3, 0.5])::DOUBLE AS least_tiou)) k
        LEFT JOIN (SELECT clip_id, count(*) AS n FROM pred GROUP BY 1) p USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) FILTER (WHERE type <> 'pass_by') AS n FROM gt GROUP BY 1) g USING (clip_id)
        LEFT JOIN (SELECT clip_id, least_tiou, count(*) FILTER (WHERE NOT negative) AS tp FROM matches_v WHERE NOT confident GROUP BY 1, 2) m USING (clip_id, least_tiou)) GROUP BY GROUPING SETS ((judge, clip_id), (judge)))""",
)
def judge_comparison(spark, d):
    p, g = X.pred(spark, d), X.gt(spark, d)
    parts = [E.detection_counts(p, g, M.match_events(p, g, ["clip_id"], t), ["clip_id"]).withColumn("judge", F.lit(name)) for name, t in (("loose", 0.3), ("strict", 0.5))]
    return R.comparison(parts[0].unionByName(parts[1]))


@query("clip_id:l persons:l others:l max_conf:d median_height:d classes:s", "det", "SELECT clip_id, count(*) FILTER (WHERE cls - 1 = 0) AS persons, count(*) FILTER (WHERE cls - 1 <> 0) AS others, max(conf) AS max_conf, median(y2 - y1) AS median_height, string_agg(DISTINCT (cls - 1)::VARCHAR, ',' ORDER BY (cls - 1)::VARCHAR) AS classes FROM det GROUP BY 1")
def frame_summary(spark, d):
    return R.frame_summary(X.det(spark, d).withColumn("cls", F.col("cls") - 1), ["clip_id"])


@query("other_actor:l no_slots:l scored:l", _MATCHED, "SELECT count(*) FILTER (WHERE NOT agree) AS other_actor, count(*) FILTER (WHERE agree AND pred_id % 3 = 0) AS no_slots, count(*) FILTER (WHERE agree AND pred_id % 3 <> 0) AS scored FROM matches WHERE NOT negative")
def description_report(spark, d):
    # a third of the answers say nothing of person or vehicle
    raw = F.when(F.col("pred_id") % 3 == 0, F.concat(F.lit("no idea of "), F.col("pred_id").cast("string"))).otherwise('```json\n{"person": {"sex": "male", "upper_color": "blue"}, "vehicle": {"color": "red"}}\n```')
    slots = T.parse_description(raw)
    return R.description_report(_matches(spark, d).where("not negative").withColumn("has_slots", slots.isNotNull()))


@query(
    "k:l person:s vehicle:s", "descs attrs",
    """SELECT k, CASE WHEN k % 2 = 0 THEN person_desc ELSE concat_ws(', ', concat_ws(' ', age, nullif(sex, 'unknown')), nullif(concat_ws(' ', nullif(upper_color, 'unknown'), nullif(upper_garment, 'unknown')), ''), nullif(concat_ws(' ', nullif(lower_color, 'unknown'), nullif(lower_garment, 'unknown')), ''), CASE WHEN carrying = 'yes' THEN 'carrying an object' END) END AS person,
       CASE WHEN k % 2 = 0 THEN vehicle_desc ELSE coalesce(nullif(concat_ws(', ', nullif(color, 'unknown'), nullif(body_type, 'unknown'), nullif(state, 'unknown')), ''), 'vehicle') END AS vehicle FROM descs JOIN attrs USING (k)""",
)
def attached_descriptions(spark, d):
    both = X.descs(spark, d).join(X.attrs(spark, d), "k")
    both = both.withColumn("slots", F.when(F.col("k") % 2 == 1, F.struct(F.col("pa").alias("person"), F.col("va").alias("vehicle"))))
    return R.attached(both).select("k", F.col("person_desc").alias("person"), F.col("vehicle_desc").alias("vehicle"))


# queries of runs, streams and stored documents register themselves
from kinograph import queries_runs as _runs  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "_runs"]
