"""The driver's tables seen as the engine's inputs: signals, detections, clips, predicted and labelled spans.

SQL is the same set of views as DuckDB common table expressions, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions.text import NEGATIVE, TYPES
from kinograph.operators.series import contact_spans
from kinograph.session import table

# Picture sizes and frame rates of clips
SIZES = [(352, 288, 25.0), (640, 360, 29.97), (960, 720, 6.67), (1280, 720, 6.0), (3840, 2160, 30.0)]


def sig(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, frame, d_norm, event_type): one measurement a frame."""
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("pair_id"), (F.row_number().over(order) - 1).alias("frame"), (F.col("value") / 100).alias("d_norm"), "event_type", "event_id")


def gapped(spark: SparkSession, d: str) -> DataFrame:
    """sig with a seventh of its measurements missing (NULL), on the same dense axis."""
    return sig(spark, d).withColumn("d_norm", F.when(F.col("event_id") % 7 != 0, F.col("d_norm")))


def det(spark: SparkSession, d: str) -> DataFrame:
    """(clip_id, cls, det_id, frame, x1, y1, x2, y2, conf); frames count each class of a clip from 0."""
    li = table(spark, d, "lineitem")
    b = li.select(
        F.col("l_suppkey").alias("clip_id"), F.col("l_linenumber").alias("cls"), F.col("l_orderkey").alias("det_id"),
        (F.col("l_partkey") % 640).cast("double").alias("x1"), (F.col("l_orderkey") % 480).cast("double").alias("y1"), "l_quantity", F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 4).alias("conf"),
    )
    b = b.withColumns({"x2": F.col("x1") + F.col("l_quantity") + 1, "y2": F.col("y1") + 2 * F.col("l_quantity") + 1}).drop("l_quantity")
    order = Window.partitionBy("clip_id", "cls").orderBy("det_id", "x1", "y1", "x2", "y2", "conf")
    return b.withColumn("frame", F.row_number().over(order) - 1)


def clips(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SIZES]), (k + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("clip_id"), pick(0).alias("width"), pick(1).alias("height"), pick(2).alias("fps"), (100 + F.col("s_suppkey") % 7 * 50).cast("int").alias("n_frames"))


def _types(names: list[str], number):
    return F.element_at(F.array(*[F.lit(t) for t in names]), (number + 1).cast("int"))


def pred_of(spans: DataFrame) -> DataFrame:
    p, s = F.col("pair_id"), F.col("sid")
    x = ((7 * p + 13 * s) % 80) / 100
    return spans.select(*[c for c in ("pos",) if c in spans.columns], p.alias("clip_id"), s.alias("pred_id"), "frame_start", "frame_end", _types(TYPES, (p + s) % 5).alias("type"), x.alias("px1"), (x + 0.1).alias("px2"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    return pred_of(contact_spans(sig(spark, d), ["pair_id"], "d_norm", 0.10, 0.25))


def gt(spark: SparkSession, d: str) -> DataFrame:
    spans = contact_spans(sig(spark, d), ["pair_id"], "d_norm", 0.15, 0.45)
    p, s = F.col("pair_id"), F.col("sid")
    return spans.select(
        p.alias("clip_id"), s.alias("gt_id"), F.greatest(F.lit(0), F.col("frame_start") - s % 5).cast("int").alias("frame_start"), (F.col("frame_end") + p % 4).cast("int").alias("frame_end"),
        _types([*TYPES, NEGATIVE], (p + 2 * s) % 6).alias("type"), F.when(s % 5 != 0, ((7 * p + 13 * s) % 90) / 100 + 0.05).alias("ax"), (s % 4 == 0).alias("ambiguous"),
    )


def descs(spark: SparkSession, d: str) -> DataFrame:
    """(k, person_desc, vehicle_desc): descriptions made from customer keys."""
    k = F.col("c_custkey")
    pick = lambda names, n: _types(names, n)
    who = pick(["adult man", "adult woman", "young boy", "girl", "adult male", "baby"], k % 6)
    upper = F.concat(pick(["dark", "white", "gray", "blue and white", "red"], k % 5), F.lit(" "), pick(["shirt", "jacket", "clothes", "hoodie"], k % 4))
    lower = F.concat(pick(["light", "black", "navy"], k % 3), F.lit(" "), pick(["pants", "jeans", "skirt"], F.floor(k / 3) % 3))
    person = F.when(k % 6 == 2, "young boy").otherwise(F.concat_ws(", ", who, upper, lower, F.when(k % 7 < 3, "black bag")))
    vehicle = F.concat(pick(["white", "silver", "dark blue", "red and black"], k % 4), F.when(k % 7 == 0, " ").otherwise(","), pick(["sedan", "hatchback", "minivan", "SUV", "cart"], k % 5), F.lit(", "), pick(["parked", "driving", "stopped", "starting to drive", "moving", "turning"], k % 6))
    return table(spark, d, "customer").select(k.alias("k"), person.alias("person_desc"), vehicle.alias("vehicle_desc"))


def attrs(spark: SparkSession, d: str) -> DataFrame:
    """(k, pa, va): predicted slots made from customer keys."""
    k = F.col("c_custkey")
    s = lambda names, n, name: _types(names, n).alias(name)
    colours = ["dark", "white", "grey", "blue", "red", "unknown", "silver"]
    pa = F.struct(s(["male", "female", "unknown"], k % 3, "sex"), s(["adult", "child"], k % 2, "age"), s(colours, k % 7, "upper_color"), s(["shirt", "unknown"], k % 2, "upper_garment"), s(colours, F.floor(k / 2) % 7, "lower_color"), s(["pants", "unknown", "skirt"], k % 3, "lower_garment"), s(["yes", "no", "unknown"], F.floor(k / 4) % 3, "carrying"))
    va = F.struct(s(colours, F.floor(k / 3) % 7, "color"), s(["sedan", "van", "suv", "unknown", "hatchback"], F.floor(k / 2) % 5, "body_type"), s(["parked", "moving", "stopped", "unknown"], k % 4, "state"))
    return table(spark, d, "customer").select(k.alias("k"), pa.alias("pa"), va.alias("va"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, key, raw): model answers, some fenced, in prose, broken, of unknown type, or with too high a confidence."""
    e = F.col("event_id")
    kind = _types([*TYPES, NEGATIVE, "dance"], F.when(e % 6 == 3, 6).otherwise(e % 6))
    conf = F.when(e % 6 == 4, F.concat((e % 100).cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("0."), F.lpad((e % 100).cast("string"), 2, "0")))
    body = F.concat(F.lit('{"type": "'), kind, F.lit('", "confidence": '), conf, F.lit(', "note": "n'), (e % 10).cast("string"), F.lit('"}'))
    raw = F.when(e % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(e % 6 == 1, F.concat(F.lit("I think: "), body, F.lit(" as asked."))).when(e % 6 == 2, "no idea").otherwise(body)
    return table(spark, d, "events").select(e.alias("event_id"), F.sha2(F.concat_ws("|", F.lit("req"), e.cast("string")), 256).alias("key"), raw.alias("raw"))


def homographies(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, h array of nine): near-identity matrices made from embeddings."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    h = F.array(1 + 0.1 * e(1), 0.1 * e(2), 10 * e(3), 0.1 * e(4), 1 + 0.1 * e(5), 10 * e(6), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return table(spark, d, "embeddings").select("vec_id", h.alias("h"))


def _pick(names: list[str], number: str) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[(({number}) + 1)::INT]"


def spans_sql(name: str, near: str, far: str, source: str = "sig", keys: str = "pair_id") -> str:
    """Common table expressions that end in `name` (keys, sid, frame_start, frame_end, min_d)."""
    return f"""
    {name}_m AS (SELECT *, CASE WHEN d_norm < {near} THEN 1 WHEN d_norm > {far} THEN 0 END AS m FROM {source}),
    {name}_s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS st FROM {name}_m),
    {name}_p AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY {keys} ORDER BY frame), 0) AS ps FROM {name}_s),
    {name}_n AS (SELECT *, sum(CASE WHEN st = 1 AND ps = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sid,
                 max(CASE WHEN d_norm IS NOT NULL THEN frame END) OVER (PARTITION BY {keys}) AS lastf FROM {name}_p),
    {name} AS (SELECT {keys}, sid::BIGINT AS sid, min(CASE WHEN st = 1 THEN frame END) AS frame_start, coalesce(min(CASE WHEN st = 0 THEN frame END) - 1, max(lastf)) AS frame_end,
               min(CASE WHEN st = 1 THEN d_norm END) AS min_d FROM {name}_n WHERE st = 1 OR ps = 1 GROUP BY {keys}, sid)"""


_SIZE_SQL = "CASE s_suppkey % 5 " + " ".join(f"WHEN {k} THEN {{}}" for k in range(5)) + " END"
SQL = {
    "sig": "sig AS (SELECT user_id AS pair_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 100 AS d_norm, event_type, event_id FROM events)",
    "gapped": "gapped AS (SELECT pair_id, frame, CASE WHEN event_id % 7 <> 0 THEN d_norm END AS d_norm FROM sig)",
    "det": """det0 AS (SELECT l_suppkey AS clip_id, l_linenumber AS cls, l_orderkey AS det_id, (l_partkey % 640)::DOUBLE AS x1, (l_orderkey % 480)::DOUBLE AS y1,
                (l_partkey % 640)::DOUBLE + l_quantity + 1 AS x2, (l_orderkey % 480)::DOUBLE + 2 * l_quantity + 1 AS y2, round(l_discount * 5 + l_tax * 5, 4) AS conf FROM lineitem),
              det AS (SELECT *, row_number() OVER (PARTITION BY clip_id, cls ORDER BY det_id, x1, y1, x2, y2, conf) - 1 AS frame FROM det0)""",
    "clips": f"clips AS (SELECT s_suppkey AS clip_id, {_SIZE_SQL.format(*[s[0] for s in SIZES])} AS width, {_SIZE_SQL.format(*[s[1] for s in SIZES])} AS height, {_SIZE_SQL.format(*[f'{s[2]}::DOUBLE' for s in SIZES])} AS fps, (100 + s_suppkey % 7 * 50)::INT AS n_frames FROM supplier)",
    "pred": spans_sql("p_spans", "0.10", "0.25") + f""",
    pred AS (SELECT pair_id AS clip_id, sid AS pred_id, frame_start, frame_end, {_pick(TYPES, '(pair_id + sid) % 5')} AS type, ((7 * pair_id + 13 * sid) % 80) / 100 AS px1, ((7 * pair_id + 13 * sid) % 80) / 100 + 0.1::DOUBLE AS px2 FROM p_spans)""",
    "gt": spans_sql("g_spans", "0.15", "0.45") + f""",
    gt AS (SELECT pair_id AS clip_id, sid AS gt_id, greatest(0, frame_start - sid % 5) AS frame_start, frame_end + pair_id % 4 AS frame_end, {_pick([*TYPES, NEGATIVE], '(pair_id + 2 * sid) % 6')} AS type,
           CASE WHEN sid % 5 <> 0 THEN ((7 * pair_id + 13 * sid) % 90) / 100 + 0.05::DOUBLE END AS ax, sid % 4 = 0 AS ambiguous FROM g_spans)""",
    "cand": """cand AS (SELECT p.clip_id, pred_id, gt_id, p.type AS p_type, g.type AS g_type, p.frame_start AS p0, p.frame_end AS p1, g.frame_start AS g0, g.frame_end AS g1, ambiguous, g.type = 'pass_by' AS negative,
      (least(p.frame_end, g.frame_end) - greatest(p.frame_start, g.frame_start) + 1)::DOUBLE
        / ((p.frame_end - p.frame_start + 1) + (g.frame_end - g.frame_start + 1) - (least(p.frame_end, g.frame_end) - greatest(p.frame_start, g.frame_start) + 1)) AS tiou,
      coalesce(ax BETWEEN px1 - (px2 - px1) * 0.25::DOUBLE AND px2 + (px2 - px1) * 0.25::DOUBLE, true) AS agree
      FROM pred p JOIN gt g ON p.clip_id = g.clip_id AND p.frame_start <= g.frame_end AND g.frame_start <= p.frame_end)""",
}


def greedy_sql(name: str, source: str, keys: str) -> str:
    """`name` (keys, pred_id, gt_id, tiou, negative, agree): greedy one-to-one matches of `source`."""
    return f"""
    {name}_l AS (SELECT {keys}, list({{'p': pred_id, 'g': gt_id, 't': tiou, 'n': negative, 'a': agree}} ORDER BY negative, agree DESC, tiou DESC, pred_id, gt_id) AS l FROM {source} GROUP BY {keys}),
    {name} AS (SELECT {keys}, u.p AS pred_id, u.g AS gt_id, u.t AS tiou, u.n AS negative, u.a AS agree FROM (SELECT {keys}, unnest(list_reduce(list_transform(l, lambda c: [c]), lambda acc, c:
        CASE WHEN list_contains(list_transform(acc, lambda o: o.p), c[1].p) OR list_contains(list_transform(acc, lambda o: o.g), c[1].g) THEN acc ELSE list_append(acc, c[1]) END)) AS u FROM {name}_l))"""


def with_views(names: str, query: str) -> str:
    """The query with the named views (separated by blanks) before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
