"""Checks, lookups and small merges over the given tables."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query, r6
from placegraph.catalog.rollups import INDEX_CTE, index
from placegraph.functions import clock, text
from placegraph.operators import activity as A
from placegraph.operators import changes as X
from placegraph.operators import naming as M
from placegraph.operators import network as N
from placegraph.operators import spatial as S
from placegraph.operators import timetable as T


@query("check_sheets", """SELECT ord, kind, error FROM (
 SELECT ord, 'Polygon' AS kind, CASE WHEN ord % 11 = 0 THEN 'OUTLINE_TOO_SHORT' ELSE '' END AS error FROM spaces
 UNION ALL SELECT ord, 'Point', CASE WHEN ord % 13 = 0 THEN 'MARKER_WITHOUT_POINT' WHEN ord % 5 > 2 THEN 'MARKER_OVERLINKED' ELSE '' END FROM nodes
 UNION ALL SELECT ord, CASE WHEN ord % 19 = 0 THEN 'Circle' ELSE 'LineString' END,
  CASE WHEN ord % 19 = 0 THEN 'SHAPE_UNKNOWN' WHEN ord % 7 = 0 THEN 'PATH_NOT_TWO_POINTS' WHEN ord % 3 = 0 THEN 'PATH_NOT_TWO_NODES' ELSE '' END FROM links)""", ("spaces", "nodes", "links"))
def check_sheets(spark, sf):
    some = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    s = B.plan_spaces(spark, sf).select("ord", F.lit("Polygon").alias("geom_type"), some(F.when(F.col("ord") % 11 == 0, 3).otherwise(5)).alias("points"), some(F.lit(0)).alias("connects"), some(F.lit(0)).alias("nodes"))
    n = B.nodes(spark, sf).select("ord", F.lit("Point").alias("geom_type"), some(F.when(F.col("ord") % 13 == 0, 0).otherwise(1)).alias("points"), some(F.col("ord") % 5).alias("connects"), some(F.lit(0)).alias("nodes"))
    k = B.links(spark, sf).select("ord", F.when(F.col("ord") % 19 == 0, "Circle").otherwise("LineString").alias("geom_type"), some(F.when(F.col("ord") % 7 == 0, 1).otherwise(2)).alias("points"),
                                  some(F.lit(0)).alias("connects"), some(F.when(F.col("ord") % 3 == 0, 1).otherwise(2)).alias("nodes"))
    return X.check_sheet(s.unionByName(n).unionByName(k)).select("ord", F.col("geom_type").alias("kind"), F.coalesce("error", F.lit("")).alias("error"))


@query("check_points", """SELECT ord, CASE WHEN ord % 10 = 0 OR ord % 10 = 4 THEN false ELSE true END AS valid, SUBSTR(COALESCE(name, '') || REPEAT('-', 79), 1, 80) AS label FROM nodes""", ("nodes",))
def check_points(spark, sf):
    n = B.nodes(spark, sf).select("ord", F.when(F.col("ord") % 10 == 0, F.col("lng") + 400).otherwise(F.col("lng")).alias("lng"),
                                  F.when(F.col("ord") % 10 == 4, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"),
                                  F.concat(F.coalesce("name", F.lit("")), F.lit("-" * 79)).alias("label"))
    return X.check_ends(n).select("ord", "valid", "label")


@query("nodes_on_floors", """SELECT c.building, c.floor, n.nid FROM (SELECT DISTINCT building, floor FROM nodes WHERE building IS NOT NULL AND floor IS NOT NULL) c
JOIN nodes n ON n.building = c.building AND (n.floor IS NULL OR n.floor = c.floor)""", ("nodes",))
def nodes_on_floors(spark, sf):
    n = B.nodes(spark, sf)
    return S.in_mode_places(n, n.where("building IS NOT NULL AND floor IS NOT NULL").select("building", "floor").distinct())


@query("link_end_lookup", """SELECT l.ord, l.b AS nid, n.nid IS NOT NULL AS found, COALESCE(n.room, '') AS room FROM links l LEFT JOIN nodes n ON n.nid = l.b""", ("links", "nodes"))
def link_end_lookup(spark, sf):
    asks = B.links(spark, sf).select("ord", F.col("b").alias("nid"))
    return A.look_up(asks, B.nodes(spark, sf).select("nid", "room"), ["nid"]).select("ord", "nid", "found", F.coalesce("room", F.lit("")).alias("room"))


@query("link_ends", """SELECT ord, a, b, a IN (SELECT nid FROM nodes) AS a_known, b IN (SELECT nid FROM nodes) AS b_known,
 ROW_NUMBER() OVER (PARTITION BY LEAST(a, b), GREATEST(a, b) ORDER BY ord) > 1 AS repeated FROM links""", ("links", "nodes"))
def link_ends(spark, sf):
    return N.link_ends(B.links(spark, sf), B.nodes(spark, sf))


@query("siblings_of_first_rooms", f"""WITH {INDEX_CTE}, asked AS (SELECT building, floor, MIN(room) AS room FROM idx GROUP BY 1, 2)
SELECT a.building, a.floor, a.room, i.room AS sibling FROM asked a JOIN idx i ON i.building = a.building AND i.floor = a.floor AND i.room <> a.room""", ("spaces",))
def siblings_of_first_rooms(spark, sf):
    i = index(spark, sf)
    return N.siblings_of(i.groupBy("building", "floor").agg(F.min("room").alias("room")), i)


@query("take_back_places", """SELECT nid, CASE WHEN ord % 4 = 0 THEN 'Z' || CAST(ord % 9 AS STRING) ELSE COALESCE(building, '') END AS building FROM nodes""", ("nodes",))
def take_back_places(spark, sf):
    n = B.nodes(spark, sf)
    placed = n.where("ord % 4 = 0").select("nid", F.concat(F.lit("Z"), (F.col("ord") % 9).cast("string")).alias("building"))
    return M.take_placements(n, placed).select("nid", F.coalesce("building", F.lit("")).alias("building"))


PROFILES = """cur AS (SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, c_mktsegment AS theme, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS label FROM customer WHERE c_custkey % 2 = 0),
inc AS (SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS theme,
 CASE WHEN o_orderkey % 5 > 1 THEN NULL ELSE 'L' || CAST(o_orderkey AS STRING) END AS label FROM orders)"""


def _profiles(spark, sf):
    c, o = D.table(spark, sf, "customer"), D.table(spark, sf, "orders")
    cur = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_mktsegment").alias("theme"),
                                              F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("label"))
    inc = o.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("theme"),
                   F.when(F.col("o_orderkey") % 5 <= 1, F.concat(F.lit("L"), F.col("o_orderkey").cast("string"))).alias("label"))
    return cur, inc


def _filled(df):
    return df.select("user_id", F.coalesce("theme", F.lit("")).alias("theme"), F.coalesce("label", F.lit("")).alias("label"))


@query("profiles_merged", f"""WITH {PROFILES}, last AS (SELECT user_id, arg_max(theme, seq) FILTER (WHERE theme IS NOT NULL) AS theme, arg_max(label, seq) FILTER (WHERE label IS NOT NULL) AS label FROM inc GROUP BY 1)
SELECT COALESCE(c.user_id, l.user_id) AS user_id, COALESCE(l.theme, c.theme, '') AS theme, COALESCE(l.label, c.label, '') AS label FROM cur c FULL JOIN last l ON l.user_id = c.user_id""")
def profiles_merged(spark, sf):
    return _filled(A.merge_profiles(*_profiles(spark, sf)))


@query("profiles_ensured", f"""WITH {PROFILES}, first AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM inc)
SELECT user_id, COALESCE(theme, '') AS theme, COALESCE(label, '') AS label FROM cur
UNION ALL SELECT user_id, COALESCE(theme, ''), COALESCE(label, '') FROM first WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM cur)""")
def profiles_ensured(spark, sf):
    return _filled(A.ensure_profiles(*_profiles(spark, sf)))


@query("session_expiry", "SELECT event_id, epoch_us(ts) + 432000000000 AS expires FROM activity", ("activity",))
def session_expiry(spark, sf):
    a = D.view(spark, sf, "activity").select("event_id", clock.expiry("ts", 432000).alias("e"))
    return a.select("event_id", clock.micros("e").alias("expires"))


@query("place_texts", """SELECT ord, CASE WHEN building IS NULL THEN 'outdoors' ELSE building END || CASE WHEN floor IS NULL THEN '' ELSE ' floor ' || floor END || CASE WHEN room IS NULL THEN '' ELSE ' · ' || room END AS place,
 CASE WHEN building IS NOT NULL AND room IS NOT NULL THEN building || ' · ' || room WHEN building IS NOT NULL AND floor IS NOT NULL THEN building || ' · Floor ' || floor
  WHEN building IS NOT NULL THEN building WHEN room IS NOT NULL THEN room ELSE 'Selected point' END AS label FROM nodes""", ("nodes",))
def place_texts(spark, sf):
    return B.nodes(spark, sf).select("ord", text.where_is("building", "floor", "room").alias("place"), text.room_label("building", "floor", "room").alias("label"))


@query("class_days", """SELECT ord, STRING_AGG(CAST(d AS STRING), ',' ORDER BY d) AS days FROM (SELECT DISTINCT ord, d FROM (
 SELECT ord, day_bits % 9 AS d FROM classes UNION ALL SELECT ord, day_bits % 7 FROM classes UNION ALL SELECT ord, day_bits % 5 FROM classes) WHERE d <= 6) GROUP BY 1""", ("classes",))
def class_days(spark, sf):
    c = D.view(spark, sf, "classes").select("ord", "building", "room", F.lit("").alias("floor"), F.array(*[(F.col("day_bits") % m).cast("int") for m in (9, 7, 5)]).alias("days"))
    return T.clean_classes(c).select("ord", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"))


@query("room_doors", """WITH k AS (SELECT *, CASE WHEN type = 'corridor' THEN 'corridor' WHEN type IN ('room', 'stairs') AND room IS NOT NULL THEN 'room' END AS kind FROM spaces),
m AS (SELECT *, MAX(CASE WHEN kind = 'corridor' THEN 1 ELSE 0 END) OVER (PARTITION BY building, floor) AS any_c FROM k WHERE kind IS NOT NULL),
p AS (SELECT a.building, a.floor, a.ord, b.ord AS other, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM m a JOIN m b
 ON a.building = b.building AND a.floor = b.floor AND a.ord <> b.ord AND a.kind = 'room' AND (b.kind = 'corridor') = (a.any_c = 1)
 WHERE GREATEST(a.x0 - b.x1, b.x0 - a.x1, a.y0 - b.y1, b.y0 - a.y1) <= 300),
c AS (SELECT building, floor, ord, other, UNNEST([x0, x1, x1, x0]) AS px, UNNEST([y0, y0, y1, y1]) AS py, u0 AS l, v0 AS b, u1 AS r, v1 AS t FROM p
 UNION ALL SELECT building, floor, ord, other, UNNEST([u0, u1, u1, u0]), UNNEST([v0, v0, v1, v1]), x0, y0, x1, y1 FROM p),
d AS (SELECT building, floor, ord, other, MIN(CASE WHEN px > l AND px < r AND py > b AND py < t THEN LEAST(px - l, r - px, py - b, t - py)
 ELSE SQRT(POWER(GREATEST(l - px, px - r, 0), 2) + POWER(GREATEST(b - py, py - t, 0), 2)) END) AS d FROM c GROUP BY 1, 2, 3, 4)
SELECT building, floor, ord, other, ROUND(CAST(d AS DOUBLE), 6) AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor, ord ORDER BY d, other) AS rn FROM d WHERE d <= 300) WHERE rn = 1""", ("spaces",))
def room_doors(spark, sf):
    return S.room_doors(B.plan_spaces(spark, sf), ["building", "floor"], 300.0).select("building", "floor", "ord", "other", r6("d").alias("d"))
