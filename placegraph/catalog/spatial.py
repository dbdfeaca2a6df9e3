"""Spatial queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query, r6
from placegraph.catalog.network import hav
from placegraph.functions import geo
from placegraph.operators import coverage as C
from placegraph.operators import graph as G
from placegraph.operators import spatial as S
from placegraph.catalog.network import edges

# Even-odd count of crossed edges per (node, outline), first outline by priority.
PLACE_CTE = """
hits AS (SELECT n.nid, e.ord, MIN(e.prio) AS prio, MIN(e.name) AS name FROM nodes n JOIN place_edges e
  ON (e.by > n.lat) <> (e.ay > n.lat) AND n.lng < (e.ax - e.bx) * (n.lat - e.by) / (e.ay - e.by) + e.bx
  GROUP BY n.nid, e.ord HAVING COUNT(*) % 2 = 1),
placed AS (SELECT n.*, h.name AS place FROM nodes n LEFT JOIN
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY nid ORDER BY prio, ord) AS rn FROM hits) h ON h.nid = n.nid AND h.rn = 1)"""
PV = ("nodes", "place_edges")


def placed(spark, sf):
    return S.place_of(B.nodes(spark, sf), B.outlines(spark, sf))


@query("place_of_node", f"WITH {PLACE_CTE} SELECT nid, place FROM placed", PV)
def place_of_node(spark, sf):
    return placed(spark, sf).select("nid", "place")


@query("place_of_node_empty", "SELECT nid, 'none' AS place FROM nodes", PV)
def place_of_node_empty(spark, sf):
    """No outline at all: every node is kept, outdoors."""
    none = B.outlines(spark, sf).where("prio < 0")
    return S.place_of(B.nodes(spark, sf), none).select("nid", F.coalesce("place", F.lit("none")).alias("place"))


@query("place_of_node_repeats", f"""WITH {PLACE_CTE}, twice AS (SELECT nid, place FROM placed UNION ALL SELECT nid, place FROM placed)
SELECT nid, COALESCE(place, 'none') AS place, CAST(COUNT(*) AS BIGINT) AS rows FROM twice GROUP BY 1, 2""", PV)
def place_of_node_repeats(spark, sf):
    """Equal rows are points of their own."""
    n = B.nodes(spark, sf)
    got = S.place_of(n.unionByName(n), B.outlines(spark, sf))
    return got.groupBy("nid", F.coalesce("place", F.lit("none")).alias("place")).agg(F.count(F.lit(1)).alias("rows"))


@query("nodes_per_place", f"""WITH {PLACE_CTE}
SELECT COALESCE(place, '(outdoors)') AS place, CAST(COUNT(*) AS BIGINT) AS nodes FROM placed GROUP BY 1""", PV)
def nodes_per_place(spark, sf):
    return placed(spark, sf).groupBy(F.coalesce("place", F.lit("(outdoors)")).alias("place")).agg(F.count(F.lit(1)).alias("nodes"))


@query("fill_blank_place", f"WITH {PLACE_CTE} SELECT nid, place AS building FROM placed WHERE building IS NULL AND place IS NOT NULL", PV)
def fill_blank_place(spark, sf):
    from placegraph.operators.naming import fill_blank_building

    return fill_blank_building(B.nodes(spark, sf), B.outlines(spark, sf)).where("filled").select("nid", "building")


@query("reassign_place", f"""WITH {PLACE_CTE}
SELECT COALESCE(building, 'outdoors') || ' -> ' || COALESCE(place, 'outdoors') AS move, CAST(COUNT(*) AS BIGINT) AS nodes,
  CAST(COUNT(CASE WHEN place IS NULL THEN NULL ELSE floor END) AS BIGINT) AS with_floor
FROM placed WHERE COALESCE(building, '') <> COALESCE(place, '') GROUP BY 1""", PV)
def reassign_place(spark, sf):
    from placegraph.operators.naming import reassign_buildings

    r = reassign_buildings(B.nodes(spark, sf), B.outlines(spark, sf)).where("moved")
    return r.groupBy("move").agg(F.count(F.lit(1)).alias("nodes"), F.count("floor").alias("with_floor"))


@query("split_network", f"""WITH {PLACE_CTE}, s AS (SELECT nid, COALESCE(building, 'B0') AS sheet_building, COALESCE(floor, '1') AS sheet_floor, place FROM placed)
SELECT nid, place AS building, CASE WHEN place = sheet_building THEN sheet_floor END AS floor, COALESCE(place, '') <> sheet_building AS moved FROM s""", PV)
def split_network(spark, sf):
    from placegraph.operators.naming import split_from_sheets

    n = B.nodes(spark, sf).withColumn("sheet_building", F.coalesce("building", F.lit("B0"))).withColumn("sheet_floor", F.coalesce("floor", F.lit("1")))
    return split_from_sheets(n.drop("building", "floor"), B.outlines(spark, sf)).select("nid", "building", "floor", "moved")


RECT = "s.building = n.building AND s.floor = n.floor AND (s.y1 + 20000000) / 1e6 > n.lat AND (s.y0 + 20000000) / 1e6 <= n.lat AND n.lng < (CAST(s.x1 - 123000000 AS DOUBLE)) / 1e6 AND n.lng >= (CAST(s.x0 - 123000000 AS DOUBLE)) / 1e6"
ROOM_CTE = f"""
held AS (SELECT n.nid, s.room, ROW_NUMBER() OVER (PARTITION BY n.nid ORDER BY (s.x1 - s.x0) * (s.y1 - s.y0), s.room) AS rn
  FROM nodes n JOIN spaces s ON {RECT} WHERE s.room IS NOT NULL AND s.type IS NOT NULL AND s.type <> 'building')"""


@query("room_of_node", f"WITH {ROOM_CTE} SELECT n.nid, h.room AS found_room FROM nodes n LEFT JOIN held h ON h.nid = n.nid AND h.rn = 1", ("nodes", "spaces"))
def room_of_node(spark, sf):
    sp = B.plan_spaces(spark, sf)
    n = _lattice(B.nodes(spark, sf))
    return S.room_of(n.withColumnRenamed("px", "lng").withColumnRenamed("py", "lat"), sp).select("nid", "found_room")


def _lattice(n):
    """Node positions on the integer lattice the spaces are drawn on."""
    return n.select("nid", "ord", "building", "floor", "room", F.round(F.col("lng") * 1e6 + 123000000).alias("px"),
                    F.round(F.col("lat") * 1e6 - 20000000).alias("py"))


@query("inside_any_space", f"SELECT n.nid, EXISTS (SELECT 1 FROM spaces s WHERE {RECT} AND s.type IS NOT NULL AND s.type <> 'building') AS inside FROM nodes n", ("nodes", "spaces"))
def inside_any_space(spark, sf):
    n = _lattice(B.nodes(spark, sf)).withColumnRenamed("px", "lng").withColumnRenamed("py", "lat")
    return S.inside_any(n, B.plan_spaces(spark, sf)).select("nid", "inside")


@query("match_rooms", f"""
WITH {ROOM_CTE} SELECT CASE WHEN n.room IS NOT NULL THEN 'already' WHEN n.building = 'B3' AND n.floor IS NOT NULL AND n.floor <> '2' THEN 'elsewhere'
  WHEN n.building = 'B3' AND COALESCE(n.floor, '2') = '2' AND h.room IS NOT NULL THEN 'named' ELSE 'outside' END AS action, CAST(COUNT(*) AS BIGINT) AS nodes
FROM nodes n LEFT JOIN (
  SELECT n.nid, s.room, ROW_NUMBER() OVER (PARTITION BY n.nid ORDER BY (s.x1 - s.x0) * (s.y1 - s.y0), s.room) AS rn
  FROM (SELECT nid, building, COALESCE(floor, '2') AS floor, lng, lat FROM nodes) n JOIN spaces s ON {RECT}
  WHERE s.room IS NOT NULL AND s.type IS NOT NULL AND s.type <> 'building' AND s.building = 'B3' AND s.floor = '2') h ON h.nid = n.nid AND h.rn = 1 GROUP BY 1""", ("nodes", "spaces"))
def match_rooms(spark, sf):
    from placegraph.operators.naming import match_rooms_on_sheet

    n = _lattice(B.nodes(spark, sf)).withColumnRenamed("px", "lng").withColumnRenamed("py", "lat")
    m = match_rooms_on_sheet(n, B.plan_spaces(spark, sf), "B3", "2")
    return m.groupBy("action").agg(F.count(F.lit(1)).alias("nodes"))


@query("space_overlap", """
WITH r AS (SELECT ord, building, floor, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM spaces)
SELECT a.building, a.floor, a.ord AS a_ord, b.ord AS b_ord,
  ROUND(CAST((LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) AS DOUBLE) / LEAST(a.area, b.area), 6) AS frac
FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.ord < b.ord
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""", ("spaces",))
def space_overlap(spark, sf):
    o = S.overlaps(B.plan_spaces(spark, sf), ["building", "floor"])
    return o.select("building", "floor", "a_ord", "b_ord", r6(F.col("common") / F.least("a_area", "b_area")).alias("frac"))


@query("nearest_node", f"""
WITH pts AS (SELECT ord, {D.lng_sql('cx')} AS lng, {D.lat_sql('cy')} AS lat FROM places),
d AS (SELECT p.ord, n.nid, n.ord AS n_ord, {hav('p.lng', 'p.lat', 'n.lng', 'n.lat', '6371000.0')} AS m FROM pts p CROSS JOIN nodes n)
SELECT ord, nid, ROUND(m, 6) AS metres FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ord ORDER BY m, n_ord) AS rn FROM d) WHERE rn = 1""", ("places", "nodes"))
def nearest_node(spark, sf):
    p = D.view(spark, sf, "places")
    lng, lat = B._deg("cx", "cy")
    near = S.nearest(p.select("ord", lng.alias("lng"), lat.alias("lat")), B.nodes(spark, sf), "ord", "nid", "ord")
    return near.select("ord", "nid", r6("metres").alias("metres"))


@query("nearest_in_reach", f"""
WITH pts AS (SELECT ord, {D.lng_sql('cx')} AS lng, {D.lat_sql('cy')} AS lat FROM places UNION ALL SELECT ord + 1000000, {D.lng_sql('cx + 500000')}, {D.lat_sql('cy')} FROM places),
d AS (SELECT p.ord, n.nid, n.ord AS n_ord, {hav('p.lng', 'p.lat', 'n.lng', 'n.lat', '6371000.0')} AS m FROM pts p JOIN nodes n ON ABS(p.lat - n.lat) < 0.001 AND ABS(p.lng - n.lng) < 0.002)
SELECT p.ord, COALESCE(nid, '') AS nid, ROUND(COALESCE(m, -1), 6) AS metres FROM pts p LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY ord ORDER BY m, n_ord) AS rn FROM d WHERE m <= 25) t ON t.ord = p.ord AND rn = 1""", ("places", "nodes"))
def nearest_in_reach(spark, sf):
    """The one nearest node within 25 m of each place, and of spots half a degree away; blank where none is."""
    p = D.view(spark, sf, "places")
    (lng, lat), (east, _) = B._deg("cx", "cy"), B._deg("cx + 500000", "cy")
    pts = p.select("ord", lng.alias("lng"), lat.alias("lat")).unionByName(p.select((F.col("ord") + 1000000).alias("ord"), east.alias("lng"), lat.alias("lat")))
    near = S.nearest(pts, B.nodes(spark, sf), "ord", "nid", "ord", reach_m=25.0)
    return pts.join(near, "ord", "left").select("ord", F.coalesce("nid", F.lit("")).alias("nid"), r6(F.coalesce("metres", F.lit(-1.0))).alias("metres"))


@query("nodes_in_reach", """
WITH l AS (SELECT nid, building, floor, ROUND(lng * 1e6 + 123000000) AS x, ROUND(lat * 1e6 - 20000000) AS y FROM nodes WHERE floor IS NOT NULL)
SELECT a.nid, COUNT(*) AS neighbours, ROUND(MIN(SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS nearest
FROM l a JOIN l b ON a.building = b.building AND a.floor = b.floor AND a.nid <> b.nid AND SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1500 GROUP BY a.nid""", ("nodes",))
def nodes_in_reach(spark, sf):
    n = _lattice(B.nodes(spark, sf)).where("floor IS NOT NULL").select("nid", "building", "floor", F.col("px").alias("x"), F.col("py").alias("y"))
    near = S.within_reach(n, n, 1500, on=["building", "floor"]).where("nid <> t_nid")
    return near.groupBy("nid").agg(F.count(F.lit(1)).alias("neighbours"), r6(F.min("d")).alias("nearest"))


RDIST = """SQRT(POWER(GREATEST(s.x0 - n.x, 0, n.x - s.x1), 2) + POWER(GREATEST(s.y0 - n.y, 0, n.y - s.y1), 2))"""


@query("nearest_space", f"""
WITH l AS (SELECT nid, building, floor, ROUND(lng * 1e6 + 123000000) AS x, ROUND(lat * 1e6 - 20000000) AS y FROM nodes),
d AS (SELECT n.nid, s.ord, {RDIST} AS d FROM l n JOIN spaces s ON s.building = n.building AND s.floor = n.floor)
SELECT nid, CAST(rank AS BIGINT) AS rank, ord, ROUND(d, 6) AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nid ORDER BY d, ord) AS rank FROM d WHERE d <= 2000) WHERE rank <= 3""", ("nodes", "spaces"))
def nearest_space(spark, sf):
    n = _lattice(B.nodes(spark, sf)).select("nid", "building", "floor", F.col("px").alias("x"), F.col("py").alias("y"))
    near = S.nearest_shapes(n, B.plan_spaces(spark, sf).select("ord", "building", "floor", "ring"), 2000.0, "nid", 3,
                            on=[("building", "building"), ("floor", "floor")])
    return near.select("nid", "rank", F.col("s_ord").alias("ord"), r6("d").alias("d"))


@query("doorways", """
SELECT a.building, a.floor, a.ord AS a_ord, b.ord AS b_ord,
 ROUND(SQRT(POWER(GREATEST(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + POWER(GREATEST(a.y0 - b.y1, b.y0 - a.y1, 0), 2)), 6) AS d
FROM spaces a JOIN spaces b ON a.building = b.building AND a.floor = b.floor AND a.ord < b.ord
WHERE (a.x0 > b.x1 OR b.x0 > a.x1 OR a.y0 > b.y1 OR b.y0 > a.y1)
  AND SQRT(POWER(GREATEST(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + POWER(GREATEST(a.y0 - b.y1, b.y0 - a.y1, 0), 2)) <= 300""", ("spaces",))
def doorways(spark, sf):
    sp = B.plan_spaces(spark, sf)
    d = S.doorways(sp, ["building", "floor"], 300.0)
    boxes = D.view(spark, sf, "spaces").select("ord", "x0", "y0", "x1", "y1")
    a = boxes.select(F.col("ord").alias("a_ord"), *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(F.col("ord").alias("b_ord"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    d = d.select("building", "floor", "a_ord", "b_ord", r6("d").alias("d")).join(a, "a_ord").join(b, "b_ord")
    return d.where("ax0 > bx1 OR bx0 > ax1 OR ay0 > by1 OR by0 > ay1").select("building", "floor", "a_ord", "b_ord", "d")


@query("sheet_bounds", """
SELECT building, floor, CAST(MIN(x0) AS DOUBLE) AS x0, CAST(MIN(y0) AS DOUBLE) AS y0, CAST(MAX(x1) AS DOUBLE) AS x1, CAST(MAX(y1) AS DOUBLE) AS y1,
 (MIN(x0) + MAX(x1)) / 2 AS cx, (MIN(y0) + MAX(y1)) / 2 AS cy FROM spaces GROUP BY 1, 2""", ("spaces",))
def sheet_bounds(spark, sf):
    return S.bounds(B.plan_spaces(spark, sf), ["building", "floor"])


@query("sheet_labels", """
SELECT building, floor, ord, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor ORDER BY (x1 - x0) * (y1 - y0) DESC, ord) AS rn FROM spaces) WHERE rn = 1""", ("spaces",))
def sheet_labels(spark, sf):
    return S.sheet_labels(B.plan_spaces(spark, sf), ["building", "floor"])


@query("fit_box", f"""
SELECT name, ROUND((MIN(x) + MAX(x)) / 2, 9) AS lng, ROUND((MIN(y) + MAX(y)) / 2, 9) AS lat,
 ROUND(GREATEST(20.0, (MAX(x) - MIN(x)) * COS(RADIANS((MIN(y) + MAX(y)) / 2)) * PI() * 6378137.0 / 180.0), 4) AS width_m
FROM place_vertices WHERE kind = 'building' GROUP BY name""", ("place_vertices",))
def fit_box(spark, sf):
    f = S.fit_box(B.outlines(spark, sf).where("kind = 'building'"), ["name"])
    return f.select("name", r6("lng", 9).alias("lng"), r6("lat", 9).alias("lat"), r6("width_m", 4).alias("width_m"))


@query("footprint_centres", """
SELECT name AS code, ROUND(AVG(x), 9) AS lng, ROUND(AVG(y), 9) AS lat, CAST(COUNT(*) AS BIGINT) AS vertices
FROM (SELECT name, x, y FROM place_vertices UNION ALL SELECT name, x, y FROM place_vertices WHERE seq = 0) GROUP BY name""", ("place_vertices",))
def footprint_centres(spark, sf):
    f = S.footprint_centres(B.outlines(spark, sf))
    return f.select("code", r6("lng", 9).alias("lng"), r6("lat", 9).alias("lat"), "vertices")


@query("place_centres", """
WITH v AS (SELECT name, display, x, y FROM place_vertices UNION ALL SELECT name, display, x, y FROM place_vertices WHERE seq = 0),
k AS (SELECT name AS n, x, y FROM v UNION ALL SELECT display, x, y FROM v WHERE display IS NOT NULL)
SELECT UPPER(n) AS label, MIN(n) AS name, ROUND(AVG(x), 9) AS lng, ROUND(AVG(y), 9) AS lat FROM k GROUP BY 1""", ("place_vertices",))
def place_centres(spark, sf):
    c = C.place_centres(B.outlines(spark, sf))
    return c.select("label", "name", r6("lng", 9).alias("lng"), r6("lat", 9).alias("lat"))


@query("parking_lots", """
WITH p AS (SELECT name, CASE WHEN ord % 3 = 0 THEN 'Staff' WHEN ord % 3 = 1 THEN 'Daily' ELSE '' END AS kind, cx, cy, hw, hh, ord FROM places WHERE kind = 'parking'),
k AS (SELECT name, COALESCE(STRING_AGG(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE kind <> ''), '') AS kinds FROM p GROUP BY name),
g AS (SELECT name, cx, cy, hw, hh, MIN(ord) AS ord FROM p GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY hw * hh DESC, ord) AS rn FROM g)
SELECT r.name, r.ord, k.kinds, r.rn = 1 AS label FROM r JOIN k ON k.name = r.name""", ("places",))
def parking_lots(spark, sf):
    p = B.outlines(spark, sf).where("kind = 'parking'").select(
        "name", F.when(F.col("ord") % 3 == 0, "Staff").when(F.col("ord") % 3 == 1, "Daily").otherwise("").alias("kind"), "ord", "ring")
    return C.parking_lots(p).select("name", "ord", "kinds", "label")


@query("main_network", f"""
WITH RECURSIVE pairs AS (SELECT n.ord AS u, m.ord AS v FROM links l JOIN nodes n ON l.a = n.nid JOIN nodes m ON l.b = m.nid),
both_ways AS (SELECT DISTINCT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(ord, root) USING KEY (ord) AS (
  SELECT ord, ord FROM nodes
  UNION
  SELECT e.v, MIN(r.root) FROM reach r JOIN both_ways e ON e.u = r.ord JOIN recurring.reach old ON old.ord = e.v WHERE r.root < old.root GROUP BY e.v),
sizes AS (SELECT root, COUNT(*) AS n FROM reach GROUP BY root)
SELECT 'n' || CAST(ord AS STRING) AS nid FROM reach WHERE root = (SELECT root FROM sizes ORDER BY n DESC, root LIMIT 1)""", ("nodes", "links"))
def main_network(spark, sf):
    n = B.nodes(spark, sf)
    return G.on_main(n, G.components(n, edges(spark, sf))).select("nid")
