"""Raster, audit, label and registration queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query, r6
from placegraph.functions import geo
from placegraph.operators import network as N
from placegraph.operators import quality as Q
from placegraph.operators import raster as R
from placegraph.operators import registration as G
from placegraph.operators.trimming import trim_overlaps
from placegraph.session import materialise


def cells(spark, sf):
    return D.view(spark, sf, "cells")


def moves(spark, sf):
    c, _ = materialise(cells(spark, sf))
    stairs = c.where("r = 2 AND c = 2").select("building", F.lit("A").alias("name"), "floor", "r", "c")
    ent = c.where("floor = 1 AND r = 5 AND c IN (0, 9)").select(
        "building", "floor", F.when(F.col("c") == 0, "entrance west").otherwise("entrance east").alias("label"), "r", "c", F.lit(0).alias("ord"))
    nxt = F.concat(F.lit("R"), (F.substr("building", F.lit(2)).cast("bigint") + 1).cast("string"))
    portals = ent.where("c = 9").select("building", "floor", F.lit("entrance east").alias("entrance"), nxt.alias("to_building"), F.lit(1).alias("to_floor"), F.lit("entrance west").alias("to_entrance"))
    return R.arcs(c, stairs, portals, ent)


SNAP = """
asked AS (SELECT query_id, 'start' AS side, building, floor, r, c FROM cell_requests UNION ALL SELECT query_id, 'goal', to_building, to_floor, to_r, to_c FROM cell_requests),
snap AS (SELECT query_id, side, building, floor, COALESCE(fr, r) AS r, COALESCE(fc, c) AS c FROM (SELECT a.*, f.r AS fr, f.c AS fc, ROW_NUMBER() OVER (PARTITION BY query_id, side ORDER BY ABS(a.r - f.r) + ABS(a.c - f.c), f.r, f.c) AS rn
  FROM asked a LEFT JOIN cells f ON f.building = a.building AND f.floor = a.floor AND NOT f.blocked) WHERE rn = 1)"""
CV = ("cells", "cell_requests")


def snapped(spark, sf):
    q = D.view(spark, sf, "cell_requests")
    key = lambda side: F.concat_ws(":", F.col("query_id").cast("string"), F.lit(side)).alias("key")
    both = q.select(key("start"), "building", "floor", "r", "c").unionByName(
        q.select(key("goal"), F.col("to_building").alias("building"), F.col("to_floor").alias("floor"), F.col("to_r").alias("r"), F.col("to_c").alias("c")))
    s = R.snap_to_free(both, cells(spark, sf), key="key")
    parts = F.split("key", ":")
    return s.select(parts[0].cast("bigint").alias("query_id"), parts[1].alias("side"), "building", "floor", "r", "c")


@query("snap_free", f"WITH {SNAP} SELECT query_id, side, building, CAST(floor AS BIGINT) AS floor, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM snap", CV)
def snap_free(spark, sf):
    return snapped(spark, sf).select("query_id", "side", "building", *[F.col(x).cast("bigint").alias(x) for x in ("floor", "r", "c")])


def cell_paths(spark, sf):
    s, _ = materialise(snapped(spark, sf))
    ends = lambda side: s.where(F.col("side") == side).select("query_id", R.cell_id().alias("nid"))
    return R.shortest_paths(moves(spark, sf), ends("start"), ends("goal"))


@query("raster_cost", f"""
WITH RECURSIVE {SNAP}, id AS (SELECT building || '|' || CAST(floor AS STRING) || '|' || CAST(r AS STRING) || '|' || CAST(c AS STRING) AS cell, * FROM cells),
arcs AS (SELECT a.cell AS a, b.cell AS b FROM id a JOIN id b ON a.building = b.building AND a.floor = b.floor AND ABS(a.r - b.r) + ABS(a.c - b.c) = 1 WHERE NOT b.blocked
  UNION ALL SELECT a.cell, b.cell FROM id a JOIN id b ON a.building = b.building AND a.floor <> b.floor AND a.r = 2 AND a.c = 2 AND b.r = 2 AND b.c = 2
  UNION ALL SELECT a.cell, b.cell FROM id a JOIN id b ON b.building = 'R' || CAST(CAST(SUBSTR(a.building, 2) AS BIGINT) + 1 AS STRING) AND a.floor = 1 AND b.floor = 1 AND a.r = 5 AND a.c = 9 AND b.r = 5 AND b.c = 0),
ends AS (SELECT query_id, side, building || '|' || CAST(floor AS STRING) || '|' || CAST(r AS STRING) || '|' || CAST(c AS STRING) AS cell FROM snap),
far(query_id, cell, dist) USING KEY (query_id, cell) AS (SELECT query_id, cell, 0 FROM ends WHERE side = 'start' UNION
  SELECT f.query_id, a.b, MIN(f.dist + 1) FROM far f JOIN arcs a ON a.a = f.cell LEFT JOIN recurring.far o ON o.query_id = f.query_id AND o.cell = a.b WHERE o.cell IS NULL OR f.dist + 1 < o.dist GROUP BY 1, 2)
SELECT f.query_id, CAST(f.dist AS DOUBLE) AS cost FROM far f JOIN ends e ON e.query_id = f.query_id AND e.cell = f.cell AND e.side = 'goal'""", CV)
def raster_cost(spark, sf):
    answers, _ = cell_paths(spark, sf)
    return answers.select("query_id", "cost")


@query("smoothed_paths")
def smoothed_paths(spark, sf):
    """Raster walks with points in sight dropped; checked by brute force in the tests."""
    _, path = cell_paths(spark, sf)
    parts = F.split("cell", r"\|")
    p = path.select("query_id", "step", parts[0].alias("building"), parts[1].cast("int").alias("floor"), parts[2].cast("int").alias("r"), parts[3].cast("int").alias("c"))
    return R.smooth_paths(p, cells(spark, sf)).select("query_id", "step", "building", "floor", "r", "c")


@query("segment_cells", """
WITH l AS (SELECT query_id, r AS r1, c AS c1, to_r AS r2, to_c AS c2, ABS(to_r - r) AS dr, ABS(to_c - c) AS dc FROM cell_requests),
t AS (SELECT DISTINCT query_id, CASE WHEN dc = 0 THEN k ELSE k * dc END AS t FROM l, (SELECT UNNEST(RANGE(0, 11)) AS k) WHERE k <= dr UNION SELECT DISTINCT query_id, CASE WHEN dr = 0 THEN k ELSE k * dr END FROM l, (SELECT UNNEST(RANGE(0, 11)) AS k) WHERE k <= dc)
SELECT l.query_id, CAST(r1 + SIGN(r2 - r1) * CASE WHEN dr = 0 THEN 0 WHEN dc = 0 THEN t ELSE FLOOR(t / dc) END AS BIGINT) AS r, CAST(c1 + SIGN(c2 - c1) * CASE WHEN dc = 0 THEN 0 WHEN dr = 0 THEN t ELSE FLOOR(t / dr) END AS BIGINT) AS c
FROM l JOIN t ON t.query_id = l.query_id""", CV)
def segment_cells(spark, sf):
    q = D.view(spark, sf, "cell_requests")
    return q.select("query_id", F.explode(R.cells_on_segment("r", "c", "to_r", "to_c")).alias("p")).select("query_id", F.col("p.r").cast("bigint").alias("r"), F.col("p.c").cast("bigint").alias("c"))


@query("drawing_grid", """
WITH v AS (SELECT building, floor, x0, y0, x1, y1 FROM spaces), b AS (SELECT building, floor, MIN(x0) AS lx, MAX(x1) AS hx, MIN(y0) AS ly, MAX(y1) AS hy FROM v GROUP BY 1, 2),
g AS (SELECT building, floor, lx - (hx - lx) * 0.02e0 AS min_x, hx + (hx - lx) * 0.02e0 AS max_x, ly - (hy - ly) * 0.02e0 AS min_y, hy + (hy - ly) * 0.02e0 AS max_y FROM b),
k AS (SELECT v.building, v.floor, CAST(FLOOR((v.x0 - g.min_x) / 100) AS BIGINT) AS c0, CAST(FLOOR((v.x1 - g.min_x) / 100) AS BIGINT) AS c1, CAST(FLOOR((g.max_y - v.y1) / 100) AS BIGINT) AS r0, CAST(FLOOR((g.max_y - v.y0) / 100) AS BIGINT) AS r1 FROM v JOIN g ON g.building = v.building AND g.floor = v.floor),
c AS (SELECT building, floor, UNNEST(RANGE(c0, c1 + 1)) AS c, r0 AS r FROM k UNION SELECT building, floor, UNNEST(RANGE(c0, c1 + 1)), r1 FROM k UNION SELECT building, floor, c0, UNNEST(RANGE(r0, r1 + 1)) FROM k UNION SELECT building, floor, c1, UNNEST(RANGE(r0, r1 + 1)) FROM k)
SELECT building, floor, COUNT(*) AS cells, CAST(SUM(r) AS BIGINT) AS r_sum, CAST(SUM(c) AS BIGINT) AS c_sum FROM c GROUP BY 1, 2""", ("spaces",))
def drawing_grid(spark, sf):
    v = B.plan_spaces(spark, sf).select("building", "floor", "ord", F.posexplode("ring").alias("seq", "p")).select("building", "floor", "ord", "seq", "p.x", "p.y")
    seg = R.drawing_segments(R.drop_small(v, ["building", "floor", "ord"]), ["building", "floor", "ord"])
    c, _ = R.rasterise(seg, ["building", "floor"], 100.0)
    return c.groupBy("building", "floor").agg(F.count(F.lit(1)).alias("cells"), F.sum("r").alias("r_sum"), F.sum("c").alias("c_sum"))


@query("cropped_drawing", """
WITH v AS (SELECT * FROM spaces WHERE NOT (x0 BETWEEN 2000 AND 2400 AND (y0 BETWEEN 2000 AND 2400 OR y1 BETWEEN 2000 AND 2400) OR x1 BETWEEN 2000 AND 2400 AND (y0 BETWEEN 2000 AND 2400 OR y1 BETWEEN 2000 AND 2400))),
b AS (SELECT building, floor, MIN(x0) AS lx, MAX(x1) AS hx, MIN(y0) AS ly, MAX(y1) AS hy FROM v GROUP BY 1, 2),
w AS (SELECT *, CAST(FLOOR((hx - lx) / 50) AS BIGINT) + 1 AS w, CAST(FLOOR((CAST(FLOOR((hy - ly) / 50) AS BIGINT) + 1) * 0.9e0) AS BIGINT) AS h FROM b),
z AS (SELECT *, CAST(FLOOR(h / 1.1e0) AS BIGINT) AS nh, CAST(FLOOR(w / 1.1e0) AS BIGINT) AS nw FROM w),
e AS (SELECT building, floor, lx + FLOOR((w - nw) / 2) * 50 AS wx1, lx + (FLOOR((w - nw) / 2) + nw) * 50 AS wx2, hy - (FLOOR((h - nh) / 2) + nh) * 50 AS wy1, hy - FLOOR((h - nh) / 2) * 50 AS wy2 FROM z),
s AS (SELECT building, floor, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS b_y FROM v UNION ALL SELECT building, floor, x1, y0, x1, y1 FROM v UNION ALL SELECT building, floor, x1, y1, x0, y1 FROM v UNION ALL SELECT building, floor, x0, y1, x0, y0 FROM v)
SELECT s.building, s.floor, COUNT(*) AS segments FROM s JOIN e ON e.building = s.building AND e.floor = s.floor
WHERE (ax BETWEEN wx1 AND wx2 AND ay BETWEEN wy1 AND wy2) OR (bx BETWEEN wx1 AND wx2 AND b_y BETWEEN wy1 AND wy2) GROUP BY 1, 2""", ("spaces",))
def cropped_drawing(spark, sf):
    keys = ["building", "floor", "ord"]
    v = B.plan_spaces(spark, sf).select(*keys, F.posexplode("ring").alias("seq", "p")).select(*keys, "seq", "p.x", "p.y")
    seg = R.drawing_segments(R.erase_box(v, 2000, 2000, 2400, 2400, keys), keys)
    return R.crop_to_window(seg, ["building", "floor"], 50.0).groupBy("building", "floor").agg(F.count(F.lit(1)).alias("segments"))


# -- audits -------------------------------------------------------------------

@query("overlap_audit", """
WITH r AS (SELECT ord, building, floor, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM spaces),
p AS (SELECT a.building, a.floor, CAST((LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) AS DOUBLE) AS common, LEAST(a.area, b.area) AS small
  FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.ord < b.ord AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
g AS (SELECT building, floor, COUNT(*) AS pairs, MAX(common / small) AS worst, SUM(common) AS shared FROM p WHERE common / small >= 0.05 GROUP BY 1, 2)
SELECT t.building, t.floor, t.n AS n_rooms, COALESCE(g.pairs, 0) AS overlap_pairs, ROUND(COALESCE(g.worst, 0), 6) AS worst_overlap_frac, ROUND(COALESCE(g.shared, 0) / t.total, 6) AS total_overlap_area_frac
FROM (SELECT building, floor, COUNT(*) AS n, SUM(area) AS total FROM r GROUP BY 1, 2) t LEFT JOIN g ON g.building = t.building AND g.floor = t.floor""", ("spaces",))
def overlap_audit(spark, sf):
    a = Q.overlap_audit(B.plan_spaces(spark, sf).select("building", "floor", "ord", "ring"))
    return a.select("building", "floor", "n_rooms", "overlap_pairs", r6("worst_overlap_frac").alias("worst_overlap_frac"), r6("total_overlap_area_frac").alias("total_overlap_area_frac"))


@query("worst_overlaps", """
WITH r AS (SELECT ord, building, floor, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM spaces),
p AS (SELECT a.building, a.floor, CAST((LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) AS DOUBLE) / LEAST(a.area, b.area) AS frac
  FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.ord < b.ord AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT building, floor, ROUND(MAX(frac), 6) AS worst FROM p GROUP BY 1, 2 HAVING MAX(frac) >= 0.25""", ("spaces",))
def worst_overlaps(spark, sf):
    """Floors with an overlap of a quarter of the smaller space, worst first."""
    a = Q.overlap_audit(B.plan_spaces(spark, sf).select("building", "floor", "ord", "ring"))
    return Q.worst_first(a, "worst_overlap_frac", 0.25).select("building", "floor", r6("worst_overlap_frac").alias("worst"))


@query("cell_centres", "SELECT building, floor, CAST(SUM(100.0 + c * 2.5 + 1.25) AS DOUBLE) AS x, CAST(SUM(900.0 - r * 2.5 - 1.25) AS DOUBLE) AS y FROM cells GROUP BY 1, 2", ("cells",))
def cell_centres(spark, sf):
    """Centres of all cells of a floor, in plan units."""
    at = R.cell_centre(F.col("r"), F.col("c"), F.lit(100.0), F.lit(900.0), F.lit(2.5))
    return cells(spark, sf).select("building", "floor", at.alias("p")).groupBy("building", "floor").agg(F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))


LX, LY = "RADIANS({x} - o.x0) * COS(RADIANS(o.y0)) * 6378137.0", "RADIANS({y} - o.y0) * 6378137.0"


@query("alignment_audit", f"""
WITH o AS (SELECT name AS building, AVG(x) AS x0, AVG(y) AS y0 FROM (SELECT name, x, y FROM place_vertices WHERE kind = 'building' UNION ALL SELECT name, x, y FROM place_vertices WHERE kind = 'building' AND seq = 0) GROUP BY 1),
e AS (SELECT p.name AS building, p.ord, {LX.format(x='p.ax')} AS ax, {LY.format(y='p.ay')} AS ay, {LX.format(x='p.bx')} AS bx, {LY.format(y='p.by')} AS by FROM place_edges p JOIN o ON o.building = p.name WHERE p.prio = 0),
s AS (SELECT s.building, s.floor, s.ord, {LX.format(x=D.lng_sql('s.x0'))} AS x0, {LX.format(x=D.lng_sql('s.x1'))} AS x1, {LY.format(y=D.lat_sql('s.y0'))} AS y0, {LY.format(y=D.lat_sql('s.y1'))} AS y1 FROM spaces s JOIN o ON o.building = s.building),
c AS (SELECT building, ax AS x FROM e UNION SELECT a.building, a.ax + (a.bx - a.ax) * ((b.ax - a.ax) * (b.by - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / ((a.bx - a.ax) * (b.by - b.ay) - (a.by - a.ay) * (b.bx - b.ax))
  FROM e a JOIN e b ON a.building = b.building AND a.ord < b.ord AND (a.bx - a.ax) * (b.by - b.ay) <> (a.by - a.ay) * (b.bx - b.ax)),
x AS (SELECT ord, x0 AS x FROM s UNION SELECT ord, x1 FROM s UNION SELECT s.ord, c.x FROM s JOIN c ON c.building = s.building AND c.x > s.x0 AND c.x < s.x1
  UNION SELECT s.ord, e.ax + (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) FROM s JOIN e ON e.building = s.building AND e.by <> e.ay, unnest([s.y0, s.y1]) t(y) WHERE e.ax + (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) > s.x0 AND e.ax + (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) < s.x1),
b AS (SELECT * FROM (SELECT ord, x AS l, LEAD(x) OVER (PARTITION BY ord ORDER BY x) AS r FROM x) WHERE r IS NOT NULL),
v AS (SELECT b.ord, b.l, b.r, e.ord AS part, GREATEST(MIN(e.ay + (e.by - e.ay) * ((b.l + b.r) / 2 - e.ax) / (e.bx - e.ax)), s.y0) AS lo, LEAST(MAX(e.ay + (e.by - e.ay) * ((b.l + b.r) / 2 - e.ax) / (e.bx - e.ax)), s.y1) AS hi
  FROM b JOIN s ON s.ord = b.ord JOIN e ON e.building = s.building AND LEAST(e.ax, e.bx) < (b.l + b.r) / 2 AND GREATEST(e.ax, e.bx) > (b.l + b.r) / 2 GROUP BY b.ord, b.l, b.r, e.ord, s.y0, s.y1),
w AS (SELECT *, MAX(hi) OVER (PARTITION BY ord, l ORDER BY lo, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v WHERE hi > lo),
n AS (SELECT ord, SUM((r - l) * GREATEST(hi - GREATEST(lo, COALESCE(top, lo)), 0)) AS inside FROM w GROUP BY 1),
r AS (SELECT building, floor, s.ord, (x1 - x0) * (y1 - y0) AS area, (x1 - x0) * (y1 - y0) - COALESCE(n.inside, 0) AS outside FROM s LEFT JOIN n ON n.ord = s.ord)
SELECT building, floor, ROUND(100 * SUM(outside) / SUM(area), 4) + 0 AS pct, COUNT(CASE WHEN outside > area / 2 THEN 1 END) AS mostly, COUNT(*) AS polygons, TRUE AS measurable FROM r GROUP BY 1, 2
UNION ALL SELECT DISTINCT building, floor, -1, 0, 0, FALSE FROM spaces WHERE building NOT IN (SELECT building FROM o)""", ("spaces", "place_vertices", "place_edges"))
def alignment_audit(spark, sf):
    """Exact areas outside, without slack; round corners of a slack are checked in the tests."""
    foot = B.outlines(spark, sf).where("kind = 'building'").select(F.col("name").alias("building"), "ring")
    a = Q.alignment_audit(B.spaces(spark, sf).select("building", "floor", "ord", "ring"), foot, slack_m=0.0)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return a.select("building", "floor", F.round(F.coalesce("pct_area_outside", F.lit(-1.0)), 4).alias("pct"), n("rooms_mostly_outside").alias("mostly"), n("polygons").alias("polygons"), "measurable")


@query("stair_stacking", f"""
WITH o AS (SELECT building, floor, (SUM(2 * {D.lng_sql('x0')} + {D.lng_sql('x0')} + 2 * {D.lng_sql('x1')})) / (5 * COUNT(*)) AS cx, (SUM(2 * {D.lat_sql('y0')} + {D.lat_sql('y0')} + 2 * {D.lat_sql('y1')})) / (5 * COUNT(*)) AS cy FROM spaces GROUP BY 1, 2),
b AS (SELECT building, MIN(floor) AS b_floor, COUNT(*) AS floors FROM o GROUP BY 1 HAVING COUNT(*) >= 2),
bb AS (SELECT b.*, o.cx AS bx, o.cy AS by FROM b JOIN o ON o.building = b.building AND o.floor = b.b_floor),
v AS (SELECT s.building, s.floor, s.ord, RADIANS((3 * {D.lng_sql('x0')} + 2 * {D.lng_sql('x1')}) / 5 - bb.bx) * COS(RADIANS(bb.by)) * 6378137.0 AS x, RADIANS((3 * {D.lat_sql('y0')} + 2 * {D.lat_sql('y1')}) / 5 - bb.by) * 6378137.0 AS y, bb.b_floor
  FROM spaces s JOIN bb ON bb.building = s.building WHERE s.type IN ('stairs', 'elevator', 'shaft')),
m AS (SELECT l.building, l.ord, u.floor, MIN(SQRT(POWER(l.x - u.x, 2) + POWER(l.y - u.y, 2))) AS d FROM v l JOIN v u ON u.building = l.building WHERE l.floor = l.b_floor AND u.floor <> l.b_floor GROUP BY 1, 2, 3),
k AS (SELECT building, COUNT(*) AS matched, MAX(d) AS worst FROM m WHERE d <= 40 GROUP BY 1), n AS (SELECT building, COUNT(*) AS n FROM v WHERE floor = b_floor GROUP BY 1),
dr AS (SELECT bb.building, MAX(SQRT(POWER(RADIANS(o.cx - bb.bx) * COS(RADIANS(bb.by)) * 6378137.0, 2) + POWER(RADIANS(o.cy - bb.by) * 6378137.0, 2))) AS drift FROM bb JOIN o ON o.building = bb.building GROUP BY 1)
SELECT bb.building, bb.floors, COALESCE(k.matched, 0) AS matched, COALESCE(n.n, 0) * (bb.floors - 1) - COALESCE(k.matched, 0) AS unmatched, ROUND(COALESCE(k.worst, -1), 2) AS worst, ROUND(dr.drift, 1) AS drift
FROM bb LEFT JOIN k ON k.building = bb.building LEFT JOIN n ON n.building = bb.building JOIN dr ON dr.building = bb.building""", ("spaces",))
def stair_stacking(spark, sf):
    s = Q.stair_stacking(B.spaces(spark, sf), match_m=40.0)
    return s.select("building", "floors", "matched", "unmatched", F.coalesce("matched_worst_m", F.lit(-1.0)).alias("worst"), F.col("center_drift_m").alias("drift"))


# -- labels -------------------------------------------------------------------

LAB = r"""
d0 AS (SELECT *, REGEXP_REPLACE(TRANSLATE(raw, 'OoDQUCcIl|LTJiZzSsGbeBgqA', '0000000111111122556668994'), '[^0-9]', '', 'g') AS d FROM label_reads),
d1 AS (SELECT *, CASE WHEN REGEXP_MATCHES(d, '^\d{2,5}$') THEN d END AS n FROM d0),
us AS (SELECT building, floor, len AS usual FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor ORDER BY c DESC, o) AS rn FROM (SELECT building, floor, LENGTH(n) AS len, COUNT(*) AS c, MIN(ord) AS o FROM d1 WHERE n IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1),
d2 AS (SELECT d1.*, CASE WHEN LENGTH(n) >= usual THEN SUBSTR(n, 1, CAST(usual AS INT)) END AS m FROM d1 LEFT JOIN us ON us.building = d1.building AND us.floor = d1.floor),
d3 AS (SELECT *, CASE WHEN kind IN ('stairs', 'elevator') THEN NULL ELSE m END AS room FROM d2),
d4 AS (SELECT * FROM d3 WHERE room IS NULL OR SUBSTR(room, 1, 1) = SUBSTR(floor, 1, 1)),
ex AS (SELECT building, floor, len AS expected FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor ORDER BY c DESC, o) AS rn FROM (SELECT building, floor, LENGTH(room) AS len, COUNT(*) AS c, MIN(ord) AS o FROM d4 WHERE anchor AND room IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1),
pf AS (SELECT building, floor, SUBSTR(room, 1, 2) AS prefix, COUNT(*) AS c FROM d4 WHERE anchor AND room IS NOT NULL GROUP BY 1, 2, 3),
tw AS (SELECT building, floor, MAX(c) >= 2 AS twice FROM pf GROUP BY 1, 2),
cm AS (SELECT pf.* FROM pf JOIN tw ON tw.building = pf.building AND tw.floor = pf.floor WHERE c >= 2 OR NOT twice),
gr AS (SELECT d4.*, CASE WHEN room IS NULL THEN 'low' WHEN ex.expected IS NULL OR LENGTH(room) = ex.expected THEN CASE WHEN cm.prefix IS NOT NULL OR tw.twice IS NULL THEN 'high' ELSE 'medium' END END AS confidence
  FROM d4 LEFT JOIN ex ON ex.building = d4.building AND ex.floor = d4.floor LEFT JOIN cm ON cm.building = d4.building AND cm.floor = d4.floor AND cm.prefix = SUBSTR(room, 1, 2) LEFT JOIN tw ON tw.building = d4.building AND tw.floor = d4.floor),
kept AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor, room ORDER BY area DESC, ord) AS rn FROM gr WHERE confidence IS NOT NULL)"""


@query("label_cleanup", f"WITH {LAB} SELECT building, floor, ord, kind, COALESCE(room, '') AS room, confidence FROM kept WHERE room IS NULL OR rn = 1", ("label_reads",))
def label_cleanup(spark, sf):
    g = Q.graded_rooms(D.view(spark, sf, "label_reads"))
    return g.select("building", "floor", "ord", "kind", F.coalesce("room", F.lit("")).alias("room"), "confidence")


@query("extraction_report", f"WITH {LAB} SELECT building, floor, COUNT(*) AS features, CAST(0 AS BIGINT) AS doors, COUNT(CASE WHEN confidence = 'high' THEN 1 END) AS high_confidence, COUNT(CASE WHEN confidence <> 'high' THEN 1 END) AS needs_review FROM kept WHERE room IS NULL OR rn = 1 GROUP BY 1, 2", ("label_reads",))
def extraction_report(spark, sf):
    g = Q.graded_rooms(D.view(spark, sf, "label_reads")).withColumn("type", F.col("kind")).withColumn("residual", F.lit(float("nan")))
    return Q.extraction_report(g).drop("residual_m")


@query("label_kinds")
def label_kinds(spark, sf):
    """Types of labels by keyword or likeness, over label reads and every word of the documents."""
    r = D.view(spark, sf, "label_reads").select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("id"), "raw")
    d = D.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.upper("text").alias("raw"))
    return Q.classify_labels(r.unionByName(d), key="id").select("id", "kind")


@query("dropped_overlaps", """
WITH r AS (SELECT ord, building, floor, room, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM spaces),
p AS (SELECT a.building, a.floor, a.ord, b.room FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.ord <> b.ord AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE CAST((LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) AS DOUBLE) / LEAST(a.area, b.area) >= 0.3),
m AS (SELECT building, floor, ord, COUNT(room) AS labelled FROM p GROUP BY 1, 2, 3), md AS (SELECT building, floor, QUANTILE_CONT(area, 0.5) AS med FROM r WHERE room IS NOT NULL GROUP BY 1, 2)
SELECT r.ord, m.ord IS NOT NULL AND (r.room IS NULL OR (COALESCE(r.area > 3 * md.med, FALSE) AND m.labelled >= 2)) AS dropped
FROM r LEFT JOIN m ON m.building = r.building AND m.floor = r.floor AND m.ord = r.ord LEFT JOIN md ON md.building = r.building AND md.floor = r.floor""", ("spaces",))
def dropped_overlaps(spark, sf):
    return Q.drop_overlaps(B.plan_spaces(spark, sf).select("building", "floor", "ord", "room", "ring")).select("ord", "dropped")


@query("trimmed_overlaps", """
WITH RECURSIVE r AS (SELECT ord, building, floor, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM spaces),
p AS (SELECT a.ord, b.ord AS other, b.area AS size, b.x0, b.y0, b.x1, b.y1 FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.area > b.area
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE CAST((LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) AS DOUBLE) / b.area >= 0.02),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ord ORDER BY size DESC, other) AS k FROM p),
lines AS (SELECT r.ord, list_sort(list_distinct([r.x0, r.x1] || list_filter(flatten(list([c.x0, c.x1])), lambda v: v > r.x0 AND v < r.x1))) AS xs,
  list_sort(list_distinct([r.y0, r.y1] || list_filter(flatten(list([c.y0, c.y1])), lambda v: v > r.y0 AND v < r.y1))) AS ys FROM r JOIN k c ON c.ord = r.ord GROUP BY r.ord, r.x0, r.x1, r.y0, r.y1),
grid AS (SELECT ord, xs, ys, list_filter(list_transform(range(0, (len(xs) - 1) * (len(ys) - 1)), lambda n: {'i': n // (len(ys) - 1) + 1, 'j': n % (len(ys) - 1) + 1}), lambda c: TRUE) AS cells FROM lines),
step(ord, k, cells, cuts) AS (
  SELECT ord, 1, cells, 0 FROM grid
  UNION ALL
  SELECT ord, k + 1, CASE WHEN good THEN cand ELSE cells END, cuts + CASE WHEN good THEN 1 ELSE 0 END FROM (
    SELECT ord, k, cells, cuts, cand, size < now AND len(cand) > 0 AND rest >= 0.5 * now
      AND len(list_reduce(list_transform(range(0, len(cand)), lambda t: cand), lambda acc, l: list_filter(l, lambda c: len(list_filter(acc, lambda d: abs(c.i - d.i) + abs(c.j - d.j) <= 1)) > 0), list_slice(cand, 1, 1))) = len(cand) AS good
    FROM (SELECT *, list_sum(list_transform(cells, lambda c: (xs[c.i + 1] - xs[c.i]) * (ys[c.j + 1] - ys[c.j]))) AS now, COALESCE(list_sum(list_transform(cand, lambda c: (xs[c.i + 1] - xs[c.i]) * (ys[c.j + 1] - ys[c.j]))), 0) AS rest
      FROM (SELECT s.ord, s.k, s.cells, s.cuts, c.size, g.xs, g.ys, list_filter(s.cells, lambda q: NOT (g.xs[q.i] >= c.x0 AND g.xs[q.i + 1] <= c.x1 AND g.ys[q.j] >= c.y0 AND g.ys[q.j + 1] <= c.y1)) AS cand
        FROM step s JOIN k c ON c.ord = s.ord AND c.k = s.k JOIN grid g ON g.ord = s.ord)))),
last AS (SELECT s.*, g.xs, g.ys FROM step s JOIN grid g ON g.ord = s.ord WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ord = s.ord AND k.k = s.k)),
told AS (SELECT ord, cuts, list_sum(list_transform(cells, lambda c: (xs[c.i + 1] - xs[c.i]) * (ys[c.j + 1] - ys[c.j]))) AS area,
  list_sum(list_transform(cells, lambda c: (xs[c.i + 1] - xs[c.i]) * ((CASE WHEN list_contains(cells, {'i': c.i, 'j': c.j - 1}) THEN 0 ELSE 1 END) + (CASE WHEN list_contains(cells, {'i': c.i, 'j': c.j + 1}) THEN 0 ELSE 1 END))
    + (ys[c.j + 1] - ys[c.j]) * ((CASE WHEN list_contains(cells, {'i': c.i - 1, 'j': c.j}) THEN 0 ELSE 1 END) + (CASE WHEN list_contains(cells, {'i': c.i + 1, 'j': c.j}) THEN 0 ELSE 1 END)))) AS outline FROM last)
SELECT r.ord, CAST(COALESCE(t.cuts, 0) AS BIGINT) AS cuts, CAST(COALESCE(t.area, r.area) AS DOUBLE) AS area, CAST(COALESCE(t.outline, 2 * (r.x1 - r.x0 + r.y1 - r.y0)) AS DOUBLE) AS outline
FROM r LEFT JOIN told t ON t.ord = r.ord""", ("spaces",))
def trimmed_overlaps(spark, sf):
    """Area and length of outline of every traced space after the larger of two overlapping ones was cut back."""
    t = trim_overlaps(B.plan_spaces(spark, sf).select("building", "floor", "ord", "ring"))
    length = lambda ring: F.aggregate(geo.edges(ring), F.lit(0.0), lambda acc, e: acc + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    total = lambda of: F.aggregate("holes", F.lit(0.0), lambda acc, h: acc + of(h))
    return t.select("ord", "cuts", (geo.area("ring") - total(geo.area)).alias("area"), (length("ring") + total(length)).alias("outline"))


@query("off_plan", """
WITH o AS (SELECT building, floor, ARG_MIN(x0, ord) - 2000 AS x0, ARG_MIN(y0, ord) - 2000 AS y0, ARG_MIN(x1, ord) + 2000 AS x1, ARG_MIN(y1, ord) + 2000 AS y1 FROM spaces GROUP BY 1, 2),
f AS (SELECT s.building, s.floor, s.ord, SQRT(POWER(GREATEST(o.x0 - cx, 0, cx - o.x1), 2) + POWER(GREATEST(o.y0 - cy, 0, cy - o.y1), 2)) > 0.01 * SQRT(POWER(o.x1 - o.x0, 2) + POWER(o.y1 - o.y0, 2)) AS off
  FROM (SELECT *, (3 * x0 + 2 * x1) / 5 AS cx, (3 * y0 + 2 * y1) / 5 AS cy FROM spaces) s JOIN o ON o.building = s.building AND o.floor = s.floor)
SELECT ord, off AND SUM(CAST(off AS INT)) OVER (PARTITION BY building, floor) <= COUNT(*) OVER (PARTITION BY building, floor) * 0.5 AS dropped FROM f""", ("spaces",))
def off_plan(spark, sf):
    s = B.plan_spaces(spark, sf).select("building", "floor", "ord", "ring")
    o = D.view(spark, sf, "spaces").groupBy("building", "floor").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "ord").alias("b"))
    e = lambda c, by: F.col("b." + c).cast("double") + by
    o = o.select("building", "floor", geo.rectangle(e("x0", -2000), e("y0", -2000), e("x1", 2000), e("y1", 2000)).alias("ring"))
    return Q.trim_off_plan(s, o).select("ord", "dropped")


@query("regions_absorbed", """
WITH RECURSIVE r AS (SELECT ord, building, floor, room IS NOT NULL AND ord % 3 = 0 AS lab, x0, y0, x1, y1, (3 * x0 + 2 * x1) / 5 AS x, (3 * y0 + 2 * y1) / 5 AS y FROM spaces),
t AS (SELECT a.ord AS a, b.ord AS b, a.lab AS la, b.lab AS lb FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.ord <> b.ord AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
reach(ord, root) USING KEY (ord) AS (SELECT ord, ord FROM r WHERE NOT lab UNION SELECT t.b, MIN(x.root) FROM reach x JOIN t ON t.a = x.ord AND NOT t.la AND NOT t.lb JOIN recurring.reach old ON old.ord = t.b WHERE x.root < old.root GROUP BY t.b),
met AS (SELECT DISTINCT x.root, t.b AS owner, o.x AS ox, o.y AS oy FROM reach x JOIN t ON t.a = x.ord AND t.lb JOIN r o ON o.ord = t.b)
SELECT ord, owner FROM (SELECT i.ord, m.owner, ROW_NUMBER() OVER (PARTITION BY i.ord ORDER BY POWER(i.x - m.ox, 2) + POWER(i.y - m.oy, 2), m.owner) AS rn FROM reach x JOIN r i ON i.ord = x.ord JOIN met m ON m.root = x.root) WHERE rn = 1""", ("spaces",))
def regions_absorbed(spark, sf):
    from placegraph.operators import spatial as S

    s, _ = materialise(B.plan_spaces(spark, sf).select("building", "floor", "ord", "ring", (F.col("room").isNotNull() & (F.col("ord") % 3 == 0)).alias("labelled"), geo.vertex_mean("ring").alias("m")))
    touching, _ = materialise(S.overlapping_boxes(s.select("building", "floor", "ord", "ring"), ["building", "floor"]).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")))
    return Q.absorb_regions(s.select("ord", "labelled", "m.x", "m.y"), touching)


# -- registration -------------------------------------------------------------

@query("edge_angle", """
WITH e AS (SELECT name, CAST(FLOOR((DEGREES(ATAN2(CAST(ROUND((p.by - ay) * 1e6) AS DOUBLE), CAST(ROUND((bx - ax) * 1e6) AS DOUBLE))) + 360) % 90) AS BIGINT) AS bin, SQRT(POWER(ROUND((bx - ax) * 1e6), 2) + POWER(ROUND((p.by - ay) * 1e6), 2)) AS len FROM place_edges p)
SELECT name, bin AS angle FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY len DESC, bin) AS rn FROM (SELECT name, bin, ROUND(SUM(len), 3) AS len FROM e GROUP BY 1, 2)) WHERE rn = 1""", ("place_edges",))
def edge_angle(spark, sf):
    o = B.outlines(spark, sf)
    whole = geo.map_ring("ring", lambda x, y: F.round(x * 1e6 + 123000000), lambda x, y: F.round(y * 1e6 - 20000000))
    return G.dominant_angle(o.select("name", whole.alias("ring")), ["name"])


@query("principal_angle", """
SELECT building, floor, ROUND(DEGREES(0.5 * ATAN2(2 * COVAR_POP(x0, y0), VAR_POP(x0) - VAR_POP(y0))), 6) AS angle FROM spaces GROUP BY 1, 2 HAVING COUNT(*) > 2""", ("spaces",))
def principal_angle(spark, sf):
    s = D.view(spark, sf, "spaces").select("building", "floor", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    a = G.principal_angle(s, ["building", "floor"]).where("n > 2")
    return a.select("building", "floor", r6(F.degrees("angle")).alias("angle"))


@query("similarity_fit", """
WITH p AS (SELECT building, floor, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CAST(3 * x0 - 4 * y0 + 100 + ord % 7 AS DOUBLE) AS u, CAST(4 * x0 + 3 * y0 - 50 + ord % 5 AS DOUBLE) AS v FROM spaces),
m AS (SELECT building, floor, AVG(x) AS mx, AVG(y) AS my, AVG(u) AS mu, AVG(v) AS mv FROM p GROUP BY 1, 2 HAVING COUNT(*) > 2),
s AS (SELECT p.building, p.floor, SUM((x - mx) * (u - mu) + (y - my) * (v - mv)) AS a, SUM((x - mx) * (v - mv) - (y - my) * (u - mu)) AS b, SUM(POWER(x - mx, 2) + POWER(y - my, 2)) AS q FROM p JOIN m ON m.building = p.building AND m.floor = p.floor GROUP BY 1, 2)
SELECT building, floor, ROUND(SQRT(a * a + b * b) / q, 6) AS scale, ROUND(DEGREES(ATAN2(b, a)), 6) AS theta FROM s""", ("spaces",))
def similarity_fit(spark, sf):
    s = D.view(spark, sf, "spaces")
    d = lambda e, n: F.expr(e).cast("double").alias(n)
    p = s.select("building", "floor", d("x0", "x"), d("y0", "y"), d("3 * x0 - 4 * y0 + 100 + ord % 7", "u"), d("4 * x0 + 3 * y0 - 50 + ord % 5", "v"))
    f = G.similarity_fit(p, ["building", "floor"]).where("n > 2")
    return f.select("building", "floor", r6("scale").alias("scale"), r6(F.degrees("theta")).alias("theta"))


@query("plan_hulls")
def plan_hulls(spark, sf):
    """Convex hull of every floor's outline points; checked by brute force in the tests."""
    s = D.view(spark, sf, "spaces").select("building", "floor", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    return G.convex_hulls(s, ["building", "floor"])
