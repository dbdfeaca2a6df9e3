"""Network queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query, r6
from placegraph.operators import graph as G
from placegraph.operators import network as N
from placegraph.session import materialise

HAV = "(2 * {r} * ASIN(SQRT(POWER(SIN(RADIANS({y2} - {y1}) / 2), 2) + COS(RADIANS({y1})) * COS(RADIANS({y2})) * POWER(SIN(RADIANS({x2} - {x1}) / 2), 2))))"


def hav(x1, y1, x2, y2, r="6378137.0"):
    return HAV.format(x1=x1, y1=y1, x2=x2, y2=y2, r=r)


EDGE_CTE = f"""
res AS (SELECT LEAST(l.a, l.b) AS a, GREATEST(l.a, l.b) AS b,
        CASE WHEN l.metres > 0 THEN l.metres ELSE {hav('n.lng', 'n.lat', 'm.lng', 'm.lat')} END AS metres
        FROM links l JOIN nodes n ON l.a = n.nid JOIN nodes m ON l.b = m.nid WHERE l.a <> l.b),
edges AS (SELECT a, b, ROUND(MIN(metres), 2) AS metres FROM res GROUP BY a, b)"""


def edges(spark, sf, nodes=None):
    # Written first: in one plan with joins, the view's expressions run many times slower (most likely methods too long for the JVM to compile).
    links, _ = materialise(B.links(spark, sf).select("a", "b", "metres"))
    e = N.weighted_edges(links, B.nodes(spark, sf) if nodes is None else nodes)
    return e.select("a", "b", F.round("metres", 2).alias("metres"))


@query("network_edges", f"WITH {EDGE_CTE} SELECT a, b, metres FROM edges", ("nodes", "links"))
def network_edges(spark, sf):
    return edges(spark, sf)


@query("dangling_links", """
SELECT e.ord, e.end_no AS "end", e.nid FROM (
  SELECT ord, CAST(0 AS BIGINT) AS end_no, a AS nid FROM links UNION ALL SELECT ord, CAST(1 AS BIGINT), b FROM links) e
WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.nid = e.nid)""", ("nodes", "links"))
def dangling_links(spark, sf):
    return N.dangling_ends(B.links(spark, sf), B.nodes(spark, sf))


@query("tidy_links", """
WITH flagged AS (SELECT l.*, CASE WHEN a = b THEN 'self' WHEN NOT (a IN (SELECT nid FROM nodes) AND b IN (SELECT nid FROM nodes)) THEN 'dangling' END AS r FROM links l),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY LEAST(a, b), GREATEST(a, b) ORDER BY ord) AS rn FROM flagged WHERE r IS NULL)
SELECT COALESCE(reason, 'kept') AS reason, CAST(COUNT(*) AS BIGINT) AS links, CAST(SUM(ord) AS BIGINT) AS ord_sum FROM (
  SELECT ord, r AS reason FROM flagged WHERE r IS NOT NULL
  UNION ALL SELECT ord, CASE WHEN rn > 1 THEN 'duplicate' END FROM ranked) GROUP BY 1""", ("nodes", "links"))
def tidy_links(spark, sf):
    t = N.tidy_links(B.links(spark, sf), B.nodes(spark, sf))
    return t.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("links"), F.sum("ord").alias("ord_sum"))


@query("symmetrise", """
WITH adj AS (SELECT DISTINCT a AS nid, b AS neighbour FROM links WHERE a <> b),
back AS (SELECT neighbour AS nid, nid AS neighbour FROM adj WHERE neighbour IN (SELECT nid FROM nodes))
SELECT nid, neighbour, FALSE AS added FROM adj
UNION ALL SELECT nid, neighbour, TRUE FROM (SELECT * FROM back EXCEPT SELECT * FROM adj)""", ("links", "nodes"))
def symmetrise(spark, sf):
    l = B.links(spark, sf).where("a <> b")
    return N.symmetrise(l.select(F.col("a").alias("nid"), F.col("b").alias("neighbour")), B.nodes(spark, sf))


@query("listed_neighbours", "SELECT a AS nid, b AS neighbour, COUNT(*) AS times FROM links GROUP BY 1, 2", ("links",))
def listed_neighbours(spark, sf):
    """Neighbours told by a comma-separated column, which is put together from the links first."""
    told = B.links(spark, sf).groupBy(F.col("a").alias("nid")).agg(F.array_join(F.collect_list("b"), " ,").alias("connections"))
    return N.neighbours_of(told).groupBy("nid", "neighbour").agg(F.count(F.lit(1)).alias("times"))


@query("node_degrees", """
WITH pairs AS (SELECT DISTINCT LEAST(a, b) AS a, GREATEST(a, b) AS b FROM links WHERE a <> b),
ends AS (SELECT a AS nid FROM pairs UNION ALL SELECT b FROM pairs)
SELECT n.nid, CAST(COUNT(e.nid) AS BIGINT) AS degree FROM nodes n LEFT JOIN ends e ON e.nid = n.nid GROUP BY n.nid""", ("nodes", "links"))
def node_degrees(spark, sf):
    return N.degrees(B.nodes(spark, sf), B.links(spark, sf))


LABEL_CTE = """
srt AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sheet, ord) AS p FROM spaces WHERE room IS NOT NULL),
lab AS (SELECT building, floor, room, MIN(p) AS first,
        ARG_MIN(TRIM(name), p) FILTER (WHERE name IS NOT NULL AND name <> '') AS name, ARG_MIN(COALESCE(type, 'room'), p) AS space
        FROM srt GROUP BY 1, 2, 3),
anyf AS (SELECT building, room, MIN(first) AS first FROM lab GROUP BY 1, 2),
labelled AS (SELECT n.nid, n.ord, n.building, n.floor, n.room, n.lng, n.lat, n.name AS node_name,
        CASE WHEN e.room IS NOT NULL THEN e.name ELSE g.name END AS name,
        CASE WHEN e.room IS NOT NULL THEN e.space ELSE g.space END AS space
        FROM nodes n LEFT JOIN lab e ON e.building = n.building AND e.floor = n.floor AND e.room = n.room
        LEFT JOIN anyf f ON f.building = n.building AND f.room = n.room
        LEFT JOIN lab g ON g.first = f.first)"""


@query("node_labels", f"WITH {LABEL_CTE} SELECT nid, node_name, name, space FROM labelled", ("nodes", "spaces"))
def node_labels(spark, sf):
    n = N.label_nodes(B.nodes(spark, sf), N.space_labels(B.spaces(spark, sf)))
    return n.select("nid", "node_name", "name", "space")


WELLS = f"""
wells AS (SELECT COALESCE(building, '(outdoors)') AS building, room, COALESCE(floor, '~') AS floor, nid, lng, lat FROM nodes
          WHERE space IN ('stairs', 'elevator') AND room IS NOT NULL),
fl AS (SELECT building, room, floor, LEAD(floor) OVER (PARTITION BY building, room ORDER BY floor) AS upper
       FROM (SELECT DISTINCT building, room, floor FROM wells)),
pairs AS (SELECT f.building, f.room, f.floor AS lower, f.upper, a.nid AS a, b.nid AS b,
          {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS d FROM fl f
          JOIN wells a ON a.building = f.building AND a.room = f.room AND a.floor = f.floor
          JOIN wells b ON b.building = f.building AND b.room = f.room AND b.floor = f.upper),
steps AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, room, lower, upper ORDER BY d, a, b) AS rn FROM pairs) WHERE rn = 1)"""


@query("stairwell_steps", f"WITH {WELLS} SELECT building, room, lower, upper, a, b, ROUND(d, 6) AS metres FROM steps", ("nodes",))
def stairwell_steps(spark, sf):
    return N.stairwell_steps(B.nodes(spark, sf)).withColumn("metres", r6("metres"))


@query("vertical_spaces", f"""
WITH {EDGE_CTE}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
hits AS (SELECT h.building, h.floor AS onto, t.room, t.space, t.floor, ROW_NUMBER() OVER (PARTITION BY h.building, h.floor, t.room ORDER BY h.ord, t.ord) AS rn
  FROM both_ways e JOIN nodes h ON e.a = h.nid JOIN nodes t ON e.b = t.nid
  WHERE h.building = t.building AND h.floor <> t.floor AND t.space IN ('stairs', 'elevator') AND t.room IS NOT NULL)
SELECT building, onto, room, space, floor FROM hits WHERE rn = 1""", ("nodes", "links"))
def vertical_spaces(spark, sf):
    return N.vertical_by_floor(B.nodes(spark, sf), edges(spark, sf)).select("building", "onto", "room", "space", "floor")


@query("unreachable_rooms", """
SELECT DISTINCT building, room FROM spaces s WHERE room IS NOT NULL AND COALESCE(type, 'room') = 'room'
AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.building = s.building AND n.room = s.room)""", ("nodes", "spaces"))
def unreachable_rooms(spark, sf):
    return N.unreachable_rooms(B.spaces(spark, sf), B.nodes(spark, sf))


@query("place_rollup", """
SELECT COALESCE(building, '(outdoors)') AS place, CAST(COUNT(*) AS BIGINT) AS nodes,
       COALESCE(STRING_AGG(DISTINCT floor, ',' ORDER BY floor), '') AS floors FROM nodes GROUP BY 1""", ("nodes",))
def place_rollup(spark, sf):
    return N.place_rollup(B.nodes(spark, sf))


@query("components", """
WITH RECURSIVE pairs AS (SELECT n.ord AS u, m.ord AS v FROM links l JOIN nodes n ON l.a = n.nid JOIN nodes m ON l.b = m.nid),
both_ways AS (SELECT DISTINCT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(ord, root) USING KEY (ord) AS (
  SELECT ord, ord FROM nodes
  UNION
  SELECT e.v, MIN(r.root) FROM reach r JOIN both_ways e ON e.u = r.ord JOIN recurring.reach old ON old.ord = e.v
  WHERE r.root < old.root GROUP BY e.v)
SELECT 'n' || CAST(ord AS STRING) AS nid, CAST(root AS BIGINT) AS component FROM reach""", ("nodes", "links"))
def components(spark, sf):
    return G.components(B.nodes(spark, sf), B.links(spark, sf)).select("nid", "component")


@query("first_wins_nodes", """
WITH sheet AS (SELECT 'n' || CAST(k * 2 AS STRING) AS nid, name AS building, k AS ord FROM (SELECT ord AS k, name FROM places)
   UNION ALL SELECT 's' || CAST(ord AS STRING), name, ord + 1000000000 FROM places),
u AS (SELECT nid, COALESCE(building, '') AS building, ord, 0 AS r FROM nodes UNION ALL SELECT nid, building, ord, 1 FROM sheet)
SELECT nid, building FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nid ORDER BY r, ord) AS rn FROM u) WHERE rn = 1""", ("nodes", "places"))
def first_wins_nodes(spark, sf):
    p = D.view(spark, sf, "places").select("ord", F.col("name").alias("building"))
    sheet = p.select(F.concat(F.lit("n"), (F.col("ord") * 2).cast("string")).alias("nid"), "building", "ord").unionByName(
        p.select(F.concat(F.lit("s"), F.col("ord").cast("string")).alias("nid"), "building", (F.col("ord") + 1000000000).alias("ord")))
    n = B.nodes(spark, sf).select("nid", F.coalesce("building", F.lit("")).alias("building"), "ord")
    return N.collect_nodes(n, sheet).select("nid", "building")


def labelled(spark, sf):
    return N.label_nodes(B.nodes(spark, sf), N.space_labels(B.spaces(spark, sf)))


@query("floor_view", """
WITH kinds AS (SELECT building, floor, room, ARG_MAX(type, ord) AS type FROM spaces WHERE room IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT n.nid, CASE WHEN n.building IS NULL THEN 'outside' WHEN n.building <> 'B3' THEN 'other'
        WHEN n.floor IS NULL OR n.floor = '2' THEN 'here' ELSE 'floor' END AS zone,
      COALESCE(n.building = 'B3' AND n.floor <> '2', FALSE) AS other_floor,
      COALESCE(k.type IN ('stairs', 'elevator'), FALSE) AS vertical
      FROM nodes n LEFT JOIN kinds k ON k.building = n.building AND k.floor = n.floor AND k.room = n.room)
SELECT nid, zone, other_floor, other_floor AND NOT vertical AS hidden FROM v""", ("nodes", "spaces"))
def floor_view(spark, sf):
    return _floor_view(spark, sf).select("nid", "zone", "other_floor", "hidden")


def _floor_view(spark, sf):
    from placegraph.operators.coverage import space_type_index

    return N.floor_view(B.nodes(spark, sf), space_type_index(B.spaces(spark, sf)), F.lit("B3"), F.lit("2"))


@query("hidden_links", """
WITH kinds AS (SELECT building, floor, room, ARG_MAX(type, ord) AS type FROM spaces WHERE room IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT n.nid FROM nodes n LEFT JOIN kinds k ON k.building = n.building AND k.floor = n.floor AND k.room = n.room
      WHERE n.building = 'B3' AND n.floor <> '2' AND NOT COALESCE(k.type IN ('stairs', 'elevator'), FALSE))
SELECT a IN (SELECT nid FROM v) OR b IN (SELECT nid FROM v) AS hidden, CAST(COUNT(*) AS BIGINT) AS links FROM links GROUP BY 1""", ("nodes", "spaces", "links"))
def hidden_links(spark, sf):
    h = N.hidden_links(B.links(spark, sf), _floor_view(spark, sf))
    return h.groupBy("hidden").agg(F.count(F.lit(1)).alias("links"))


@query("carried_outlines", f"""
WITH {EDGE_CTE}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
hits AS (SELECT h.building, h.floor AS onto, t.room, t.floor, ROW_NUMBER() OVER (PARTITION BY h.building, h.floor, t.room ORDER BY h.ord, t.ord) AS rn
  FROM both_ways e JOIN nodes h ON e.a = h.nid JOIN nodes t ON e.b = t.nid
  WHERE h.building = t.building AND h.floor <> t.floor AND t.space IN ('stairs', 'elevator') AND t.room IS NOT NULL),
shape AS (SELECT DISTINCT building, floor, room FROM spaces WHERE room IS NOT NULL)
SELECT h.building, h.onto, h.room, h.floor AS from_floor FROM hits h JOIN shape s ON s.building = h.building AND s.floor = h.floor AND s.room = h.room
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM shape d WHERE d.building = h.building AND d.floor = h.onto AND d.room = h.room)""", ("nodes", "links", "spaces"))
def carried_outlines(spark, sf):
    v = N.vertical_by_floor(B.nodes(spark, sf), edges(spark, sf))
    return N.carry_outlines(v, B.spaces(spark, sf)).select("building", "onto", "room", "from_floor")


def graph_inputs(spark, sf):
    """Nodes, rounded edges and the main component's nodes, written once for a search."""
    n, _ = materialise(B.nodes(spark, sf))
    e, _ = materialise(edges(spark, sf, n))
    comps, _ = materialise(G.components(n, e))
    return n, e, comps
