"""Coverage, index and type queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query
from placegraph.functions import text
from placegraph.operators import coverage as C
from placegraph.operators import network as N

INDEX_CTE = """
idx AS (SELECT building || '-' || room AS label, building, floor, room, NULLIF(TRIM(name), '') AS name, COALESCE(type, 'room') AS type, sheet AS source, ord
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building, floor, room ORDER BY sheet, ord) AS rn FROM spaces
       WHERE room IS NOT NULL AND COALESCE(type, 'room') = 'room') WHERE rn = 1)"""


def index(spark, sf):
    return C.index_rooms(B.spaces(spark, sf))


@query("room_index", f"WITH {INDEX_CTE} SELECT *, CASE WHEN name IS NULL THEN label ELSE label || ' ' || name END AS query FROM idx", ("spaces",))
def room_index(spark, sf):
    return index(spark, sf)


@query("coverage", f"WITH {INDEX_CTE} SELECT COUNT(DISTINCT building) AS buildings, COUNT(DISTINCT building || '|' || floor) AS floors, COUNT(*) AS rooms FROM idx", ("spaces",))
def coverage(spark, sf):
    return C.coverage(index(spark, sf))


@query("coverage_rollup", f"WITH {INDEX_CTE} SELECT building, floor, CAST(GROUPING(building, floor) AS BIGINT) AS level, COUNT(*) AS rooms FROM idx GROUP BY ROLLUP (building, floor)", ("spaces",))
def coverage_rollup(spark, sf):
    return C.coverage_rollup(index(spark, sf))


@query("buildings_with_plans", f"WITH {INDEX_CTE} SELECT building AS code, COUNT(DISTINCT floor) AS floors, COUNT(*) AS rooms FROM idx GROUP BY building", ("spaces",))
def buildings_with_plans(spark, sf):
    return C.buildings_with_plans(index(spark, sf))


@query("floors_per_building", f"""WITH {INDEX_CTE}, b AS (SELECT DISTINCT name AS code, CAST(SUBSTR(name, 2) AS BIGINT) AS num FROM places WHERE kind = 'building')
SELECT b.code, COALESCE((SELECT STRING_AGG(DISTINCT floor, ',' ORDER BY floor) FROM idx WHERE idx.building = b.code),
   CASE WHEN b.num % 2 = 0 THEN '1,2' ELSE '1' END) AS floors FROM b""", ("spaces", "places"))
def floors_per_building(spark, sf):
    p = D.view(spark, sf, "places").where("kind = 'building'").select(F.col("name").alias("code")).distinct()
    num = F.substr("code", F.lit(2)).cast("bigint")
    b = p.withColumn("declared", F.when(num % 2 == 0, F.array(F.lit("2"), F.lit("1"))))
    return C.floors_of_buildings(b, index(spark, sf)).select("code", F.array_join("floors", ",").alias("floors"))


@query("rooms_per_floor", f"WITH {INDEX_CTE} SELECT building, floor, room, name, type FROM idx", ("spaces",))
def rooms_per_floor(spark, sf):
    return C.rooms_in_order(index(spark, sf))


@query("room_siblings", f"WITH {INDEX_CTE} SELECT building, floor, room, COUNT(*) OVER (PARTITION BY building, floor) - 1 AS siblings FROM idx", ("spaces",))
def room_siblings(spark, sf):
    return N.siblings(index(spark, sf))


@query("name_ambiguity", f"""WITH {INDEX_CTE} SELECT UPPER(name) AS name, COUNT(*) AS rooms, CASE WHEN COUNT(*) = 1 THEN MIN(building) END AS building,
 CASE WHEN COUNT(*) = 1 THEN MIN(room) END AS room FROM idx WHERE name IS NOT NULL GROUP BY 1""", ("spaces",))
def name_ambiguity(spark, sf):
    return C.rooms_by_name(index(spark, sf))


@query("natural_sort", f"WITH {INDEX_CTE} SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY CAST(SUBSTR(building, 2) AS BIGINT), CAST(room AS BIGINT), floor) AS BIGINT) AS pos FROM idx", ("spaces",))
def natural_sort(spark, sf):
    """Position of every room in natural order, numbered without one global window."""
    from placegraph.operators.common import number_rows

    idx = index(spark, sf)
    # Buildings and rooms end in numbers, so the natural key is also an integer order.
    b = F.substr("building", F.lit(2)).cast("bigint")
    keyed = idx.withColumn("_seq", b * 100000 + F.col("room").cast("bigint")).withColumn("_k", text.natural_key("label")).withColumn("_all", F.lit(1))
    return number_rows(keyed, ["_all"], "_seq", "pos", tie=["_k", "floor"]).select("label", "pos")


@query("network_tally", "SELECT (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(*) FROM links) AS links", ("nodes", "links"))
def network_tally(spark, sf):
    return C.network_tally(B.nodes(spark, sf), B.links(spark, sf))


@query("places_with_nodes", "SELECT COALESCE(building, '(outdoors)') AS place, COUNT(*) AS nodes FROM nodes GROUP BY 1", ("nodes",))
def places_with_nodes(spark, sf):
    return N.places_with_nodes(B.nodes(spark, sf))


RETYPE = """
rt AS (SELECT *, COALESCE(type, 'room') AS old_type, CASE COALESCE(type, 'room') WHEN 'corridor' THEN 'hallway' WHEN 'washroom' THEN 'room' WHEN 'storage' THEN 'service'
 WHEN 'mech' THEN 'service' WHEN 'elec' THEN 'service' WHEN 'plant' THEN 'service'
 WHEN 'shaft' THEN CASE WHEN LOWER(COALESCE(name, '')) LIKE '%elevator%' OR LOWER(COALESCE(name, '')) LIKE '%lift%' THEN 'elevator' ELSE 'service' END
 WHEN 'room' THEN 'room' WHEN 'hallway' THEN 'hallway' WHEN 'stairs' THEN 'stairs' WHEN 'elevator' THEN 'elevator' WHEN 'building' THEN 'building' ELSE 'service' END AS new_type FROM spaces)"""


@query("retype", f"""WITH {RETYPE} SELECT ord, old_type, new_type, CASE WHEN new_type = 'room' AND (LOWER(name) LIKE '%washroom%' OR LOWER(name) LIKE '%restroom%'
 OR LOWER(name) LIKE '%toilet%' OR LOWER(name) LIKE '%lavatory%') THEN 'washroom' END AS amenity FROM rt""", ("spaces",))
def retype(spark, sf):
    return C.retyped(B.spaces(spark, sf)).select("ord", "old_type", "new_type", "amenity")


@query("type_moves", f"WITH {RETYPE} SELECT old_type || ' -> ' || new_type AS move, COUNT(*) AS spaces FROM rt WHERE old_type <> new_type GROUP BY 1", ("spaces",))
def type_moves(spark, sf):
    return C.type_moves(B.spaces(spark, sf))


@query("map_features", """SELECT ord, CASE WHEN type IN ('stairs', 'elevator') THEN 'icon-' || type WHEN name LIKE 'Restroom%' AND COALESCE(type, 'room') IN ('room', 'washroom') THEN 'icon-washroom' END AS icon, room AS label FROM spaces""", ("spaces",))
def map_features(spark, sf):
    s = B.spaces(spark, sf)
    a = C.retyped(s).select("ord", "amenity")
    return C.map_features(s.join(a, "ord")).select("ord", "icon", "label")


@query("space_types", """SELECT building, floor, room, ARG_MAX(type, ord) AS type FROM spaces WHERE room IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3""", ("spaces",))
def space_types(spark, sf):
    return C.space_type_index(B.spaces(spark, sf))
