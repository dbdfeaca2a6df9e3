"""Round trips through the library's files: what is written is read back and compared with where it came from."""

import uuid

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query, r6
from placegraph.catalog.network import EDGE_CTE, edges
from placegraph.catalog.rollups import INDEX_CTE, index
from placegraph.catalog.routing import ROWS, stored_routes
from placegraph.functions import geo
from placegraph.operators import network as N
from placegraph.session import run_folder
from placegraph.sources import features as R
from placegraph.sources import sinks


def _folder(spark) -> str:
    return f"{run_folder(spark)}/store-{uuid.uuid4().hex}"


def _network_lines(spark, sf):
    """The network written as a document of feature lines and read again."""
    none = F.lit(None).cast("string")
    nodes = B.nodes(spark, sf).select(F.lit("node").alias("type"), "nid", none.alias("a"), none.alias("b"), "building", "floor", "room", "name", "lng", "lat")
    paths = B.links(spark, sf).select(F.lit("path").alias("type"), none.alias("nid"), "a", "b", *[none.alias(c) for c in ("building", "floor", "room", "name")], *[F.lit(None).cast("double").alias(c) for c in ("lng", "lat")])
    root = _folder(spark)
    sinks.write_network(nodes.unionByName(paths), root, 1)
    return R.parse_features(R.read_feature_lines(spark, f"{root}/lines/version=1"))


@query("network_document_nodes", "SELECT nid, building, floor, room, name, ROUND(lng, 7) AS lng, ROUND(lat, 7) AS lat FROM nodes", ("nodes",))
def network_document_nodes(spark, sf):
    return R.network_nodes(_network_lines(spark, sf)).select("nid", "building", "floor", "room", "name", "lng", "lat")


@query("network_document_links", "SELECT a, b, COUNT(*) AS links FROM links GROUP BY 1, 2", ("links",))
def network_document_links(spark, sf):
    return R.network_links(_network_lines(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"))


def _sheet_documents(spark, sf):
    """A GeoJSON document for each sheet, its spaces as polygons, those of every third place in a bare collection of another kind."""
    s = B.plan_spaces(spark, sf).select("ord", "building", "floor", "room", "type", "name", "ring")
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("type", "room", "name").alias("properties"), shape.alias("geometry"))
    source = F.concat("building", F.lit("-Floor"), "floor", F.lit(".geojson"))
    return s.groupBy(source.alias("source")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(3).alias("version"), F.collect_list(feature).alias("features"))).alias("doc"))


@query("sheet_document_spaces", """
SELECT building, floor, COALESCE(room, '') AS room, type, COUNT(*) AS shapes, CAST(SUM((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area FROM spaces GROUP BY 1, 2, 3, 4""", ("spaces",))
def sheet_document_spaces(spark, sf):
    rows, _ = R.normalise_roots(_sheet_documents(spark, sf))
    s = R.sheet_spaces(R.parse_features(rows))
    return s.groupBy("building", "floor", F.coalesce("room", F.lit("")).alias("room"), "type").agg(F.count(F.lit(1)).alias("shapes"), F.sum(geo.area("ring")).alias("area"))


@query("document_rejects", "SELECT building || '-Floor' || floor AS sheet, CASE MIN(ord) % 3 WHEN 0 THEN 'TopoJSON' WHEN 1 THEN 'not GeoJSON' ELSE 'not a JSON document' END AS reason FROM spaces GROUP BY building, floor", ("spaces",))
def document_rejects(spark, sf):
    """Documents that are no GeoJSON, one for each sheet."""
    d = D.view(spark, sf, "spaces").groupBy("building", "floor").agg(F.min("ord").alias("o")).select(
        F.concat("building", F.lit("-Floor"), "floor").alias("source"), F.when(F.col("o") % 3 == 0, '{"type":"Topology","arcs":[]}').when(F.col("o") % 3 == 1, '{"type":"Else"}').otherwise("{nope").alias("doc"))
    _, bad = R.normalise_roots(d)
    return bad.select(F.col("source").alias("sheet"), "reason")


@query("named_outline_sources", """
SELECT kind, COALESCE(NULLIF(TRIM(name), ''), display) AS name, COUNT(*) AS rings FROM places GROUP BY 1, 2""", ("places",))
def named_outline_sources(spark, sf):
    """Outlines of each source under the first filled of its name keys."""
    o = B.outlines(spark, sf)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("name").alias("Code"), F.col("display").alias("Title")).alias("properties"), shape.alias("geometry")))
    parts = [R.named_outlines(R.parse_features(o.where(F.col("kind") == kind).select(F.lit(kind).alias("source"), "ord", feature.alias("feature"))), prio, kind, ["Code", "Title"])
             for prio, kind in enumerate(("building", "parking", "field", "other"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = o.select("kind").distinct()
    return out.join(known, "kind", "left_semi").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("rings"))


@query("centre_index", f"SELECT name AS code, ROUND(AVG({D.lng_sql('cx')}), 9) AS lng, ROUND(AVG({D.lat_sql('cy')}), 9) AS lat FROM places GROUP BY 1", ("places",))
def centre_index(spark, sf):
    """Centres told by index documents, one for each place."""
    lng, lat = B._deg("cx", "cy")
    p = D.view(spark, sf, "places").groupBy("name").agg(F.avg(lng).alias("lng"), F.avg(lat).alias("lat"))
    docs = p.select(F.to_json(F.create_map("name", F.struct(F.array("lng", "lat").alias("center")))).alias("doc"))
    return R.centre_index(docs).select("code", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"))


@query("sheet_catalogue", """
SELECT building || '-Floor' || floor AS sheet, building, floor, CAST(MAX(x1) AS DOUBLE) AS width, CAST(MAX(y1) AS DOUBLE) AS height, COUNT(room) > 0 AS traced FROM spaces GROUP BY building, floor""", ("spaces",))
def sheet_catalogue(spark, sf):
    """Every sheet of index documents with its size and whether any of its spaces is numbered."""
    s = D.view(spark, sf, "spaces")
    size = s.groupBy("building", "floor").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    docs = size.select(F.to_json(F.create_map(F.concat("building", F.lit("-Floor"), "floor"), F.struct("width", "height"))).alias("doc"))
    return R.sheet_catalogue(docs, s.where("room IS NOT NULL"))


@query("graph_tables", f"WITH {EDGE_CTE} SELECT a, b, ROUND(metres, 2) AS metres FROM edges", ("nodes", "links"))
def graph_tables(spark, sf):
    """Edges of a graph written as four tables of one version."""
    root, nodes = _folder(spark), B.nodes(spark, sf)
    sinks.write_graph(nodes, edges(spark, sf), N.place_rollup(nodes), nodes.limit(0), root, 1)
    return sinks.read_version(spark, f"{root}/edges", 1).select("a", "b", "metres")


@query("room_files", f"WITH {INDEX_CTE} SELECT building, COUNT(*) AS rooms, COUNT(DISTINCT label) AS labels FROM idx GROUP BY 1", ("spaces",))
def room_files(spark, sf):
    """The room index in folders by building, read back whole."""
    path = _folder(spark)
    sinks.write_rooms(index(spark, sf), path)
    return R.read_table(spark, path).groupBy(F.col("building").cast("string").alias("building")).agg(F.count(F.lit(1)).alias("rooms"), F.count_distinct("label").alias("labels"))


@query("sheet_files", "SELECT building, floor, COUNT(*) AS spaces, CAST(SUM(ord) AS BIGINT) AS ords FROM spaces GROUP BY 1, 2", ("spaces",))
def sheet_files(spark, sf):
    """Spaces in folders by sheet, read back whole."""
    path = _folder(spark)
    sinks.write_sheets(D.view(spark, sf, "spaces").select("building", "floor", "ord"), path)
    return R.read_table(spark, path).groupBy(F.col("building").cast("string").alias("building"), F.col("floor").cast("string").alias("floor")).agg(F.count(F.lit(1)).alias("spaces"), F.sum("ord").alias("ords"))


@query("route_files", f"WITH {ROWS} SELECT query_id, COUNT(*) AS points, CAST(SUM(step) AS BIGINT) AS steps, ROUND(SUM(lng), 6) AS lng FROM pts GROUP BY 1", ("route_points_raw",))
def route_files(spark, sf):
    path = _folder(spark)
    sinks.write_routes(stored_routes(spark, sf), path)
    return spark.read.parquet(path).groupBy("query_id").agg(F.count(F.lit(1)).alias("points"), F.sum("step").cast("bigint").alias("steps"), r6(F.sum("lng")).alias("lng"))


@query("report_files", "SELECT building, floor, COUNT(*) AS spaces FROM spaces GROUP BY 1, 2", ("spaces",))
def report_files(spark, sf):
    path = _folder(spark)
    sinks.write_report(D.view(spark, sf, "spaces").groupBy("building", "floor").agg(F.count(F.lit(1)).alias("spaces")), path)
    return spark.read.schema("building string, floor string, spaces bigint").json(path)


@query("appended_records", "SELECT building, CAST(2 * COUNT(*) AS BIGINT) AS records, CAST(2 * COUNT(*) AS BIGINT) AS ids FROM spaces GROUP BY 1", ("spaces",))
def appended_records(spark, sf):
    """The same records appended twice, each with an id of its own."""
    path, s = _folder(spark), D.view(spark, sf, "spaces").select("building", "ord")
    sinks.append_records(s, path)
    sinks.append_records(s, path)
    return spark.read.parquet(path).groupBy("building").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids"))


@query("promoted_sets", "SELECT 'shrunk' AS attempt, FALSE AS promoted, COUNT(*) AS live FROM spaces UNION ALL SELECT 'first', TRUE, COUNT(*) FROM spaces UNION ALL SELECT 'again', TRUE, COUNT(CASE WHEN ord % 20 <> 0 THEN 1 END) FROM spaces", ("spaces",))
def promoted_sets(spark, sf):
    """Sets promoted to live: the first always, one that lost over a tenth never, one that lost a twentieth again."""
    root, s = _folder(spark), D.view(spark, sf, "spaces").select("building", "floor", "ord")
    told = []
    for attempt, rows in (("first", s), ("shrunk", s.where("ord % 5 <> 0")), ("again", s.where("ord % 20 <> 0"))):
        promoted = sinks.promote(rows, root)
        told.append(sinks.read_version(spark, root).select(F.lit(attempt).alias("attempt"), F.lit(promoted).alias("promoted")).groupBy("attempt", "promoted").agg(F.count(F.lit(1)).alias("live")))
    return told[0].unionByName(told[1]).unionByName(told[2])
