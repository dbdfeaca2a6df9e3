"""Reading feature collections, sheets, indexes and catalogues into typed rows.

Two layouts are read. Whole documents (one JSON document a file, many files) and
feature lines (one feature a line), which Spark splits at any size. Rows keep
``source`` and ``ord``, as several rules are "first in file order". A document
that is not usable goes to the rejects, not to an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegraph.functions import geo, text
from placegraph.sources.sinks import part_of

ROOT = "type string, version bigint, features array<string>, geometries array<string>, links array<string>, arcs string, coordinates string, geometry string"
FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """One row per file: ``source`` (file name), ``doc``."""
    d = spark.read.option("wholetext", True).text(paths)
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("source"), F.col("value").alias("doc"))


def normalise_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Any GeoJSON root as feature texts: ``source, ord, version, feature``; and the rejects ``source, reason``.

    A lone feature, a geometry collection and a bare geometry become features;
    TopoJSON and anything unknown are refused.
    """
    r = docs.withColumn("r", F.from_json("doc", ROOT))
    wrap = lambda g: F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), g, F.lit("}"))
    kind = F.col("r.type")
    feats = (F.when((kind == "FeatureCollection") & F.col("r.features").isNotNull(), F.col("r.features"))
             .when(kind == "Feature", F.array("doc"))
             .when((kind == "GeometryCollection") & F.col("r.geometries").isNotNull(), F.transform("r.geometries", wrap))
             .when(kind.isin(*GEOMETRIES), F.array(wrap(F.col("doc")))))
    r = r.withColumn("_f", feats)
    reason = F.when(kind.isNull(), "not a JSON document").when(kind == "Topology", "TopoJSON").otherwise("not GeoJSON")
    rows = r.where("_f IS NOT NULL").select("source", F.coalesce("r.version", F.lit(0)).alias("version"), F.posexplode("_f").alias("ord", "feature"))
    return rows, r.where("_f IS NULL").select("source", reason.alias("reason"))


def read_feature_lines(spark: SparkSession, paths) -> DataFrame:
    """Feature texts of files with one feature a line; splittable, file order kept in ``ord``."""
    d = spark.read.text(paths)
    # Lines are shorter in number than bytes, so block start plus position keeps file order.
    pos = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.regexp_replace(F.trim("value"), ",$", "")
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("source"), pos.alias("ord"), line.alias("feature")).where(
        F.startswith("feature", F.lit('{"type":"Feature"')) & ~F.startswith("feature", F.lit('{"type":"FeatureCollection"')))


def sheet_of(source: Column) -> tuple[Column, Column]:
    """Building and floor of a sheet's file name ``CODE-FloorN``; no floor without the marker."""
    stem = F.regexp_replace(source, r"\.[^.]*$", "")
    at = F.instr(stem, "-Floor")
    return F.when(at > 0, F.substr(stem, F.lit(1), at - 1)).otherwise(stem), F.when(at > 0, F.substr(stem, at + 6))


def parse_features(rows: DataFrame) -> DataFrame:
    """Feature texts as typed columns.

    Adds ``type`` (of the feature's properties), ``props``, ``geom_type``, ``pt``,
    ``rings`` (outer rings only), ``line``, and the sheet's building and floor.
    """
    f = rows.withColumn("_f", F.from_json("feature", FEATURE))
    g, c = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    pts = lambda arr: F.transform(arr, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    one = F.from_json(c, "array<double>")
    poly = F.from_json(c, "array<array<array<double>>>")
    multi = F.from_json(c, "array<array<array<array<double>>>>")
    rings = F.when(g == "Polygon", F.transform(F.slice(poly, 1, 1), pts)).when(
        g == "MultiPolygon", F.transform(F.filter(multi, lambda p: F.size(p) > 0), lambda p: pts(F.get(p, 0))))
    building, floor = sheet_of(F.col("source"))
    keep = [x for x in rows.columns if x != "feature"]
    return f.select(*keep, building.alias("sheet_building"), floor.alias("sheet_floor"), F.col("_f.properties.type").alias("type"),
                    F.col("_f.properties").alias("props"), g.alias("geom_type"),
                    F.when((g == "Point") & (F.size(one) >= 2), F.struct(F.get(one, 0).alias("x"), F.get(one, 1).alias("y"))).alias("pt"),
                    rings.alias("rings"), F.when(g == "LineString", pts(F.from_json(c, "array<array<double>>"))).alias("line"))


def _p(key: str) -> Column:
    return F.nullif(F.col("props").getItem(key), F.lit(""))


def network_nodes(features: DataFrame, from_sheet: bool = False) -> DataFrame:
    """Node rows; nodes drawn on a sheet take the sheet's building and floor."""
    n = features.where((F.col("type") == "node") & F.col("pt").isNotNull() & _p("nid").isNotNull())
    b, fl = (F.col("sheet_building"), F.col("sheet_floor")) if from_sheet else (_p("building"), _p("floor"))
    return n.select("source", "ord", _p("nid").alias("nid"), b.alias("building"), fl.alias("floor"), _p("room").alias("room"), _p("name").alias("name"),
                    F.round("pt.x", 7).alias("lng"), F.round("pt.y", 7).alias("lat"))


def network_links(features: DataFrame, from_sheet: bool = False) -> DataFrame:
    """Link rows naming exactly two nodes; lengths are only taken from the network document."""
    pair = text.array_or_json(F.lit(None).cast("array<string>"), F.col("props").getItem("nodes"))
    l = features.where(F.col("type") == "path").withColumn("_n", pair).where(F.size("_n") == 2)
    metres = F.lit(None).cast("double") if from_sheet else F.col("props").getItem("metres").try_cast("double")
    return l.select("source", "ord", F.get("_n", 0).alias("a"), F.get("_n", 1).alias("b"), metres.alias("metres"))


def document_links(docs: DataFrame) -> DataFrame:
    """Links a sheet lists beside its features: how it joins something on another sheet."""
    r = docs.select("source", F.posexplode(F.from_json("doc", ROOT)["links"]).alias("ord", "l"))
    r = r.withColumn("_l", F.from_json("l", "nodes array<string>, metres double")).where(F.size("_l.nodes") == 2)
    return r.select("source", "ord", F.get("_l.nodes", 0).alias("a"), F.get("_l.nodes", 1).alias("b"), F.col("_l.metres").alias("metres"))


def sheet_spaces(features: DataFrame) -> DataFrame:
    """Traced outlines of sheets, one row per outer ring."""
    s = features.where(F.col("rings").isNotNull() & (F.size("rings") > 0))
    return s.select("source", F.col("source").alias("sheet"), "ord", F.coalesce(_p("building"), "sheet_building").alias("building"),
                    F.coalesce(_p("floor"), "sheet_floor").alias("floor"), _p("room").alias("room"), F.col("type"), _p("name").alias("name"),
                    _p("amenity").alias("amenity"), _p("confidence").alias("confidence"), F.explode("rings").alias("ring"))


def named_outlines(features: DataFrame, prio: int, kind: str, keys: list[str]) -> DataFrame:
    """Outlines of one source: the first filled key is the name; the source's place in line is ``prio``."""
    name = text.first_filled(*[F.col("props").getItem(k) for k in keys])
    display = text.blank_to_null(F.col("props").getItem(keys[1])) if len(keys) > 1 else F.lit(None).cast("string")
    o = features.where(F.col("rings").isNotNull())
    return o.select(F.lit(prio).alias("prio"), "ord", F.lit(kind).alias("kind"), name.alias("name"), display.alias("display"), F.explode("rings").alias("ring")).where("name IS NOT NULL")


def parking_pieces(features: DataFrame) -> DataFrame:
    """A landed parking extract: five attributes of the many it has, one row per ring."""
    p = lambda k: F.col("props").getItem(k)
    return features.where(F.col("rings").isNotNull()).select(
        F.trim(p("Name")).alias("name"), text.first_filled(p("Type2"), p("Type")).alias("kind"), p("StallCount").alias("stalls"), F.trim(p("Hours")).alias("hours"),
        p("isStaffOnly").alias("staff_only"), "ord", F.explode("rings").alias("ring"))


def centre_index(docs: DataFrame) -> DataFrame:
    """An index object keyed by code, as rows ``code, lng, lat``."""
    m = docs.select(F.explode(F.from_json("doc", "map<string, struct<center:array<double>, lng:double, lat:double>>")).alias("code", "v"))
    return m.select("code", F.coalesce("v.lng", F.get("v.center", 0)).alias("lng"), F.coalesce("v.lat", F.get("v.center", 1)).alias("lat"))


def sheet_catalogue(docs: DataFrame, traced: DataFrame) -> DataFrame:
    """Every sheet of an index object (keys ``CODE-FloorN``) with its size and whether it is traced, in natural order.

    ``traced``: ``building, floor``.
    """
    m = docs.select(F.explode(F.from_json("doc", "map<string, struct<width:double, height:double>>")).alias("sheet", "v"))
    b, fl = sheet_of(F.col("sheet"))
    m = m.select("sheet", b.alias("building"), fl.alias("floor"), "v.width", "v.height")
    t = traced.select("building", "floor").distinct().withColumn("traced", F.lit(True))
    return m.join(t, ["building", "floor"], "left").withColumn("traced", F.coalesce("traced", F.lit(False))).orderBy(text.natural_key("sheet"))


def read_sheet_table(spark: SparkSession, path: str, building: str, floor: str) -> DataFrame:
    """One sheet of a table split by building and floor: only its folder is read; a missing sheet is empty."""
    here = (F.col("key_part") == part_of(F.lit(building), F.lit(floor))) & (F.col("building") == building) & (F.col("floor") == floor)
    return spark.read.parquet(path).where(here).drop("key_part")


def read_table(spark: SparkSession, path: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """A table split by a key, whole or the rows of one value."""
    t = spark.read.parquet(path)
    return (t if key is None else t.where(F.col(key) == value)).drop("key_part")


def areas(spaces: DataFrame) -> DataFrame:
    return spaces.withColumn("area", geo.area("ring"))
