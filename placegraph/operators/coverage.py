"""Roll-ups of rooms, buildings and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.functions import text


def space_type_index(spaces: DataFrame) -> DataFrame:
    """Type of each (building, floor, room); the last one traced wins."""
    rows = spaces.where(text.filled("room") & text.filled("type"))
    return rows.groupBy("building", "floor", "room").agg(F.max_by("type", "ord").alias("type"))


def index_rooms(spaces: DataFrame) -> DataFrame:
    """Room search index: rooms only, the same number traced twice is one place.

    First in file order wins. ``label, building, floor, room, name, type, source, query``.
    """
    rooms = spaces.where(text.filled("room") & (F.coalesce(text.blank_to_null("type"), F.lit("room")) == "room"))
    best = rooms.groupBy("building", "floor", "room").agg(
        F.min_by(F.struct("name", "type", "sheet", "ord"), F.struct("sheet", "ord")).alias("r"))
    name, label = text.blank_to_null("r.name"), text.index_label("building", "room")
    return best.select(label.alias("label"), "building", "floor", "room", name.alias("name"),
                       F.coalesce("r.type", F.lit("room")).alias("type"), F.col("r.sheet").alias("source"), F.col("r.ord").alias("ord"),
                       text.index_query(label, name).alias("query"))


def coverage(rooms: DataFrame) -> DataFrame:
    """Buildings, floors and rooms known; a room without a building still counts as a room."""
    b = text.blank_to_null("building")
    fl = F.when(b.isNotNull() & text.filled("floor"), F.struct(b, F.col("floor")))
    return rooms.agg(F.count_distinct(b).alias("buildings"), F.count_distinct(fl).alias("floors"), F.count(F.lit(1)).alias("rooms"))


def coverage_rollup(rooms: DataFrame) -> DataFrame:
    """The same counts per (building, floor), per building and overall, in one pass."""
    return rooms.rollup("building", "floor").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("rooms"))


def buildings_with_plans(rooms: DataFrame) -> DataFrame:
    r = rooms.where(text.filled("building")).groupBy(F.col("building").alias("code")).agg(
        F.count_distinct(F.nullif("floor", F.lit(""))).alias("floors"), F.count(F.lit(1)).alias("rooms"))
    return r.orderBy(text.natural_key("code"), "code")


def floors_of_buildings(buildings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Floors per building: from indexed rooms, else the labels declared, else a single floor 1."""
    seen = rooms.where(text.filled("floor")).groupBy(F.upper("building").alias("code")).agg(F.collect_set("floor").alias("_seen"))
    b = buildings.select(F.upper("code").alias("code"), "declared").join(seen, "code", "left")
    declared = F.when(F.size("declared") > 0, F.col("declared"))
    floors = F.coalesce("_seen", declared, F.array(F.lit("1")))
    ordered = F.transform(F.array_sort(F.transform(floors, lambda f: F.struct(text.natural_key(f).alias("k"), f.alias("f")))), lambda s: s["f"])
    return b.select("code", ordered.alias("floors"))


def rooms_in_order(rooms: DataFrame) -> DataFrame:
    """Every room of each floor in natural order, as rows (a floor may be any size)."""
    return rooms.select("building", "floor", "room", "name", "type").orderBy(
        text.natural_key("building"), text.natural_key("floor"), text.natural_key("room"), "room")


def rooms_by_name(rooms: DataFrame) -> DataFrame:
    """How many rooms go by each name, and the room when there is exactly one."""
    named = rooms.where(text.filled("name") & text.filled("building") & text.filled("room"))
    g = named.groupBy(F.upper(F.trim("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("rooms"), F.min(F.struct("building", "room")).alias("r"))
    one = F.col("rooms") == 1
    return g.select("name", "rooms", F.when(one, F.upper("r.building")).alias("building"), F.when(one, F.col("r.room")).alias("room"))


def network_tally(nodes: DataFrame, links: DataFrame) -> DataFrame:
    kinds = nodes.select(F.lit(True).alias("n")).unionByName(links.select(F.lit(False).alias("n")))
    return kinds.agg(F.count_if("n").alias("nodes"), F.count_if(~F.col("n")).alias("links"))


def parking_lots(pieces: DataFrame) -> DataFrame:
    """One row per distinct outline of each lot: sorted kinds of the lot, the largest piece labelled.

    ``pieces``: ``name, kind, ord, ring``. Areas are compared at 1e-12 square degrees.
    """
    from placegraph.functions import geo

    p = pieces.where(text.filled("name"))
    kinds = p.groupBy(F.trim("name").alias("name")).agg(
        F.array_join(F.array_sort(F.collect_set(text.blank_to_null("kind"))), ",").alias("kinds"))
    shapes = p.groupBy(F.trim("name").alias("name"), F.col("ring")).agg(F.min("ord").alias("ord"))
    shapes = shapes.withColumn("area", F.round(geo.area("ring") * 1e12))
    biggest = shapes.groupBy("name").agg(F.min(F.struct((-F.col("area")).alias("a"), "ord")).alias("m"))
    return shapes.join(kinds, "name").join(biggest, "name").select(
        "name", "ord", "kinds", (F.col("ord") == F.col("m.ord")).alias("label"), "ring")


def place_centres(outlines: DataFrame) -> DataFrame:
    """Centre of every name an outline answers to: the mean of all its vertices.

    ``label`` is the looked-up form, ``name`` the written form met first.
    """
    keyed = outlines.select("prio", "ord", "ring", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("name").alias("n")), F.struct(F.lit(1).alias("k"), F.col("display").alias("n")))).alias("e"))
    keyed = keyed.select("prio", "ord", "e.k", F.trim("e.n").alias("name"), text.place_name("e.n").alias("label"), "ring").where("label <> ''")
    sums = keyed.select("label", F.struct("prio", "ord", "k", "name").alias("w"),
                        F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx"),
                        F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["y"]).alias("sy"), F.size("ring").alias("n"))
    return sums.groupBy("label").agg(F.min("w").alias("w"), (F.sum("sx") / F.sum("n")).alias("lng"), (F.sum("sy") / F.sum("n")).alias("lat")).select(
        "label", F.col("w.name").alias("name"), "lng", "lat")


def retyped(spaces: DataFrame) -> DataFrame:
    """Space types reduced to the five the router knows; ``new_type`` and ``amenity`` added."""
    old = F.coalesce(text.blank_to_null("type"), F.lit("room"))
    name = F.lower(F.coalesce("name", F.lit("")))
    # Old type to new type, and the types left alone.
    moved = {"corridor": "hallway", "washroom": "room", "storage": "service", "mech": "service", "elec": "service", "plant": "service"}
    kept = ["room", "hallway", "stairs", "elevator", "service", "door", "entrance", "node", "path", "building"]
    table = F.create_map(*[F.lit(v) for kv in moved.items() for v in kv])
    new = (F.when(F.map_contains_key(table, old), F.element_at(table, old))
           .when((old == "shaft") & name.rlike("elevator|lift"), "elevator")
           .when(old.isin(kept), old).otherwise("service"))
    out = spaces.withColumn("old_type", old).withColumn("new_type", new)
    words = "washroom|restroom|toilet|lavatory"
    return out.withColumn("amenity", F.when((F.col("new_type") == "room") & name.rlike(words), F.lit("washroom")))


def type_moves(spaces: DataFrame) -> DataFrame:
    t = retyped(spaces).where("old_type <> new_type")
    return t.groupBy(F.concat_ws(" -> ", "old_type", "new_type").alias("move")).agg(F.count(F.lit(1)).alias("spaces"))


def map_features(spaces: DataFrame) -> DataFrame:
    """Drawable outlines only: network rows out, an icon and a plain room label added."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    # The pictogram of a space type, or of what a room offers.
    by_type = F.when(kind.isin("stairs", "elevator"), F.concat(F.lit("icon-"), kind))
    by_amenity = F.when(F.lower("amenity") == "washroom", F.lit("icon-washroom"))
    return spaces.where(~kind.isin("node", "path")).withColumn("icon", F.coalesce(by_type, by_amenity)).withColumn(
        "label", F.nullif(text.bare_room("building", "room"), F.lit("")))
