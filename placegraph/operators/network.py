"""The walking network: nodes, links, labels, inferred steps and their checks.

Node ids are strings; positions in a list are never used as ids. A NULL building
means outdoors, a NULL floor means on no storey.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegraph.functions import geo, text
from placegraph.operators import spatial
from placegraph.operators.common import first_by
from placegraph.session import materialise

VERTICAL = ("stairs", "elevator")
OUTDOORS = "(outdoors)"
STEP_M = 15.0


def collect_nodes(network: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Nodes with an id, first wins: the network file before the sheets, then file order."""
    both = network.withColumn("_rank", F.lit(0))
    if sheets is not None:
        both = both.unionByName(sheets.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    both = both.where(text.filled("nid"))
    order = ["_rank", *(["source"] if "source" in both.columns else []), "ord"]
    return first_by(both, ["nid"], order, [c for c in both.columns if c not in ("nid", "_rank")])


def space_labels(spaces: DataFrame) -> DataFrame:
    """Per (building, floor, room): the first filled name and the first type, in file order."""
    order = F.struct("sheet", "ord")
    rooms = spaces.where(text.filled("room"))
    return rooms.groupBy("building", "floor", "room").agg(
        F.min(order).alias("first"),
        F.min_by(F.trim("name"), F.when(text.filled("name"), order)).alias("name"),
        F.min_by(F.coalesce(F.col("type"), F.lit("room")), order).alias("space"))


def label_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Name and kind of the space each node serves: its own floor's, else the building's first."""
    exact = labels.select(
        F.col("building").alias("_b"), F.col("floor").alias("_f"), F.col("room").alias("_r"),
        F.struct("name", "space").alias("_exact"))
    anywhere = labels.groupBy(F.col("building").alias("_b2"), F.col("room").alias("_r2")).agg(
        F.min_by(F.struct("name", "space"), "first").alias("_any"))
    n = nodes.drop("space").withColumnRenamed("name", "node_name")
    out = (
        n.join(exact, (n.building == F.col("_b")) & (n.floor == F.col("_f")) & (n.room == F.col("_r")), "left")
        .join(anywhere, (n.building == F.col("_b2")) & (n.room == F.col("_r2")), "left"))
    got = F.coalesce("_exact", "_any")
    return out.select(*n.columns, got["name"].alias("name"), got["space"].alias("space"))


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends found, their length in metres, self links dropped."""
    at = nodes.select("nid", "lng", "lat")
    a = at.select(F.col("nid").alias("a"), F.col("lng").alias("_ax"), F.col("lat").alias("_ay"))
    b = at.select(F.col("nid").alias("b"), F.col("lng").alias("_bx"), F.col("lat").alias("_by"))
    walk = F.when(F.col("metres") > 0, F.col("metres")).otherwise(
        geo.haversine_m("_ax", "_ay", "_bx", "_by", geo.WEIGHT_RADIUS_M))
    return links.where(F.col("a") != F.col("b")).join(a, "a").join(b, "b").select("a", "b", walk.alias("metres"))


def unknown_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links naming an end that is not a node."""
    ids = nodes.select("nid")
    known = links.join(ids.withColumnRenamed("nid", "a"), "a", "left_semi").join(ids.withColumnRenamed("nid", "b"), "b", "left_semi")
    return links.join(known.select("ord"), "ord", "left_anti")


def least_edges(links: DataFrame) -> DataFrame:
    """Undirected edges, self links dropped, the least weight of each pair."""
    return links.where(F.col("a") != F.col("b")).groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("metres").alias("metres"))


def weighted_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The least of :func:`resolve_links` for each pair, as :func:`least_edges` gives it; links of a pair look up their ends once."""
    told = F.when(F.col("metres") > 0, F.col("metres"))
    pairs = links.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(told).alias("_told"), F.bool_or(told.isNull()).alias("_flight"))
    at = lambda n: nodes.select(F.col("nid").alias(n), F.col("lng").alias(f"_{n}x"), F.col("lat").alias(f"_{n}y"))
    flight = F.when(F.col("_flight"), geo.haversine_m("_ax", "_ay", "_bx", "_by", geo.WEIGHT_RADIUS_M))
    return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("_told", flight).alias("metres"))


def closest_pairs(left: DataFrame, right: DataFrame, group: list[str], start_m: float = 50.0) -> DataFrame:
    """The closest (left, right) pair of each group that has both.

    Both sides: ``group..., nid, lng, lat``. Points on one spot count once. Cells
    grow for the groups whose best pair is farther apart than a cell, so a crowded
    group never meets itself whole. Ties go to the lower ids. Returns
    ``group..., a, b, metres``.
    """
    spot = lambda df, n: df.groupBy(*group, F.col("lng").alias(f"{n}x"), F.col("lat").alias(f"{n}y")).agg(F.min("nid").alias(n))
    l, _ = materialise(spot(left, "a"))
    r, _ = materialise(spot(right, "b"))
    todo, n = materialise(l.select(*group).distinct().join(r.select(*group).distinct(), group))
    metres = geo.haversine_m("ax", "ay", "bx", "by", geo.WEIGHT_RADIUS_M)
    deg, size_m = geo.metres_per_degree(geo.WEIGHT_RADIUS_M), start_m
    answer = None
    while True:
        size = size_m / deg
        whole = size >= 180.0
        near = spatial.look_around(l.join(todo, group, "left_semi"), "ax", "ay", size).join(
            spatial.seen_from(r.join(todo, group, "left_semi"), "bx", "by", size), [*group, *spatial.GLOBE])
        best = near.groupBy(*group).agg(F.min(F.struct(metres.alias("d"), "a", "b")).alias("m"))
        ok = F.coalesce(F.lit(whole) | (F.col("m.d") <= size_m), F.lit(False)) & F.col("m").isNotNull()
        tried, n = materialise(todo.join(best, group, "left").withColumn("ok", ok), left=F.count_if(~ok))
        got = tried.where("ok").select(*group, F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.d").alias("metres"))
        answer = got if answer is None else answer.unionByName(got)
        if whole or not n["left"]:
            return answer
        todo = tried.where(~F.col("ok")).select(*group)
        size_m *= 4


def stairwell_steps(nodes: DataFrame) -> DataFrame:
    """One inferred step between neighbouring floors of each stairwell or lift, from the closest nodes."""
    wells = nodes.where(F.col("space").isin(*VERTICAL) & text.filled("room")).select(
        F.coalesce("building", F.lit(OUTDOORS)).alias("building"), "room", F.coalesce("floor", F.lit("~")).alias("floor"), "nid", "lng", "lat")
    floors = wells.select("building", "room", "floor").distinct().withColumn("_nat", text.natural_key("floor"))
    # One row per floor of a shaft here, so the window stays small.
    w = Window.partitionBy("building", "room").orderBy((F.col("floor") == "~"), "_nat", "floor")
    pairs = floors.withColumn("upper", F.lead("floor").over(w)).where(F.col("upper").isNotNull()).select(
        "building", "room", F.col("floor").alias("lower"), "upper")
    low = wells.withColumnRenamed("floor", "lower").join(pairs, ["building", "room", "lower"])
    up = wells.withColumnRenamed("floor", "upper").join(pairs, ["building", "room", "upper"])
    cols = ["building", "room", "lower", "upper"]
    return closest_pairs(low.select(*cols, "nid", "lng", "lat"), up.select(*cols, "nid", "lng", "lat"), cols)


def build_edges(links: DataFrame, nodes: DataFrame, steps: DataFrame | None = None, step_m: float = STEP_M) -> DataFrame:
    """Weighted undirected edges of the whole network: drawn links and inferred steps, least weight kept."""
    drawn = resolve_links(links, nodes)
    if steps is not None:
        drawn = drawn.unionByName(steps.select("a", "b", F.lit(step_m).alias("metres")))
    return least_edges(drawn)


def dangling_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per link end that names no node."""
    ends = links.select("ord", F.posexplode(F.array("a", "b")).alias("end", "nid"))
    return ends.join(nodes.select("nid"), "nid", "left_anti").select("ord", F.col("end").cast("bigint").alias("end"), "nid")


def tidy_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each link with the reason it would be dropped, or NULL to keep it.

    Reasons in order: a missing end, a self link, an end that is no node, a pair
    already joined by an earlier link.
    """
    ids = nodes.select("nid").distinct()
    l = (
        links.join(ids.select(F.col("nid").alias("a"), F.lit(True).alias("_ka")), "a", "left")
        .join(ids.select(F.col("nid").alias("b"), F.lit(True).alias("_kb")), "b", "left"))
    first = F.when(F.col("a").isNull() | F.col("b").isNull(), "dangling").when(
        F.col("a") == F.col("b"), "self").when(F.col("_ka").isNull() | F.col("_kb").isNull(), "dangling")
    l = l.withColumn("_r", first).withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b"))
    kept = l.where(F.col("_r").isNull()).groupBy("_lo", "_hi").agg(F.min("ord").alias("_first"))
    out = l.join(kept, ["_lo", "_hi"], "left")
    reason = F.coalesce("_r", F.when(F.col("ord") != F.col("_first"), "duplicate"))
    return out.select("ord", "a", "b", "metres", reason.alias("reason"))


def symmetrise(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed neighbour rows made two-way. ``nid, neighbour`` in; ``added`` marks new rows.

    A neighbour that is not in ``nodes`` gets no reply.
    """
    have = adjacency.select("nid", "neighbour").distinct()
    back = have.select(F.col("neighbour").alias("nid"), F.col("nid").alias("neighbour")).join(
        nodes.select("nid").distinct(), "nid", "left_semi")
    both = have.withColumn("_have", F.lit(True)).unionByName(back.withColumn("_have", F.lit(False)))
    return both.groupBy("nid", "neighbour").agg((~F.max("_have")).alias("added"))


def neighbours_of(nodes: DataFrame, column: str = "connections") -> DataFrame:
    """Neighbour rows of a comma-separated connections column."""
    return nodes.select("nid", F.explode(text.comma_list(column)).alias("neighbour"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours of every node, 0 for isolates."""
    ends = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = ends.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("nid").join(both, "nid", "left").select("nid", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def vertical_by_floor(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stairs and lifts each floor is linked to but that stand on another floor of the building."""
    n = nodes.where(F.col("building").isNotNull() & F.col("floor").isNotNull()).select(
        "nid", "ord", F.upper("building").alias("building"), "floor", "room", "name", "space")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    here = n.select(F.col("nid").alias("a"), F.col("ord").alias("o1"), F.col("building").alias("hb"), F.col("floor").alias("onto"))
    there = n.where(F.col("space").isin(*VERTICAL) & text.filled("room")).withColumnRenamed("nid", "b").withColumnRenamed("ord", "o2")
    hits = both.join(here, "a").join(there, "b").where((F.col("hb") == F.col("building")) & (F.col("onto") != F.col("floor")))
    return first_by(hits, ["building", "onto", "room"], ["o1", "o2"], ["name", "space", "floor"])


def carry_outlines(vertical: DataFrame, spaces: DataFrame) -> DataFrame:
    """Shaft outlines put on every floor they reach, unless that floor draws them itself."""
    shape = spaces.where(text.filled("room")).select(F.upper("building").alias("building"), "floor", "room", "ring", "ord")
    shape = first_by(shape, ["building", "floor", "room"], ["ord"], ["ring"])
    drawn = shape.select("building", F.col("floor").alias("onto"), "room")
    return vertical.join(shape, ["building", "floor", "room"]).join(drawn, ["building", "onto", "room"], "left_anti").select(
        "building", "onto", "room", "name", "space", F.col("floor").alias("from_floor"), "ring")


def unreachable_rooms(spaces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rooms worth reaching that no node serves."""
    want = spaces.where(text.filled("room") & (F.coalesce("type", F.lit("room")) == "room")).select("building", "room").distinct()
    served = nodes.where(text.filled("room")).select("building", "room").distinct()
    return want.join(served, ["building", "room"], "left_anti")


def place_rollup(nodes: DataFrame) -> DataFrame:
    """Nodes and distinct floors per place; outdoors sorts last."""
    r = nodes.groupBy(F.coalesce("building", F.lit(OUTDOORS)).alias("place")).agg(
        F.count(F.lit(1)).alias("nodes"), F.array_join(F.array_sort(F.collect_set("floor")), ",").alias("floors"))
    return r


def places_with_nodes(nodes: DataFrame) -> DataFrame:
    r = nodes.groupBy(F.coalesce("building", F.lit(OUTDOORS)).alias("place")).agg(F.count(F.lit(1)).alias("nodes"))
    return r.orderBy(F.col("place") == OUTDOORS, text.natural_key("place"), "place")


def siblings(rooms: DataFrame) -> DataFrame:
    """Number of other rooms on each room's floor, without pairing them."""
    n = rooms.groupBy("building", "floor").agg(F.count_distinct("room").alias("_n"))
    return rooms.join(n, ["building", "floor"]).select("building", "floor", "room", (F.col("_n") - 1).alias("siblings"))


def siblings_of(asked: DataFrame, rooms: DataFrame) -> DataFrame:
    """The other rooms on the floor of each asked room: ``building, floor, room, sibling``."""
    others = rooms.select("building", "floor", F.col("room").alias("sibling"))
    return asked.select("building", "floor", "room").join(others, ["building", "floor"]).where("sibling <> room")


def link_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether each end of a link is a known node, and whether a link before it (by ``ord``) joins the same two."""
    known = nodes.select("nid").distinct()
    has = lambda end, name: known.select(F.col("nid").alias(end), F.lit(True).alias(name))
    first = links.groupBy(F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_g")).agg(F.min("ord").alias("_first"))
    out = links.join(has("a", "_a"), "a", "left").join(has("b", "_b"), "b", "left").join(
        first, (F.least("a", "b") == F.col("_l")) & (F.greatest("a", "b") == F.col("_g")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select("ord", "a", "b", yes("_a").alias("a_known"), yes("_b").alias("b_known"), (F.col("ord") > F.col("_first")).alias("repeated"))


def floor_view(nodes: DataFrame, space_types: DataFrame, building: Column, floor: Column) -> DataFrame:
    """How each node relates to an open sheet: zone, on another floor, hidden.

    Stairs and lifts stay visible from any floor of their building.
    """
    kinds = space_types.select(F.upper("building").alias("_b"), F.col("floor").alias("_f"), F.upper("room").alias("_r"), F.col("type").alias("_t"))
    b = F.upper(F.coalesce("building", F.lit("")))
    n = nodes.join(kinds, (b == F.col("_b")) & (F.col("floor") == F.col("_f")) & (F.upper("room") == F.col("_r")), "left")
    fl = F.nullif("floor", F.lit(""))
    other = fl.isNotNull() & (b == F.upper(building)) & (fl != floor)
    zone = F.when(b == "", "outside").when(b != F.upper(building), "other").when(
        F.col("floor").isNull() | (F.col("floor") == floor), "here").otherwise("floor")
    return n.select(*nodes.columns, zone.alias("zone"), F.coalesce(other, F.lit(False)).alias("other_floor"),
                    F.coalesce(other & ~F.coalesce(F.col("_t").isin(*VERTICAL), F.lit(False)), F.lit(False)).alias("hidden"))


def hidden_links(links: DataFrame, view: DataFrame) -> DataFrame:
    """A link is hidden when either of its ends is; an unknown end hides nothing."""
    gone = view.where("hidden").select("nid").distinct()
    ends = links.select("ord", F.explode(F.array("a", "b")).alias("nid"))
    hit = ends.join(gone, "nid", "left_semi").select("ord").distinct().withColumn("_h", F.lit(True))
    return links.join(hit, "ord", "left").select(*links.columns, F.coalesce("_h", F.lit(False)).alias("hidden"))
