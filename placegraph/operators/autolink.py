"""Linking loose nodes and pieces of a sheet's network, through traced space where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.functions import geo
from placegraph.operators import graph, network, spatial
from placegraph.session import materialise

SHEET = ["building", "floor"]
WALL_M = 0.3


def clear_runs(links: DataFrame, spaces: DataFrame, step_m: float = 0.5, wall_m: float = WALL_M) -> DataFrame:
    """Whether each straight link stays in traced space; a sheet with nothing traced blocks nothing.

    ``links``: ``building, floor, a, b, ax, ay, bx, by`` in degrees. Points every
    ``step_m`` along the link must lie in a shape or within a wall's width of one.
    """
    keys = [*SHEET, "a", "b"]
    deg = wall_m / geo.metres_per_degree()
    n = F.greatest(F.ceil(geo.flat_m("ax", "ay", "bx", "by") / step_m), F.lit(1))
    shapes = spaces.where(F.coalesce("type", F.lit("room")) != "building").select(*SHEET, "ring")
    traced = shapes.select(*SHEET).distinct()
    open_air = links.join(traced, SHEET, "left_anti").select(*keys, F.lit(True).alias("clear"))
    links = links.join(traced, SHEET, "left_semi")
    pts = links.select(*keys, "ax", "ay", "bx", "by", n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    t = F.col("i") / F.col("n")
    pts = pts.select(*keys, "i", (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y"))
    # Degrees of longitude are shorter; test the wall in metres of the point's own latitude.
    scale = F.cos(F.radians("y"))
    flat = F.transform("s__e", lambda e: F.struct((e["ax"] * scale).alias("ax"), e["ay"].alias("ay"), (e["bx"] * scale).alias("bx"), e["by"].alias("by")))
    held = geo.distance_to_shape(flat, F.col("x") * scale, F.col("y")) <= deg
    point = spatial.with_hits(pts, shapes, {"_in": F.max(held)}, on=[(k, k) for k in SHEET], x="x", y="y", pad=deg * 2).withColumn(
        "in", F.coalesce("_in", F.lit(False)))
    link = point.groupBy(*keys).agg(F.min("in").alias("clear"))
    return link.select(*keys, "clear").unionByName(open_air)


def _best_partners(nodes: DataFrame, spaces: DataFrame, from_where, start_m: float = 100.0) -> DataFrame:
    """The best partner of each component on its sheet: a clear run first, then the shorter, then the lower ids.

    Cells grow until a component has a clear partner no farther than a cell, or
    every partner on the sheet has been seen. Returns ``building, floor, component, a, b, blocked, metres``.
    """
    group = [*SHEET, "component"]
    span = nodes.groupBy(*SHEET).agg(geo.flat_m(F.min("lng"), F.min("lat"), F.max("lng"), F.max("lat")).alias("span"), F.count_distinct("component").alias("pieces")).where("pieces > 1")
    todo, n = materialise(nodes.where(from_where).select(*group).distinct().join(span, SHEET).select(*group, "span"))
    answer, size_m, off = None, start_m, F.array(F.lit(-1), F.lit(0), F.lit(1))
    while n["rows"]:
        s = F.lit(size_m / geo.metres_per_degree())
        base = nodes.join(todo.select(*SHEET).distinct(), SHEET, "left_semi").select(*SHEET, "component", "nid", "lng", "lat")
        wide = lambda c: s / F.cos(F.radians(F.least(F.greatest(F.abs(c * s), F.abs((c + 1) * s)) + s, F.lit(89.9))))
        left = base.join(todo.select(*group), group, "left_semi").select(*SHEET, "component", F.col("nid").alias("a"), F.col("lng").alias("ax"), F.col("lat").alias("ay"))
        left = left.withColumn("_c", F.floor(F.col("ay") / s)).withColumn("_d", F.explode(F.transform(off, lambda d: F.floor(F.col("ax") / wide(F.col("_c"))) + d)))
        right = base.select(*SHEET, F.col("component").alias("other"), F.col("nid").alias("b"), F.col("lng").alias("bx"), F.col("lat").alias("by"))
        right = right.withColumn("_c", F.explode(F.transform(off, lambda d: F.floor(F.col("by") / s) + d))).withColumn("_d", F.floor(F.col("bx") / wide(F.col("_c"))))
        pairs = left.join(right, [*SHEET, "_c", "_d"]).where("component <> other").drop("_c", "_d")
        pairs = pairs.withColumn("metres", geo.haversine_m("ax", "ay", "bx", "by", geo.WEIGHT_RADIUS_M))
        pairs, _ = materialise(pairs.join(todo, group).where((F.col("metres") <= size_m) | (F.col("span") <= size_m)))
        ok = clear_runs(pairs.select(*SHEET, "a", "b", "ax", "ay", "bx", "by").distinct(), spaces)
        ranked = pairs.join(ok, [*SHEET, "a", "b"]).groupBy(*group).agg(F.min(F.struct((~F.col("clear")).alias("blocked"), "metres", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("m"))
        tried = todo.join(ranked, group, "left")
        done = F.coalesce(F.col("m").isNotNull() & (~F.col("m.blocked") | (F.col("span") <= size_m)), F.lit(False))
        tried, n = materialise(tried.withColumn("ok", done), rows=F.count_if(~done))
        got = tried.where("ok").select(*group, "m.a", "m.b", "m.blocked", "m.metres")
        answer = got if answer is None else answer.unionByName(got)
        todo = tried.where(~F.col("ok")).select(*group, "span")
        size_m *= 4
    if answer is None:
        answer = todo.select(*group, F.lit("").alias("a"), F.lit("").alias("b"), F.lit(False).alias("blocked"), F.lit(0.0).alias("metres"))
    return answer


def autolink(nodes: DataFrame, edges: DataFrame, spaces: DataFrame) -> DataFrame:
    """Links added so that every sheet's network is one piece: ``building, floor, a, b, blocked, metres, stage``.

    First each isolated node is linked to its best partner, then pieces are
    joined, every piece taking its best pair at once until one is left on each
    sheet. ``nodes``: ``building, floor, nid, ord, lng, lat``; only links within a sheet count.
    """
    nodes, _ = materialise(nodes.select(*SHEET, "nid", "ord", "lng", "lat"))
    at = nodes.select(*[F.col(k).alias("_" + k) for k in SHEET], F.col("nid").alias("b"))
    inner = edges.select("a", "b").join(nodes.select(*SHEET, F.col("nid").alias("a")), "a").join(at, "b").where(
        (F.col("building") == F.col("_building")) & (F.col("floor") == F.col("_floor"))).select("a", "b")
    inner, _ = materialise(inner)
    alone = network.degrees(nodes, inner).select("nid", (F.col("degree") == 0).alias("alone"))
    singles = nodes.join(alone, "nid").withColumn("component", F.col("ord"))
    added = _best_partners(singles, spaces, F.col("alone")).drop("component").distinct().withColumn("stage", F.lit("isolate"))
    added, _ = materialise(added)
    current, _ = materialise(inner.unionByName(added.select("a", "b")))
    while True:
        comps = graph.components(nodes, current)
        picks = _best_partners(nodes.join(comps.select("nid", "component"), "nid"), spaces, F.lit(True))
        new, n = materialise(picks.drop("component").distinct().withColumn("stage", F.lit("piece")))
        if not n["rows"]:
            return added
        added = added.unionByName(new)
        current, _ = materialise(current.unionByName(new.select("a", "b")))
