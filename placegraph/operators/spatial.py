"""Spatial joins as equi-joins on grid cells.

A polygon picks the grid level whose cell is as wide as its box, so it covers at
most four cells whatever its size; a point is looked up once per level in use.
No side is broadcast by hand and no pair is formed that does not share a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.functions import geo
from placegraph.operators import pyramid
from placegraph.operators.common import top_k
from placegraph.session import materialise

_TINY = 1e-9


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")


def _boxed(shapes: DataFrame, ring: str, pad: float = 0.0) -> DataFrame:
    b = geo.box(ring)
    return (
        shapes.withColumn("_box", b)
        .withColumn("_x0", F.col("_box.x0") - pad).withColumn("_x1", F.col("_box.x1") + pad)
        .withColumn("_y0", F.col("_box.y0") - pad).withColumn("_y1", F.col("_box.y1") + pad)
        .withColumn("_lv", F.ceil(F.log2(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"),
                                                   F.lit(_TINY)))).cast("int"))
        .drop("_box"))


def _covered(df: DataFrame) -> DataFrame:
    """One row per grid cell the box touches at the row's level."""
    return (
        df.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_x0"), F.col("_lv")), _cell(F.col("_x1"), F.col("_lv")))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.col("_y0"), F.col("_lv")), _cell(F.col("_y1"), F.col("_lv"))))))


def _level_list(boxed: DataFrame) -> Column:
    """Levels in use (a few dozen at most), as a scalar subquery: no driver round trip."""
    return boxed.agg(F.array_sort(F.collect_set("_lv")).alias("lvs")).scalar()


def _rename(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def contained(points: DataFrame, shapes: DataFrame, on: Sequence[tuple[str, str]] = (), x: str = "lng",
              y: str = "lat", ring: str = "ring", pad: float = 0.0) -> DataFrame:
    """Points with the shapes that hold them, a row for each pair; shape columns come back as ``s_*``.

    ``pad`` widens the candidate search and leaves the exact test to the caller (the
    edges come back as ``s__e``). Points that no shape holds do not come back: see
    :func:`with_hits`.
    """
    boxed = _boxed(shapes, ring, pad).withColumn("_e", geo.edges(ring)).drop(ring)
    cells = _rename(_covered(boxed), "s_")
    probes = (
        points.withColumn("_lvs", _level_list(boxed)).withColumn("_lv", F.explode("_lvs")).drop("_lvs")
        .withColumn("_cx", _cell(F.col(x), F.col("_lv"))).withColumn("_cy", _cell(F.col(y), F.col("_lv"))))
    cond = (F.col("_lv") == F.col("s__lv")) & (F.col("_cx") == F.col("s__cx")) & (F.col("_cy") == F.col("s__cy"))
    for p, s in on:
        cond = cond & (F.col(p) == F.col("s_" + s))
    if not pad:
        cond = cond & F.col(x).between(F.col("s__x0"), F.col("s__x1")) & F.col(y).between(F.col("s__y0"), F.col("s__y1"))
        cond = cond & geo.inside_edges("s__e", x, y)
    out = probes.join(cells, cond)
    return out.drop("_lv", "_cx", "_cy", "s__lv", "s__cx", "s__cy", "s__x0", "s__x1", "s__y0", "s__y1")


def with_hits(points: DataFrame, shapes: DataFrame, found: dict[str, Column], on: Sequence[tuple[str, str]] = (), x: str = "lng",
              y: str = "lat", ring: str = "ring", pad: float = 0.0) -> DataFrame:
    """Every row of ``points``, once, with aggregates ``found`` over the shapes that hold it; NULL where none does.

    Shapes depend on where a point is and what it is matched on, so each distinct
    spot is searched once, carries no other column, and its answer is joined back.
    """
    spot = [x, y, *[p for p, _ in on]]
    hits = contained(points.select(*spot).distinct(), shapes, on, x, y, ring, pad)
    best = hits.groupBy(*spot).agg(*[c.alias(n) for n, c in found.items()])
    return points.join(best, spot, "left").select(*points.columns, *found)


def place_of(points: DataFrame, outlines: DataFrame, x: str = "lng", y: str = "lat", name: str = "place") -> DataFrame:
    """The first outline holding each point, by priority then file order; NULL outdoors.

    ``outlines``: ``prio, ord, name, ring``, one row per ring.
    """
    first = {"_b": F.min(F.struct("s_prio", "s_ord", "s_name"))}
    got = with_hits(points, outlines.select("prio", "ord", "name", "ring"), first, x=x, y=y)
    return got.select(*points.columns, F.col("_b.s_name").alias(name))


def _on_floor(nodes: DataFrame, shapes: DataFrame, found: dict[str, Column]) -> DataFrame:
    """:func:`with_hits` for spaces of a node's own building and floor."""
    keyed = nodes.withColumn("_b", F.upper("building"))
    return with_hits(keyed, shapes, found, on=[("_b", "b"), ("floor", "floor")])


def room_of(nodes: DataFrame, spaces: DataFrame, name: str = "found_room") -> DataFrame:
    """The smallest numbered space holding each node on its own building and floor."""
    numbered = (
        spaces.where(F.col("room").isNotNull() & F.col("type").isNotNull() & (F.col("type") != "building"))
        .select(F.upper("building").alias("b"), "floor", "room", geo.area("ring").alias("area"), "ring"))
    got = _on_floor(nodes, numbered, {"_m": F.min(F.struct("s_area", "s_room"))})
    return got.select(*nodes.columns, F.col("_m.s_room").alias(name))


def inside_any(nodes: DataFrame, spaces: DataFrame, name: str = "inside") -> DataFrame:
    """Whether a node stands in any traced space of its floor; no floor means no."""
    shapes = spaces.where(F.col("type").isNotNull() & (F.col("type") != "building")).select(
        F.upper("building").alias("b"), "floor", "ring")
    got = _on_floor(nodes, shapes, {"_m": F.count(F.lit(1))})
    return got.select(*nodes.columns, F.col("_m").isNotNull().alias(name))


def _three_by_three(df: DataFrame, x: Column, y: Column, sx: Column, sy: Column) -> DataFrame:
    off = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (df.withColumn("_dx", F.explode(off)).withColumn("_dy", F.explode(off))
            .withColumn("_cx", F.floor(x / sx) + F.col("_dx")).withColumn("_cy", F.floor(y / sy) + F.col("_dy"))
            .drop("_dx", "_dy"))


#: Keys of the cells that :func:`look_around` and :func:`seen_from` meet on.
GLOBE = ("_band", "_col")
_NEXT = (-1, 0, 1)


def _columns(band: Column, size: float) -> Column:
    """Whole cells around the globe in a latitude band, each at least ``size`` degrees of latitude wide there."""
    edge = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)) + size, F.lit(90.0))
    return F.greatest(F.floor(F.lit(360.0 / size) * F.cos(F.radians(edge))), F.lit(1)).cast("bigint")


def _column(x: Column, band: Column, size: float) -> Column:
    n = _columns(band, size)
    return F.pmod(F.floor((x + 180.0) / (F.lit(360.0) / n)).cast("bigint"), n)


def look_around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """A row for each of the cells next to a point in its own band, across the date line too."""
    band = F.floor(F.col(y) / F.lit(size))
    n = _columns(band, size)
    beside = F.array_distinct(F.transform(F.array(*map(F.lit, _NEXT)), lambda d: F.pmod(_column(F.col(x), band, size) + d, n)))
    return df.withColumn(GLOBE[0], band).withColumn(GLOBE[1], F.explode(beside))


def seen_from(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """A row for each band that looks at a point, keyed by that band's columns."""
    bands = F.transform(F.array(*map(F.lit, _NEXT)), lambda d: F.floor(F.col(y) / F.lit(size)) + d)
    return df.withColumn(GLOBE[0], F.explode(bands)).withColumn(GLOBE[1], _column(F.col(x), F.col(GLOBE[0]), size))


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, order: str, start_m: float = 100.0,
            radius: float = geo.ROUTE_RADIUS_M, x: str = "lng", y: str = "lat", reach_m: float | None = None) -> DataFrame:
    """The nearest target of each point and its distance; ties go to the lowest ``order``.

    A point first looks at the 3 by 3 cells around it and keeps an answer no farther
    than one cell, which nothing outside can beat. Points without one go down a pyramid
    of tiles (:mod:`placegraph.operators.pyramid`). Targets on one spot are reduced to
    their first beforehand, so a crowded spot costs one row. With ``reach_m`` only
    targets so near count. Returns ``key, target_key, metres``.
    """
    deg = geo.metres_per_degree(radius)
    start_m = min(start_m, reach_m) if reach_m else start_m
    spots = targets.groupBy(F.col(x).alias("_tx"), F.col(y).alias("_ty")).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(target_key).alias("k"))).alias("_t"))
    spots, seen = materialise(spots, rows=F.count(F.lit(1)))
    todo = points.select(F.col(key), F.col(x).alias("_px"), F.col(y).alias("_py")).where(
        F.col("_px").isNotNull() & F.col("_py").isNotNull() & ~F.isnan("_px") & ~F.isnan("_py"))
    metres = geo.haversine_m("_px", "_py", "_tx", "_ty", radius)
    if not seen["rows"]:
        return todo.where(F.lit(False)).select(
            key, F.lit(None).cast(targets.schema[target_key].dataType).alias(target_key), F.lit(0.0).alias("metres"))
    size = start_m / deg
    cand = look_around(todo, "_px", "_py", size).join(seen_from(spots, "_tx", "_ty", size), list(GLOBE))
    best = cand.groupBy(key).agg(F.min(F.struct(metres.alias("d"), F.col("_t.o").alias("o"), F.col("_t.k").alias("k"))).alias("_m"))
    done = F.coalesce(F.col("_m.d") <= start_m, F.lit(False))
    tried, n = materialise(todo.join(best, key, "left").withColumn("_done", done), left=F.count_if(~done))
    got = tried.where("_done").select(key, F.col("_m.k").alias(target_key), F.col("_m.d").alias("metres"))
    if not n["left"] or (reach_m is not None and reach_m <= start_m):
        return got
    rest = tried.where(~F.col("_done")).select(key, "_px", "_py")
    straight = None if reach_m is None else 2.0 * math.sin(min(reach_m / radius, math.pi) / 2)  # the chord of an arc
    far = pyramid.nearest_by_tiles(rest, spots.select("_tx", "_ty", F.col("_t.o").alias("_o"), F.col("_t.k").alias("_k")), key, pyramid.on_sphere("_px", "_py"),
                                   pyramid.on_sphere("_tx", "_ty"), metres, ["_o", "_k"], leaf=max(start_m, 100.0) / radius, reach=straight)
    return got.unionByName(far.select(key, F.col("_k").alias(target_key), F.col("d").alias("metres")))


def within_reach(points: DataFrame, targets: DataFrame, reach: float, on: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs no farther apart than ``reach`` in plane units; target columns come back as ``t_*``, distance as ``d``."""
    size = F.lit(float(reach))
    left = _three_by_three(points, F.col(x), F.col(y), size, size)
    right = _rename(targets.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size)), "t_")
    cond = (F.col("_cx") == F.col("t__cx")) & (F.col("_cy") == F.col("t__cy"))
    cond = cond & (F.abs(F.col(x) - F.col("t_" + x)) <= size) & (F.abs(F.col(y) - F.col("t_" + y)) <= size)
    for c in on:
        cond = cond & (F.col(c) == F.col("t_" + c))
    d = F.hypot(F.col(x) - F.col("t_" + x), F.col(y) - F.col("t_" + y))
    return left.join(right, cond).drop("_cx", "_cy", "t__cx", "t__cy").withColumn("d", d).where(F.col("d") <= size)


def nearest_shapes(points: DataFrame, shapes: DataFrame, reach: float, key: str, k: int, on: Sequence[tuple[str, str]] = (),
                   x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest shapes by edge distance (0 when inside), within ``reach``; ranked."""
    near = contained(points, shapes, on=on, x=x, y=y, pad=reach)
    near = near.select("*", geo.once(geo.distance_to_shape("s__e", x, y), lambda d: d <= reach).alias("d")).drop("s__e")
    return top_k(near, [key], [F.col("d"), F.col("s_ord")], k)


def overlapping_boxes(shapes: DataFrame, on: Sequence[str], pad: float = 0.0) -> DataFrame:
    """Each unordered pair of shapes with touching boxes, once; columns ``a_*`` and ``b_*``.

    A shape meets the larger ones at their level, where it too covers at most
    four cells. A pair is kept only in the cell holding the corner of the common
    box, so pairs sharing several cells need no distinct. Needs ``ord`` unique per group.
    """
    boxed = _boxed(shapes, "ring", pad / 2)
    # Own-level rows are the larger side, rows at coarser levels the smaller.
    big = _rename(_covered(boxed), "a_")
    small = boxed.withColumn("_own", F.col("_lv")).withColumn("_lvs", _level_list(boxed)).withColumn(
        "_lv", F.explode(F.filter("_lvs", lambda v: v >= F.col("_own")))).drop("_lvs")
    small = _rename(_covered(small), "b_")
    cond = (F.col("a__lv") == F.col("b__lv")) & (F.col("a__cx") == F.col("b__cx")) & (F.col("a__cy") == F.col("b__cy"))
    for c in on:
        cond = cond & (F.col("a_" + c) == F.col("b_" + c))
    cond = cond & (F.col("a__x0") <= F.col("b__x1")) & (F.col("b__x0") <= F.col("a__x1"))
    cond = cond & (F.col("a__y0") <= F.col("b__y1")) & (F.col("b__y0") <= F.col("a__y1"))
    cond = cond & ((F.col("b__own") < F.col("a__lv")) | (F.col("a_ord") < F.col("b_ord")))
    corner = (_cell(F.greatest("a__x0", "b__x0"), F.col("a__lv")) == F.col("a__cx")) & (
        _cell(F.greatest("a__y0", "b__y0"), F.col("a__lv")) == F.col("a__cy"))
    drop = [p + c for p in "ab" for c in ("__lv", "__cx", "__cy", "__x0", "__x1", "__y0", "__y1")] + ["b__own"]
    return big.join(small, cond & corner).drop(*drop)


def meeting_boxes(a: DataFrame, b: DataFrame, on: Sequence[str], pad: float = 0.0) -> DataFrame:
    """Pairs of a shape of ``a`` and one of ``b`` with boxes no farther apart than ``pad``; columns ``a_*`` and ``b_*``.

    Of a pair the larger covers at most four cells of its own level and the smaller at
    most four there, whichever side each is on; a pair is kept in the cell of the
    common box's corner.
    """
    def side(big: DataFrame, small: DataFrame, big_as: str, small_as: str, strict: bool) -> DataFrame:
        coarser = lambda v: v > F.col("_own") if strict else v >= F.col("_own")
        down = small.withColumn("_own", F.col("_lv")).withColumn("_lvs", _level_list(big)).withColumn("_lv", F.explode(F.filter("_lvs", coarser))).drop("_lvs", "_own")
        cond = F.lit(True)
        for c in ("_lv", "_cx", "_cy", *on):
            cond = cond & (F.col("a_" + c) == F.col("b_" + c))
        cond = cond & (F.col("a__x0") <= F.col("b__x1")) & (F.col("b__x0") <= F.col("a__x1")) & (F.col("a__y0") <= F.col("b__y1")) & (F.col("b__y0") <= F.col("a__y1"))
        corner = (_cell(F.greatest("a__x0", "b__x0"), F.col("a__lv")) == F.col("a__cx")) & (_cell(F.greatest("a__y0", "b__y0"), F.col("a__lv")) == F.col("a__cy"))
        return _rename(_covered(big), big_as).join(_rename(_covered(down), small_as), cond & corner)

    left, right = _boxed(a, "ring", pad / 2), _boxed(b, "ring", pad / 2)
    drop = [p + c for p in ("a_", "b_") for c in ("_lv", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1")]
    return side(right, left, "b_", "a_", False).drop(*drop).unionByName(side(left, right, "a_", "b_", True).drop(*drop))


def overlaps(shapes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs of shapes with a common area: ``a_ord < b_ord``, both areas, ``common``."""
    prepared = shapes.select(*on, "ord", "ring", geo.area("ring").alias("area"), geo.strips("ring").alias("strips"), F.array_min(geo.ys("ring")).alias("low"))
    pairs = overlapping_boxes(prepared, on)
    common = geo.common_area("a_strips", "b_strips", F.least("a_low", "b_low"))
    swap = F.col("a_ord") > F.col("b_ord")
    pick = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
    small = F.least("a_area", "b_area")
    hits = pairs.select("*", geo.once(common, lambda v: v > 1e-12 * small).alias("common"))
    return hits.select(
        *[F.col("a_" + c).alias(c) for c in on], pick("a_ord", "b_ord").alias("a_ord"), pick("b_ord", "a_ord").alias("b_ord"),
        pick("a_area", "b_area").alias("a_area"), pick("b_area", "a_area").alias("b_area"), "common")


def doorways(shapes: DataFrame, on: Sequence[str], gap: float) -> DataFrame:
    """Closest approach of every pair of shapes within ``gap``: the midpoint is the doorway.

    One row per pair with ``ax, ay, bx, by`` (the two ends), ``x, y`` and ``d``.
    """
    pairs = overlapping_boxes(shapes.select(*on, "ord", "ring"), on, pad=gap)

    def foot(p, e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - e["ax"]) * dx + (p["y"] - e["ay"]) * dy) / len2))).otherwise(0.0)
        qx, qy = e["ax"] + t * dx, e["ay"] + t * dy
        return F.struct(F.hypot(p["x"] - qx, p["y"] - qy).alias("d"), p["x"].alias("px"), p["y"].alias("py"),
                        qx.alias("qx"), qy.alias("qy"))

    def ends(ring, other):
        sides = geo.edges(other)
        return F.array_min(F.flatten(F.transform(F.col(ring), lambda p: F.transform(sides, lambda e: foot(p, e)))))

    near = pairs.select("*", geo.once(F.struct(ends("a_ring", "b_ring").alias("f"), ends("b_ring", "a_ring").alias("g"))).alias("_e")).select(
        "*", F.col("_e.f").alias("_f"), F.col("_e.g").alias("_g"))
    a_first = F.col("_f.d") <= F.col("_g.d")
    pick = lambda u, v: F.when(a_first, F.col(u)).otherwise(F.col(v))
    near = near.select(
        *[F.col("a_" + c).alias(c) for c in on], F.least("a_ord", "b_ord").alias("a_ord"), F.greatest("a_ord", "b_ord").alias("b_ord"),
        pick("_f.d", "_g.d").alias("d"), pick("_f.px", "_g.qx").alias("ax"), pick("_f.py", "_g.qy").alias("ay"),
        pick("_f.qx", "_g.px").alias("bx"), pick("_f.qy", "_g.py").alias("by"))
    return near.where(F.col("d") <= gap).withColumn("x", (F.col("ax") + F.col("bx")) / 2).withColumn("y", (F.col("ay") + F.col("by")) / 2)


def bounds(shapes: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """Bounding box and its centre per key."""
    b = shapes.select(*keys, geo.box(ring).alias("b"))
    out = b.groupBy(*keys).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    return out.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def fit_box(shapes: DataFrame, keys: Sequence[str], least_m: float = 20.0) -> DataFrame:
    """Centre and width in metres of each building's outline, for placing a sheet on it."""
    deg = geo.metres_per_degree(geo.WEIGHT_RADIUS_M)
    w = (F.col("x1") - F.col("x0")) * F.cos(F.radians("cy")) * deg
    return bounds(shapes, keys).select(*keys, F.col("cx").alias("lng"), F.col("cy").alias("lat"),
                                       F.greatest(w, F.lit(least_m)).alias("width_m"))


def sheet_labels(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The feature with the largest box of each sheet, and the centre of that box."""
    b = shapes.withColumn("b", geo.box("ring"))
    size = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    best = b.groupBy(*keys).agg(F.max(F.struct(size.alias("s"), (-F.col("ord")).alias("o"), "b")).alias("m"))
    return best.select(*keys, (-F.col("m.o")).alias("ord"), ((F.col("m.b.x0") + F.col("m.b.x1")) / 2).alias("x"),
                       ((F.col("m.b.y0") + F.col("m.b.y1")) / 2).alias("y"))


def footprint_centres(outlines: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """Centre per building code: the index's own when it has one, else the mean of all vertices."""
    pts = outlines.select(F.upper(F.trim("name")).alias("code"), F.explode("ring").alias("p"))
    mean = pts.groupBy("code").agg(F.avg("p.x").alias("mx"), F.avg("p.y").alias("my"), F.count(F.lit(1)).alias("vertices"))
    if centres is None:
        return mean.select("code", F.col("mx").alias("lng"), F.col("my").alias("lat"), "vertices")
    idx = centres.select(F.upper(F.trim("code")).alias("code"), F.col("lng").alias("ilng"), F.col("lat").alias("ilat"))
    return mean.join(idx, "code", "left").select(
        "code", F.coalesce("ilng", "mx").alias("lng"), F.coalesce("ilat", "my").alias("lat"), "vertices")


def in_mode_places(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes of each chosen place and floor (``building, floor``; NULL building: outdoors, NULL floor: all).

    A node on no storey is on every floor of its place. Returns the chosen pair and ``nid``.
    """
    c = chosen.select(F.col("building").alias("_b"), F.col("floor").alias("_f"))
    here = F.col("building").eqNullSafe(F.col("_b")) & (F.col("_f").isNull() | F.col("floor").isNull() | (F.col("floor") == F.col("_f")))
    return c.join(nodes, here).select(F.col("_b").alias("building"), F.col("_f").alias("floor"), "nid")


def room_doors(shapes: DataFrame, on: Sequence[str], gap: float, corridors: Sequence[str] = ("corridor", "hallway"),
               rooms: Sequence[str] = ("room", "stairs")) -> DataFrame:
    """One door for each numbered room: where it comes closest to its nearest corridor, if within ``gap``.

    On a floor without corridors the nearest other numbered room takes their place.
    Ties go to the lower ``ord``. Returns ``on, ord, other, d, x, y``.
    """
    kind = F.when(F.col("type").isin(*corridors), "corridor").when(F.col("type").isin(*rooms) & (F.coalesce("room", F.lit("")) != ""), "room")
    marked = shapes.withColumn("_k", kind).where("_k IS NOT NULL")
    floors = marked.groupBy(*on).agg(F.bool_or(F.col("_k") == "corridor").alias("_any"))
    near = doorways(marked.select(*on, "ord", "ring"), on, gap).select(*on, "a_ord", "b_ord", "d", "x", "y")
    ways = near.select(*on, F.col("a_ord").alias("ord"), F.col("b_ord").alias("other"), "d", "x", "y").unionByName(
        near.select(*on, F.col("b_ord").alias("ord"), F.col("a_ord").alias("other"), "d", "x", "y"))
    kinds = marked.select(*on, "ord", "_k")
    ways = ways.join(kinds.withColumnRenamed("_k", "_own"), [*on, "ord"]).join(kinds.select(*on, F.col("ord").alias("other"), "_k"), [*on, "other"])
    fit = (F.col("_own") == "room") & ((F.col("_k") == "corridor") == F.col("_any"))
    best = ways.join(floors, list(on)).where(fit).groupBy(*on, "ord").agg(F.min(F.struct("d", "other", "x", "y")).alias("m"))
    return best.select(*on, "ord", "m.other", "m.d", "m.x", "m.y")
