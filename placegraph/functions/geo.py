"""Geometry as column expressions: no Python at run time, no library behind it.

A ring is ``array<struct<x double, y double>>``. Outlines are prepared once as
arrays of edges, so that tests against many points do not rebuild them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii in metres, one for routing and one for weights.
ROUTE_RADIUS_M = 6371000.0
WEIGHT_RADIUS_M = 6378137.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def point(x, y) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def ring_of(*xy) -> Column:
    """A closed ring from (x, y) column pairs."""
    pts = [point(x, y) for x, y in xy]
    return F.array(*pts, pts[0])


def rectangle(x0, y0, x1, y1) -> Column:
    return ring_of((x0, y0), (x1, y0), (x1, y1), (x0, y1))


# -- distances ---------------------------------------------------------------

def haversine_m(lng1, lat1, lng2, lat2, radius: float = ROUTE_RADIUS_M) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    sy, sx = F.sin((p2 - p1) / 2), F.sin(F.radians(_c(lng2) - _c(lng1)) / 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(sy * sy + F.cos(p1) * F.cos(p2) * sx * sx))


def metres_per_degree(radius: float = WEIGHT_RADIUS_M) -> float:
    return math.pi * radius / 180.0


def flat_m(lng1, lat1, lng2, lat2, radius: float = WEIGHT_RADIUS_M) -> Column:
    """Equirectangular metres, good at campus scale."""
    k = metres_per_degree(radius)
    dx = (_c(lng2) - _c(lng1)) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2)) * k
    return F.hypot(dx, (_c(lat2) - _c(lat1)) * k)


def local_x(lng, lng0, lat0, radius: float = WEIGHT_RADIUS_M) -> Column:
    return F.radians(_c(lng) - _c(lng0)) * F.cos(F.radians(_c(lat0))) * radius


def local_y(lat, lat0, radius: float = WEIGHT_RADIUS_M) -> Column:
    return F.radians(_c(lat) - _c(lat0)) * radius


def from_local(x, y, lng0, lat0, radius: float = WEIGHT_RADIUS_M) -> Column:
    lat = _c(lat0) + F.degrees(_c(y) / radius)
    lng = _c(lng0) + F.degrees(_c(x) / (F.cos(F.radians(_c(lat0))) * radius))
    return point(lng, lat)


# -- ring measures -----------------------------------------------------------

def xs(ring) -> Column:
    return F.transform(_c(ring), lambda p: p["x"])


def ys(ring) -> Column:
    return F.transform(_c(ring), lambda p: p["y"])


def edges(ring) -> Column:
    """Edges of a ring, closed whether or not the last point repeats the first."""
    r = _c(ring)
    return F.zip_with(
        r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def box(ring) -> Column:
    r = _c(ring)
    return F.struct(F.array_min(xs(r)).alias("x0"), F.array_min(ys(r)).alias("y0"),
                    F.array_max(xs(r)).alias("x1"), F.array_max(ys(r)).alias("y1"))


def box_of_rings(rings) -> Column:
    return box(F.flatten(_c(rings)))


def area(ring) -> Column:
    """Shoelace area, about the first vertex to keep digits."""
    r = _c(ring)
    ox, oy = F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]
    return F.abs(F.aggregate(
        edges(r), F.lit(0.0),
        lambda acc, e: acc + (e["ax"] - ox) * (e["by"] - oy) - (e["bx"] - ox) * (e["ay"] - oy))) / 2


def vertex_mean(ring) -> Column:
    """Mean of every vertex given, the closing one included."""
    r = _c(ring)
    mean = lambda vals: F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(r)
    return point(mean(xs(r)), mean(ys(r)))


# -- predicates --------------------------------------------------------------

def inside_edges(edge_array, x, y) -> Column:
    """Even-odd containment against prepared edges."""
    px, py = _c(x), _c(y)
    crossed = F.filter(
        _c(edge_array),
        lambda e: ((e["by"] > py) != (e["ay"] > py))
        & (px < (e["ax"] - e["bx"]) * (py - e["by"]) / (e["ay"] - e["by"]) + e["bx"]))
    return F.size(crossed) % 2 == 1


def inside_ring(ring, x, y) -> Column:
    return inside_edges(edges(ring), x, y)


def holds(edge_array, ring) -> Column:
    """Whether a shape lies within a ring: its first corner does and no edge meets one of the ring's.

    Edges without length, as between a closing corner and the first, meet nothing.
    """
    some = lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"])
    turn = lambda ax, ay, bx, by, x, y: F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))

    def meet(e, f):
        a, b = turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
        c, d = turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]), turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
        return some(e) & some(f) & (a * b <= 0) & (c * d <= 0)

    r = _c(ring)
    first = F.element_at(r, 1)
    return inside_edges(edge_array, first["x"], first["y"]) & ~F.exists(edges(r), lambda f: F.exists(_c(edge_array), lambda e: meet(e, f)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / len2))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def edge_distance(edge_array, x, y) -> Column:
    """Distance to the nearest edge, whatever side the point is on."""
    return F.array_min(F.transform(
        _c(edge_array), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])))


def distance_to_shape(edge_array, x, y) -> Column:
    return F.when(inside_edges(edge_array, x, y), F.lit(0.0)).otherwise(edge_distance(edge_array, x, y))


def strips(ring) -> Column:
    """A polygon as signed strips under its edges: what :func:`common_area` reads. Prepare it once per shape."""
    def strip(e):
        left = e["ax"] <= e["bx"]
        pick = lambda u, v: F.when(left, u).otherwise(v)
        return F.struct(pick(e["ax"], e["bx"]).alias("l"), pick(e["ay"], e["by"]).alias("hl"), pick(e["bx"], e["ax"]).alias("r"),
                        pick(e["by"], e["ay"]).alias("hr"), F.when(left, F.lit(1.0)).otherwise(-1.0).alias("s"))

    return F.transform(F.filter(edges(ring), lambda e: e["ax"] != e["bx"]), strip)


def common_area(strips_a, strips_b, base) -> Column:
    """Exact common area of two simple polygons from their strips.

    A polygon is the signed sum of the strips under its edges, so the common
    area is the signed sum over edge pairs of the area under both edges, above
    ``base``, a height at or below both shapes.
    """
    base = _c(base)

    def height(t, x):
        return t["hl"] + (t["hr"] - t["hl"]) * (x - t["l"]) / (t["r"] - t["l"]) - base

    def under_both(e, f):
        lo, hi = F.greatest(e["l"], f["l"]), F.least(e["r"], f["r"])
        el, er, fl, fr = height(e, lo), height(e, hi), height(f, lo), height(f, hi)
        dl, dr = el - fl, er - fr
        spread = F.abs(dl) + F.abs(dr)
        gap = F.when(dl * dr >= 0, spread / 2).otherwise((dl * dl + dr * dr) / (2 * spread))
        return F.when(lo < hi, e["s"] * f["s"] * (hi - lo) * ((el + er + fl + fr) / 4 - gap / 2)).otherwise(0.0)

    total = F.aggregate(_c(strips_a), F.lit(0.0), lambda acc, e: acc + F.aggregate(
        _c(strips_b), F.lit(0.0), lambda inner, f: inner + under_both(e, f)))
    return F.abs(total)


def intersection_area(ring_a, ring_b) -> Column:
    """Common area of two rings."""
    return common_area(strips(ring_a), strips(ring_b), F.least(F.array_min(ys(ring_a)), F.array_min(ys(ring_b))))


def once(column: Column, keep=None) -> Column:
    """The value as a generator row, so a costly expression is neither repeated nor pushed into a filter.

    With ``keep`` (a test of the value) the row is dropped where it fails.
    """
    one = F.array(column)
    return F.explode(F.filter(one, keep) if keep else one)


# -- transforms --------------------------------------------------------------

def map_ring(ring, fx, fy) -> Column:
    return F.transform(_c(ring), lambda p: F.struct(fx(p["x"], p["y"]).alias("x"), fy(p["x"], p["y"]).alias("y")))


def similarity(ring, scale, theta, tx, ty) -> Column:
    """Rotate, scale, move; the result is closed."""
    s, c, si, tx, ty = _c(scale), F.cos(_c(theta)), F.sin(_c(theta)), _c(tx), _c(ty)
    moved = map_ring(ring, lambda x, y: s * (c * x - si * y) + tx, lambda x, y: s * (si * x + c * y) + ty)
    return close_ring(moved)


def close_ring(ring) -> Column:
    r = _c(ring)
    return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))


def translate(ring, dx, dy) -> Column:
    return map_ring(ring, lambda x, y: x + _c(dx), lambda x, y: y + _c(dy))


def stretch_about_mean(ring, sx, sy, degrees=0.0) -> Column:
    """Stretch then turn a ring about the mean of its vertices."""
    m, t = vertex_mean(ring), F.radians(_c(degrees))
    ux = lambda x: (x - m["x"]) * _c(sx)
    uy = lambda y: (y - m["y"]) * _c(sy)
    return map_ring(ring, lambda x, y: m["x"] + ux(x) * F.cos(t) - uy(y) * F.sin(t),
                    lambda x, y: m["y"] + ux(x) * F.sin(t) + uy(y) * F.cos(t))


def plan_to_world(u, v, lng0, lat0, width_m, rotation, aspect=1.0, radius: float = WEIGHT_RADIUS_M) -> Column:
    """Sheet position (0..1 each way, v downward) to lng/lat of a placed sheet."""
    x, y = (_c(u) - 0.5) * _c(width_m), (0.5 - _c(v)) * _c(width_m) * _c(aspect)
    t = F.radians(_c(rotation))
    return from_local(x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t), lng0, lat0, radius)


def world_to_plan(lng, lat, lng0, lat0, width_m, rotation, aspect=1.0, radius: float = WEIGHT_RADIUS_M) -> Column:
    x, y = local_x(lng, lng0, lat0, radius), local_y(lat, lat0, radius)
    t = F.radians(_c(rotation))
    px, py = x * F.cos(t) + y * F.sin(t), y * F.cos(t) - x * F.sin(t)
    return F.struct((px / _c(width_m) + 0.5).alias("u"), (0.5 - py / (_c(width_m) * _c(aspect))).alias("v"))


def fold_angle(degrees) -> Column:
    """An angle folded to -45..45, for outlines that repeat every quarter turn."""
    return F.pmod(_c(degrees) + 45.0, F.lit(90.0)) - 45.0


def turn(degrees) -> Column:
    return F.pmod(_c(degrees) + 180.0, F.lit(360.0)) - 180.0
