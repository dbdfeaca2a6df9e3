"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.functions import geo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its check over the named derived views."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = D.oracle(sql, *views) if views else sql
        return fn

    return add


def nodes(spark, sf):
    return D.view(spark, sf, "nodes")


def links(spark, sf):
    return D.view(spark, sf, "links")


def _deg(x: str, y: str):
    return ((F.expr(x) - 123000000).cast("double") / 1e6, (F.expr(y) + 20000000).cast("double") / 1e6)


def outlines(spark, sf):
    """Hexagon outlines: ``ord, prio, kind, name, display, ring``."""
    p = D.view(spark, sf, "places")
    # Corner offsets in half widths, in drawing order.
    corners = [(-2, 0), (-1, -2), (1, -2), (2, 0), (1, 2), (-1, 2)]
    ring = geo.ring_of(*[_deg(f"cx + hw * {dx}", f"cy + hh * {dy}") for dx, dy in corners])
    return p.select("ord", "prio", "kind", "name", "display", ring.alias("ring"))


def spaces(spark, sf):
    """Traced rectangles in degrees: ``ord, building, floor, sheet, room, type, name, ring``."""
    s = D.view(spark, sf, "spaces")
    (x0, y0), (x1, y1) = _deg("x0", "y0"), _deg("x1", "y1")
    return s.select("ord", "building", "floor", "sheet", "room", "type", "name", geo.rectangle(x0, y0, x1, y1).alias("ring"))


def plan_spaces(spark, sf):
    """The same rectangles in plan units of their own lattice."""
    s = D.view(spark, sf, "spaces")
    d = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    return s.select("ord", "building", "floor", "sheet", "room", "type", "name", geo.rectangle(*d).alias("ring"))


def r6(c, digits: int = 6):
    return F.round(c, digits)
