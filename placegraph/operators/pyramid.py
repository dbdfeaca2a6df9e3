"""Nearest targets at any distance through a pyramid of tiles.

Targets are summed up in tiles, tiles in larger ones: each knows the box of what it
holds. A point goes down from the top with the few tiles that can still hold its
answer: one is dropped when even its nearest corner is farther than the farthest
corner of another. So a far point reads some tiles a level, not every target of the
first cell that holds any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.session import materialise

#: Tiles that one larger tile spans each way.
STEP = 4
#: Targets to a leaf where its width is not given.
CROWD = 8
#: Part of a bound given away to rounding.
SLACK = 1e-9


def on_sphere(lng: str, lat: str) -> list[Column]:
    """A place as a point of the unit sphere, where straight distance orders as distance over ground."""
    x, y = F.radians(lng), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _levels(targets: DataFrame, at: list[str], leaf: float | None) -> tuple[list[float], float, int]:
    """Lower corner of all targets, the leaf's width and how many levels put all in one tile."""
    row = targets.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"l{i}") for i, c in enumerate(at)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(at)]).first()
    low = [row[f"l{i}"] or 0.0 for i in range(len(at))]
    wide = max((row[f"h{i}"] or 0.0) - v for i, v in enumerate(low))
    leaf, levels = leaf or wide / max(1.0, (row["n"] / CROWD) ** 0.5) or 1.0, 0
    while leaf * STEP**levels <= wide:
        levels += 1
    return low, leaf, levels


def nearest_by_tiles(points: DataFrame, targets: DataFrame, key: str, at: Sequence[Column], to: Sequence[Column], distance: Column, best: Sequence[str], leaf: float | None = None,
                     on: Sequence[str] = (), reach: float | None = None, report: list[int] | None = None) -> DataFrame:
    """For each point the target of least ``distance``, then of least ``best``: ``points``' columns, ``d`` and those of ``best``.

    ``at`` and ``to`` are coordinates of points and targets, in which straight
    distance orders as ``distance`` does; ``leaf`` is the width of the smallest tile, by
    default such that evenly spread targets are ``CROWD`` to a tile.
    ``on`` columns must be equal. With ``reach``, a straight distance, farther targets do
    not count. Points with a null coordinate or without any target come not back.
    ``report`` is told the tiles read at each level.
    """
    spot = [f"_t{i}" for i in range(len(to))]
    cell = [f"_c{i}" for i in range(len(to))]
    dims = range(len(to))
    t, _ = materialise(targets.select("*", *[c.cast("double").alias(s) for c, s in zip(to, spot)]).dropna(subset=[*spot, *on]))
    low, leaf, levels = _levels(t, spot, leaf)
    down = lambda s, i: F.floor((F.col(s) - F.lit(low[i])) / F.lit(leaf)).cast("bigint")
    t, _ = materialise(t.select("*", *[down(s, i).alias(c) for i, (s, c) in enumerate(zip(spot, cell))]))
    tiles = [t.groupBy(*on, *cell).agg(*[F.min(s).alias(f"_l{i}") for i, s in enumerate(spot)], *[F.max(s).alias(f"_h{i}") for i, s in enumerate(spot)])]
    for _ in range(levels):
        small, _ = materialise(tiles[-1])
        tiles[-1] = small
        up = [F.floor(F.col(c) / STEP).alias(c) for c in cell]
        tiles.append(small.groupBy(*on, *up).agg(*[F.min(f"_l{i}").alias(f"_l{i}") for i in dims], *[F.max(f"_h{i}").alias(f"_h{i}") for i in dims]))
    here = [f"_p{i}" for i in dims]
    p = points.select("*", *[c.cast("double").alias(h) for c, h in zip(at, here)]).dropna(subset=[*here, *on])
    for h in here:
        p = p.where(~F.isnan(h))
    # At the top there is one tile (for each value of ``on``), so every point starts with the zero cell.
    state = p.select("*", F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in cell])).alias("_open"))
    for level in range(levels, -1, -1):
        children = tiles[level].select(*on, *[F.col(c).alias(f"_n{c}") for c in cell], *[(F.floor(F.col(c) / STEP) if level < levels else F.lit(0).cast("bigint")).alias(c) for c in cell],
                                       *[f"_l{i}" for i in dims], *[f"_h{i}" for i in dims])
        if level == levels and not on:
            children = F.broadcast(children)  # one row
        met = state.withColumn("_o", F.explode("_open")).drop("_open").select("*", *[F.col(f"_o.{c}").alias(c) for c in cell]).drop("_o").join(children, [*on, *cell])
        gap = lambda i: F.greatest(F.col(f"_l{i}") - F.col(here[i]), F.col(here[i]) - F.col(f"_h{i}"), F.lit(0.0))
        far = lambda i: F.greatest(F.abs(F.col(here[i]) - F.col(f"_l{i}")), F.abs(F.col(here[i]) - F.col(f"_h{i}")))
        met = met.withColumn("_lb", sum((gap(i) * gap(i) for i in dims), F.lit(0.0))).withColumn("_ub", sum((far(i) * far(i) for i in dims), F.lit(0.0)))
        if reach is not None:
            met = met.where(F.col("_lb") <= reach * reach * (1 + SLACK) + SLACK * SLACK)
        names = [c for c in points.columns if c != key]
        kept = met.groupBy(key).agg(*[F.first(c).alias(c) for c in [*names, *here]], F.min("_ub").alias("_ub"),
                                    F.collect_list(F.struct("_lb", F.struct(*[F.col(f"_n{c}").alias(c) for c in cell]).alias("c"))).alias("_all"))
        open_ = F.transform(F.filter("_all", lambda e: e["_lb"] <= F.col("_ub") * (1 + SLACK) + SLACK * SLACK), lambda e: e["c"])
        state, seen = materialise(kept.select(*points.columns, *here, open_.alias("_open")), rows=F.count(F.lit(1)), tiles=F.coalesce(F.sum(F.size("_open")), F.lit(0)))
        if report is not None:
            report.append(seen["tiles"])
    last = state.withColumn("_o", F.explode("_open")).drop("_open").select("*", *[F.col(f"_o.{c}").alias(c) for c in cell]).drop("_o")
    found = last.join(t.select(*on, *cell, *spot, *[c for c in t.columns if c not in (*on, *cell, *spot)]), [*on, *cell]).withColumn("d", distance)
    if reach is not None:
        gap2 = sum(((F.col(h) - F.col(s)) * (F.col(h) - F.col(s)) for h, s in zip(here, spot)), F.lit(0.0))
        found = found.where(gap2 <= reach * reach)
    got = found.groupBy(key).agg(*[F.first(c).alias(c) for c in points.columns if c != key], F.min(F.struct("d", *best)).alias("_m"))
    return got.select(*points.columns, "_m.d", *[f"_m.{b}" for b in best])
