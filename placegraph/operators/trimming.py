"""Overlapping outlines cut back along their smaller neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.functions import clip, geo
from placegraph.operators import spatial

SHEET = ("building", "floor")
_RINGS = "array<array<struct<x:double,y:double>>>"


def _apply(batches: Iterator[pd.DataFrame], keep: float) -> Iterator[pd.DataFrame]:
    """Cuts of sorted rows, one shape after another; only the shape at hand is held."""
    key, rings, told = None, [], []

    def ended():
        if key is not None and done:
            points = [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in rings]
            told.append((*key, points, done, refused))

    done = refused = 0
    for pdf in batches:
        for *k, step, xs, ys in pdf.itertuples(index=False):
            ring = clip.exact(zip(xs, ys))
            if tuple(k) != key:
                ended()
                key, done, refused = tuple(k), 0, 0
                rings = [ring] if step == 0 and clip.is_simple(ring) else []
                size = abs(clip.signed_area(ring)) if rings else 0
            elif rings and clip.is_simple(ring) and abs(clip.signed_area(ring)) < size:
                parts = clip.difference(rings, ring)
                left = sum(abs(clip.signed_area(r)) * (1 if i == 0 else -1) for i, r in enumerate(parts[0])) if len(parts) == 1 else 0
                if len(parts) != 1 or left < keep * float(size):
                    refused += 1
                    continue
                # Back to doubles, so that numbers do not grow from cut to cut.
                rings = [r for r in ([(clip.Fraction(float(x)), clip.Fraction(float(y))) for x, y in r] for r in parts[0]) if len(r) > 2]
                size, done = left, done + 1
        yield _frame(told)
        told.clear()
    ended()
    yield _frame(told)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*SHEET, "ord", "rings", "cuts", "refused"])


def trim_overlaps(shapes: DataFrame, least: float = 0.02, keep: float = 0.5) -> DataFrame:
    """Shapes with ``ring``, ``holes``, ``cuts``: a larger shape loses what it shares with a smaller one of its floor.

    A common part counts from ``least`` of the smaller shape on. Smaller shapes cut
    one after another, largest first, each with its outline as it was given. A cut
    that would split the shape or leave less than ``keep`` of it is refused and the
    overlap stays. Shapes of one size do not cut each other. A shape whose outline crosses itself
    neither cuts nor is cut. Common areas are found by cells and measured in the JVM; the cuts
    of a shape run through one task as a stream that holds the shape alone.

    ``shapes``: ``building, floor, ord, ring`` with ``ord`` unique on a floor; other columns are carried.
    """
    base = shapes.select(*SHEET, "ord", "ring")
    pairs = spatial.overlaps(base, SHEET).where(F.col("a_area") != F.col("b_area")).where(F.col("common") / F.least("a_area", "b_area") >= least)
    a_cut = F.col("a_area") > F.col("b_area")
    cuts = pairs.select(*SHEET, F.when(a_cut, F.col("a_ord")).otherwise(F.col("b_ord")).alias("ord"),
                        F.when(a_cut, F.col("b_ord")).otherwise(F.col("a_ord")).alias("other"), F.least("a_area", "b_area").alias("_size"))
    knives = cuts.join(base.withColumnRenamed("ord", "other"), [*SHEET, "other"])
    own = base.join(cuts.select(*SHEET, "ord").distinct(), [*SHEET, "ord"]).select(
        *SHEET, "ord", F.lit(0).alias("step"), F.lit(0.0).alias("_size"), F.lit(None).cast("bigint").alias("other"), "ring")
    rows = own.unionByName(knives.withColumn("step", F.lit(1))).repartition(*SHEET, "ord").sortWithinPartitions(*SHEET, "ord", "step", F.col("_size").desc(), "other")
    narrow = rows.select(*SHEET, "ord", "step", geo.xs("ring").alias("xs"), geo.ys("ring").alias("ys"))
    types = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in (*SHEET, "ord"))
    cut = narrow.mapInPandas(lambda it: _apply(it, keep), f"{types}, rings {_RINGS}, cuts bigint, refused bigint")
    out = shapes.join(cut, [*SHEET, "ord"], "left")
    ring = F.coalesce(F.element_at("rings", 1), F.col("ring"))
    holes = F.coalesce(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), F.array().cast(_RINGS))
    return out.select(*[c for c in shapes.columns if c != "ring"], ring.alias("ring"), holes.alias("holes"), F.coalesce("cuts", F.lit(0)).cast("bigint").alias("cuts"))
