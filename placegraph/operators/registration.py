"""Fitting plans onto footprints: angles, similarity transforms, hulls, placement search.

Everything works on many plans at once with grouped sums; candidate placements
are rows, scored by the share of a plan's area that lands inside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from placegraph.functions import geo
from placegraph.operators import spatial
from placegraph.session import materialise

# Drawing scales a title block can plausibly state, and a point in metres.
PLAUSIBLE_SCALES = (50, 75, 100, 125, 150, 200, 250, 300, 400, 500, 600)
POINT_M = 0.0254 / 72


def dominant_angle(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole degree, folded to a quarter turn, that most edge length runs along; the lower one on a tie."""
    e = shapes.select(*keys, F.explode(geo.edges("ring")).alias("e"))
    dx, dy = F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")
    bins = e.select(*keys, F.floor(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(90.0))).alias("bin"), F.hypot(dx, dy).alias("len"))
    total = bins.groupBy(*keys, "bin").agg(F.round(F.sum("len"), 3).alias("len"))
    return total.groupBy(*keys).agg(F.min(F.struct((-F.col("len")).alias("l"), "bin")).alias("m")).select(*keys, F.col("m.bin").alias("angle"))


def principal_angle(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction of the long axis of a cloud of points, in radians."""
    return points.groupBy(*keys).agg(
        (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("angle"), F.count(F.lit(1)).alias("n"))


def similarity_fit(pairs: DataFrame, keys: Sequence[str], fixed_scale: str | None = None) -> DataFrame:
    """Least-squares turn, scale and shift taking (x, y) to (u, v) per key.

    In the plane the answer is closed: sums of products about the means. Returns
    ``keys, n, scale, theta, tx, ty``. ``fixed_scale`` names a column to keep.
    """
    keep = [F.first(fixed_scale).alias("_fixed")] if fixed_scale else []
    m = pairs.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.avg("u").alias("_mu"), F.avg("v").alias("_mv"), *keep)
    c = pairs.join(m, list(keys))
    x, y, u, v = (F.col(a) - F.col(b) for a, b in (("x", "_mx"), ("y", "_my"), ("u", "_mu"), ("v", "_mv")))
    s = c.groupBy(*keys).agg(F.sum(x * u + y * v).alias("a"), F.sum(x * v - y * u).alias("b"), F.sum(x * x + y * y).alias("q"), F.count(F.lit(1)).alias("n"))
    out = s.join(m, list(keys)).withColumn("theta", F.atan2("b", "a"))
    out = out.withColumn("scale", F.col("_fixed") if fixed_scale else F.when(F.col("q") > 0, F.hypot("a", "b") / F.col("q")))
    cs, sn = F.cos("theta"), F.sin("theta")
    return out.select(*keys, "n", "scale", "theta", (F.col("_mu") - F.col("scale") * (cs * F.col("_mx") - sn * F.col("_my"))).alias("tx"),
                      (F.col("_mv") - F.col("scale") * (sn * F.col("_mx") + cs * F.col("_my"))).alias("ty"))


def moved(x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the row's ``scale, theta, tx, ty``."""
    cs, sn = F.cos("theta"), F.sin("theta")
    return F.col("scale") * (cs * x - sn * y) + F.col("tx"), F.col("scale") * (sn * x + cs * y) + F.col("ty")


def _hull(pts: np.ndarray) -> np.ndarray:
    """Corner points of a set, counter-clockwise from the lowest left."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hulls(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Convex hull corners per key: ``keys, i, x, y``.

    Every task first reduces each batch to its own hulls, so what meets in the
    second step is corners only, whatever the size of a key.
    """
    keys = list(keys)
    pts = points.select(*keys, "x", "y")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for key, g in b.groupby(keys, dropna=False):
                h = _hull(g[["x", "y"]].to_numpy())
                parts.append(pd.DataFrame({**dict(zip(keys, key)), "x": h[:, 0], "y": h[:, 1]}))
            if parts:
                yield pd.concat(parts, ignore_index=True)[keys + ["x", "y"]]

    def final(key, g: pd.DataFrame) -> pd.DataFrame:
        h = _hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({**{k: [v] * len(h) for k, v in zip(keys, key)}, "i": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    corners = pts.mapInPandas(partial, pts.schema)
    out = StructType([pts.schema[k] for k in keys] + [StructField("i", DoubleType())] + [pts.schema["x"], pts.schema["y"]])
    return corners.groupBy(*keys).applyInPandas(final, out).withColumn("i", F.col("i").cast("int"))


def inside_share(samples: DataFrame, fits: DataFrame, footprints: DataFrame, keys: Sequence[str], cand: Sequence[str]) -> DataFrame:
    """Share of each plan's sampled area inside its footprint under every candidate fit.

    ``samples``: ``keys, x, y, weight``; ``fits``: ``keys, cand, scale, theta, tx,
    ty``; ``footprints``: ``keys, ring``.
    """
    x, y = moved(F.col("x"), F.col("y"))
    at = samples.select(*keys, "x", "y", "weight").join(fits, list(keys)).select(*keys, *cand, "weight", x.alias("mx"), y.alias("my"))
    one = spatial.with_hits(at, footprints.select(*keys, "ring"), {"_n": F.count(F.lit(1))}, on=[(k, k) for k in keys], x="mx", y="my").withColumn(
        "in", F.col("_n").isNotNull())
    return one.groupBy(*keys, *cand).agg((F.sum(F.when(F.col("in"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("inside"))


def turns(plan: DataFrame, foot: DataFrame, keys: Sequence[str], steps: int = 24) -> DataFrame:
    """Starting fits: the plan's hull scaled to the footprint's by box diagonal and turned all the way round."""
    diag = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    p = plan.groupBy(*keys).agg(diag.alias("_d"), F.avg("x").alias("_px"), F.avg("y").alias("_py")).join(principal_angle(plan, keys).select(*keys, F.col("angle").alias("_pa")), list(keys))
    f = foot.groupBy(*keys).agg(diag.alias("_fd"), F.avg("x").alias("_fx"), F.avg("y").alias("_fy")).join(principal_angle(foot, keys).select(*keys, F.col("angle").alias("_fa")), list(keys))
    j = p.join(f, list(keys)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("scale", F.col("_fd") / F.col("_d"))
    j = j.withColumn("theta", F.col("_fa") - F.col("_pa") + F.col("k") * (2 * np.pi / steps))
    cs, sn = F.cos("theta"), F.sin("theta")
    return j.select(*keys, "k", "scale", "theta", (F.col("_fx") - F.col("scale") * (cs * F.col("_px") - sn * F.col("_py"))).alias("tx"),
                    (F.col("_fy") - F.col("scale") * (sn * F.col("_px") + cs * F.col("_py"))).alias("ty"))


def icp(plan: DataFrame, foot: DataFrame, fits: DataFrame, keys: Sequence[str], rounds: int = 12) -> DataFrame:
    """Fits improved by pairing each hull corner with the nearest footprint corner, scale kept; ``residual`` added.

    Both sides are hull corners, tens of points a key.
    """
    on = [*keys, "k"]
    plan = plan.select(*keys, F.monotonically_increasing_id().alias("_p"), "x", "y")
    plan, _ = materialise(plan)
    foot, _ = materialise(foot.select(*keys, F.col("x").alias("fx"), F.col("y").alias("fy")))

    def paired(f):
        x, y = moved(F.col("x"), F.col("y"))
        at = plan.join(f, list(keys)).withColumn("_mx", x).withColumn("_my", y).join(foot, list(keys))
        d = F.hypot(F.col("_mx") - F.col("fx"), F.col("_my") - F.col("fy"))
        return at.groupBy(*on, "scale", "_p", "x", "y").agg(F.min(F.struct(d.alias("d"), "fx", "fy")).alias("m"))

    for i in range(rounds):
        pairs = paired(fits).select(*on, "scale", "x", "y", F.col("m.fx").alias("u"), F.col("m.fy").alias("v"))
        fits, _ = materialise(similarity_fit(pairs, on, fixed_scale="scale").drop("n"))
    resid = paired(fits).groupBy(*on).agg(F.avg("m.d").alias("residual"))
    return fits.join(resid, on)


def best_fit(fits: DataFrame, shares: DataFrame, keys: Sequence[str], most: int = 8) -> DataFrame:
    """Of each plan's few closest fits, the one with the largest share inside; the closer on a tie."""
    from placegraph.operators.common import top_k

    near = top_k(fits, list(keys), [F.col("residual"), F.col("k")], most, rank="_rank")
    j = near.join(shares, [*keys, "k"]).withColumn("_s", F.round("inside", 6))
    return j.groupBy(*keys).agg(F.max_by(F.struct("k", "scale", "theta", "tx", "ty", "residual", "inside"), F.struct("_s", -F.col("_rank"))).alias("m")).select(*keys, "m.*")


def best_shared_fit(scores: DataFrame, building: str = "building") -> DataFrame:
    """One fit for a whole building: the highest mean share over its floors, the closest on a tie.

    ``scores``: ``building, fit, floor, inside, residual``.
    """
    mean = scores.groupBy(building, "fit").agg(F.avg("inside").alias("mean"), F.min("residual").alias("residual"))
    return mean.groupBy(building).agg(F.max_by(F.struct("fit", "mean", "residual"), F.struct("mean", -F.col("residual"))).alias("m")).select(building, "m.*")


def refine(samples: DataFrame, fits: DataFrame, footprints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fits nudged about the plan's own centre: a coarse then a fine grid of turns and shifts.

    The placement with the most area inside wins, the one moved least on a tie.
    """
    steps = lambda lo, hi, by: [lo + by * i for i in range(int(round((hi - lo) / by)) + 1)]
    grids = ((steps(-60.0, 60.0, 2.0), steps(-8.0, 8.0, 4.0)), (steps(-2.5, 2.5, 0.25), steps(-3.0, 3.0, 1.0)))
    x, y = moved(F.col("x"), F.col("y"))
    centre = samples.join(fits, list(keys)).groupBy(*keys).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    base, _ = materialise(fits.join(centre, list(keys)).select(*keys, "scale", "theta", "tx", "ty", "_cx", "_cy", F.lit(0.0).alias("dth"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))
    for turn, shift in grids:
        many = lambda vals: F.explode(F.array(*[F.lit(float(v)) for v in vals]))
        g = base.withColumn("a", many(turn)).withColumn("b", many(shift)).withColumn("c", many(shift))
        g = g.withColumn("nth", F.col("dth") + F.col("a")).withColumn("nx", F.col("dx") + F.col("b")).withColumn("ny", F.col("dy") + F.col("c"))
        t = F.radians("nth")
        px, py = F.col("tx") - F.col("_cx"), F.col("ty") - F.col("_cy")
        cand = g.select(*keys, "nth", "nx", "ny", "scale", (F.col("theta") + t).alias("theta"), (F.cos(t) * px - F.sin(t) * py + F.col("_cx") + F.col("nx")).alias("tx"),
                        (F.sin(t) * px + F.cos(t) * py + F.col("_cy") + F.col("ny")).alias("ty"))
        score = inside_share(samples, cand, footprints, keys, ["nth", "nx", "ny"])
        by = F.struct(F.round("inside", 9).alias("i"), -(F.abs("nth") + F.hypot("nx", "ny")))
        best = score.groupBy(*keys).agg(F.max_by(F.struct("nth", "nx", "ny", "inside"), by).alias("m"))
        base, _ = materialise(base.join(best, list(keys)).select(*keys, "scale", "theta", "tx", "ty", "_cx", "_cy", F.col("m.nth").alias("dth"), F.col("m.nx").alias("dx"), F.col("m.ny").alias("dy"), F.col("m.inside").alias("inside")))
    t = F.radians("dth")
    px, py = F.col("tx") - F.col("_cx"), F.col("ty") - F.col("_cy")
    return base.select(*keys, "scale", (F.col("theta") + t).alias("theta"), (F.cos(t) * px - F.sin(t) * py + F.col("_cx") + F.col("dx")).alias("tx"),
                       (F.sin(t) * px + F.cos(t) * py + F.col("_cy") + F.col("dy")).alias("ty"), "inside")


def scale_candidates(raw: Column) -> Column:
    """Drawing scales that a title block could mean, best first.

    A plausible scale is a candidate where its digits stand after the word SCALE (anywhere, if the
    word is missing), letters that look like digits read as such. Scales met after
    a leading 1, the colon of 1:n being lost, come first, then longer numbers, then earlier ones.
    """
    block = F.upper(raw)
    after = F.substr(block, F.instr(block, "SCALE") + 5, F.lit(18))
    digits = F.regexp_replace(F.translate(F.when(F.contains(block, F.lit("SCALE")), after).otherwise(block), "OLI", "011"), "[^0-9]", "")
    behind_one = F.when(F.startswith(digits, F.lit("1")), F.substr(digits, F.lit(2))).otherwise(F.lit(""))

    def met(scale: int) -> Column:
        said = str(scale)
        place = lambda run, late: F.when(F.instr(run, said) > 0, F.struct(F.lit(late).alias("late"), F.lit(-len(said)).alias("short"), F.instr(run, said).alias("at"), F.lit(scale).alias("scale")))
        return F.coalesce(place(behind_one, 0), place(digits, 1))

    found = F.array_sort(F.array_compact(F.array(*[met(s) for s in PLAUSIBLE_SCALES])))
    return F.transform(found, lambda m: m["scale"])


def approximate_fit(plans: DataFrame, grid_angle: float, keys: Sequence[str]) -> DataFrame:
    """A placement for plans without a footprint, flagged approximate.

    ``plans``: ``keys, span, px, py, plan_angle, raw`` (title block text). The first
    stated scale giving a building of 12 to 220 m is taken, turned to the campus grid
    about the plan's centre.
    """
    ok = F.filter(scale_candidates(F.col("raw")), lambda r: (F.col("span") * r * POINT_M).between(12.0, 220.0))
    p = plans.withColumn("scale", F.get(ok, 0) * POINT_M).withColumn("theta", F.radians(geo.fold_angle(F.lit(grid_angle) - F.col("plan_angle"))))
    cs, sn = F.cos("theta"), F.sin("theta")
    return p.where("scale IS NOT NULL").select(*keys, "scale", "theta", (-F.col("scale") * (cs * F.col("px") - sn * F.col("py"))).alias("tx"),
                                               (-F.col("scale") * (sn * F.col("px") + cs * F.col("py"))).alias("ty"), F.lit(True).alias("approximate"))
