"""Nearest targets by tiles against plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placegraph.operators import pyramid, quality, spatial


def sphere_m(a, b, radius=6371000.0):
    (ax, ay), (bx, by) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((by - ay) / 2) ** 2 + math.cos(ay) * math.cos(by) * math.sin((bx - ax) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


@pytest.mark.parametrize("reach", [None, 400_000.0])
def test_nearest_anywhere_on_the_globe(spark, reach):
    rng = random.Random(4)
    targets = [(i, f"t{i}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(150)]
    targets += [(200 + i, f"t{200 + i}", 179.9995 + i / 10_000 - 360 * (i > 4), 10.0) for i in range(9)] + [(300, "t300", 5.0, 90.0), (301, "a", 7.0, 50.0), (299, "b", 7.0, 50.0)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(120)] + [(200, 7.0, 50.0), (201, -179.9999, 10.0), (202, 0.0, -90.0), (203, None, 1.0), (204, float("nan"), 1.0)]
    got = {r.q: (r.nid, r.metres) for r in spatial.nearest(
        spark.createDataFrame(points, "q long, lng double, lat double"), spark.createDataFrame(targets, "ord long, nid string, lng double, lat double"), "q", "nid", "ord", reach_m=reach).collect()}
    want = {}
    for q, x, y in points[:-2]:
        d, _, n = min((sphere_m((x, y), (tx, ty)), o, n) for o, n, tx, ty in targets)
        if reach is None or d <= reach:
            want[q] = (n, d)
    assert {q: n for q, (n, _) in got.items()} == {q: n for q, (n, _) in want.items()}
    assert all(abs(got[q][1] - d) < 1e-3 for q, (_, d) in want.items())


def test_far_points_read_few_tiles(spark):
    """Ten thousand targets around one spot, points a thousand kilometres away."""
    rng = random.Random(5)
    targets = spark.createDataFrame([(i, rng.gauss(0, 0.02), 49 + rng.gauss(0, 0.02)) for i in range(10_000)], "o long, tx double, ty double")
    points = spark.createDataFrame([(i, 14.0 + i, 50.0) for i in range(20)], "q long, px double, py double")
    report = []
    far = pyramid.nearest_by_tiles(points, targets, "q", pyramid.on_sphere("px", "py"), pyramid.on_sphere("tx", "ty"), F.hypot(F.col("px") - F.col("tx"), F.col("py") - F.col("ty")),
                                   ["o"], leaf=1.6e-5, report=report)
    assert far.count() == 20 and max(report) <= 20 * 24  # at most two dozen tiles a point and level, of thousands


def test_owners_of_many_items_by_tiles(spark):
    rng = random.Random(6)
    items = [(rng.choice("ab"), i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)] + [("c", 900, 1.0, 1.0)]
    owners = [(rng.choice("ab"), i, float(rng.randrange(0, 100, 5)), float(rng.randrange(0, 100, 5))) for i in range(300)]
    got = {r.ord: r.owner for r in quality.nearest_owner(spark.createDataFrame(items, "g string, ord long, x double, y double"),
                                                         spark.createDataFrame(owners, "g string, owner long, ox double, oy double"), ["g"]).collect()}
    want = {i: min(((x - ox) ** 2 + (y - oy) ** 2, o) for h, o, ox, oy in owners if h == g)[1] for g, i, x, y in items if g != "c"}
    assert got == want
    none = spark.createDataFrame([], "g string, owner long, ox double, oy double")
    assert quality.nearest_owner(spark.createDataFrame(items, "g string, ord long, x double, y double"), none, ["g"]).count() == 0
