"""Area outside a footprint: cases worked by hand, a fine grid, and floors that sampled points judge wrongly."""

import math
import random

import numpy as np
import pytest

from placegraph.functions.outside import area_outside
from placegraph.operators import quality


def rectangle(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def test_cases_by_hand():
    foot = [rectangle(0, 0, 10, 10)]
    assert area_outside(rectangle(2, 2, 5, 5), foot, 2.0) == pytest.approx((9, 0))
    assert area_outside(rectangle(20, 20, 25, 25), foot, 2.0) == pytest.approx((25, 25))
    assert area_outside(rectangle(5, 2, 20, 5), foot, 2.0) == pytest.approx((45, 24))
    assert area_outside(rectangle(5, 2, 20, 5), foot, 0.0) == pytest.approx((45, 30))
    assert area_outside(rectangle(10, 10, 14, 14), foot, 2.0) == pytest.approx((16, 16 - math.pi))
    assert area_outside(rectangle(-5, -5, 15, 15), foot, 2.0) == pytest.approx((400, 400 - 180 - 4 * math.pi))
    assert area_outside(rectangle(-5, 0, 25, 10), [*foot, rectangle(10, 0, 20, 10)], 2.0) == pytest.approx((300, 60))
    assert area_outside(rectangle(0, 0, 4, 4), [], 2.0) == pytest.approx((16, 16))
    assert area_outside(rectangle(0, 0, 0, 4), foot, 2.0)[0] == 0


def held(ring, x, y):
    a, b = ring, np.roll(ring, -1, 0)
    n = np.zeros(x.shape, int)
    for (ax, ay), (bx, by) in zip(a, b):
        if ay != by:
            n += ((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / (ay - by) + bx)
    return n % 2 == 1


def reach(ring, x, y):
    best = np.full(x.shape, np.inf)
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-300), 0, 1)
        best = np.minimum(best, np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
    return best


def star(rng, n, size, at):
    turn = np.sort([rng.random() * 2 * math.pi for _ in range(n)])
    r = np.array([size * (0.4 + 0.6 * rng.random()) for _ in range(n)])
    return np.stack([at[0] + r * np.cos(turn), at[1] + r * np.sin(turn)], 1)


def test_against_a_fine_grid():
    rng = random.Random(8)
    for _ in range(25):
        ring = star(rng, rng.randrange(3, 40), 10, (0, 0))
        parts = [star(rng, rng.randrange(3, 9), 9, (rng.uniform(-12, 12), rng.uniform(-12, 12))) for _ in range(rng.randrange(1, 4))]
        side = (np.arange(1000) + 0.5) / 50 - 10
        x, y = np.meshgrid(side, side)
        own = held(ring, x, y)
        x, y = x[own], y[own]
        out = np.ones(x.shape, bool)
        for p in parts:
            out &= ~held(p, x, y) & (reach(p, x, y) > 1.5)
        total, outside = area_outside(ring, parts, 1.5)
        assert total == pytest.approx(own.sum() / 2500, abs=0.15) and outside == pytest.approx(out.sum() / 2500, abs=0.15)


def test_floors_that_points_judge_wrongly(spark):
    """A rectangle with a tenth outside (its corners said 40 %), and a comb whose 200 teeth stick out."""
    k = math.degrees(1 / 6378137.0)
    teeth = [p for i in range(200) for p in ((i, 0), (i, 20), (i + 0.5, 20), (i + 0.5, 0))]
    comb = [(0, -20), *teeth, (200, 0), (200, -20)]
    shapes = [("A", "1", 0, [(10, 10), (10, 61), (50, 61), (50, 10)]), ("B", "1", 0, comb), ("C", "1", 0, [(0, 0), (9, 0), (9, 9)])]
    feet = [("A", [(0, 0), (100, 0), (100, 53.9), (0, 53.9)]), ("B", [(0, -30), (200, -30), (200, -2), (0, -2)])]
    degrees = lambda ring: [(x * k, y * k) for x, y in ring]
    point = "array<struct<x:double,y:double>>"
    s = spark.createDataFrame([(*r[:3], degrees(r[3])) for r in shapes], f"building string, floor string, ord long, ring {point}")
    f = spark.createDataFrame([(b, degrees([*r, r[0]])) for b, r in feet], f"building string, ring {point}")
    got = {r.building: r for r in quality.alignment_audit(s, f).collect()}
    assert got["A"].pct_area_outside == pytest.approx(10.0, abs=1e-3) and not got["A"].bad and got["A"].rooms_mostly_outside == 0
    assert got["B"].pct_area_outside == pytest.approx(100 * 2000 / 6000, abs=1e-3) and got["B"].bad and got["B"].polygons == 1
    assert not got["C"].measurable and not got["C"].bad
