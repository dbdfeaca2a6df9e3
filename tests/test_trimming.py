"""Exact polygon differences and the trimming of overlapping shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placegraph.functions import clip, geo
from placegraph.operators.trimming import trim_overlaps


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def star(rng, cx, cy, r, n):
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def area(parts):
    return sum(abs(clip.signed_area(r)) * (1 if i == 0 else -1) for p in parts for i, r in enumerate(p))


def test_areas_add_up_exactly():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (clip.exact(star(rng, rng.uniform(-4, 4), rng.uniform(-4, 4), 9, rng.randrange(3, 14))) for _ in "ab")
        if not (clip.is_simple(a) and clip.is_simple(b)):
            continue
        ab, ba = clip.difference([a], b), clip.difference([b], a)
        assert abs(clip.signed_area(a)) - area(ab) == abs(clip.signed_area(b)) - area(ba)  # the common part, from both sides
        for part in ab:
            again = clip.difference(part, b)
            assert area(again) == area([part])  # nothing of it is left under the cutter


@pytest.mark.parametrize("cutter, parts", [
    (box(2, 2, 4, 4), [(96, 1)]), (box(-1, 2, 11, 4), [(20, 0), (60, 0)]), (box(0, 0, 4, 10), [(60, 0)]), (box(0, 0, 10, 10), []), (box(20, 0, 30, 10), [(100, 0)]),
    (box(10, 0, 20, 10), [(100, 0)]), (box(0, 0, 5, 5), [(75, 0)]), (box(5, 5, 15, 15), [(75, 0)]), (box(-5, -5, 15, 15), [])])
def test_boxes(cutter, parts):
    got = clip.difference([clip.exact(box(0, 0, 10, 10))], clip.exact(cutter))
    assert sorted((area([p]), len(p) - 1) for p in got) == parts


def test_parts_that_meet_at_a_corner_are_two():
    left = clip.difference([clip.exact(box(0, 0, 2, 2))], clip.exact(box(0, 0, 1, 1)))
    assert [area([p]) for p in clip.difference(left[0], clip.exact(box(1, 1, 2, 2)))] == [1, 1]
    assert not clip.is_simple(clip.exact([(0, 0), (2, 2), (2, 0), (0, 2)])) and not clip.is_simple(clip.exact([(0, 0), (1, 1), (2, 2)]))
    assert clip.exact([(0, 0), (float("nan"), 1), (2, 2)]) == []


def sheet(spark, rings):
    rows = [("B1", "2", i, [{"x": float(x), "y": float(y)} for x, y in r] if r is not None else None, "kept") for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "building string, floor string, ord long, ring array<struct<x:double,y:double>>, cuts string").drop("cuts").withColumn("room", F.lit("r"))


def cut(df):
    out = trim_overlaps(df).withColumn("a", geo.area("ring")).withColumn("h", F.aggregate("holes", F.lit(0.0), lambda s, r: s + geo.area(r)))
    return {r.ord: ((r.a or 0.0) - r.h, len(r.holes), r.cuts) for r in out.collect()}


def test_larger_shapes_give_way(spark):
    got = cut(sheet(spark, [
        box(0, 0, 10, 10), box(8, 0, 12, 5),        # a corner is cut
        box(20, 0, 30, 10), box(18, 4, 32, 6),      # would be split: refused
        box(40, 0, 50, 10), box(40, 0, 49, 9),      # would leave under half: refused
        box(60, 0, 70, 10), box(63, 3, 66, 6),      # a hole
        box(80, 0, 90, 10), box(85, 0, 95, 10),     # one size: neither
        box(100, 0, 110, 10), box(100, 0, 103, 10), box(107, 0, 110, 9),  # two cuts
        box(120, 0, 130, 10), box(129.9, 0, 139, 10),  # under two percent of the smaller
        [(140, 0), (150, 10), (150, 0), (140, 10), (140, 0)], box(144, 0, 146, 3),  # an outline that crosses itself
        None, [], box(160, 0, 160, 5)]))
    assert got[0] == (90, 0, 1) and got[1] == (20, 0, 0) and got[2] == (100, 0, 0) and got[4] == (100, 0, 0) and got[6] == (91, 1, 1)
    assert got[8] == got[9] == (100, 0, 0) and got[10] == (43, 0, 2)
    assert got[13] == (100, 0, 0) and got[14] == (pytest.approx(91), 0, 0) and got[15][2] == 0 and len(got) == 20


def test_refusal_measures_what_is_left_at_that_moment(spark):
    # 100 -> 70 after the first cut; the second would take 27 of 70 and leave more than half of them.
    got = cut(sheet(spark, [box(0, 0, 10, 10), box(0, 0, 3, 10), box(7, 0, 10, 9)]))
    assert got[0] == (43, 0, 2)
    got = cut(sheet(spark, [box(0, 0, 10, 10), box(0, 0, 4.5, 10), box(6, 0, 10, 9)]))
    assert got[0] == (55, 0, 1)


def test_many_shapes_match_one_by_one_cuts(spark):
    rng = random.Random(5)
    rings = [star(rng, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 9), rng.randrange(4, 11)) for _ in range(150)]
    exact = [clip.exact(r) for r in rings]
    size = [abs(float(clip.signed_area(r))) for r in exact]
    want = {}
    for i, a in enumerate(exact):
        shape, n = [a], 0
        if not clip.is_simple(a):
            want[i] = (size[i], 0)
            continue
        for k in sorted((k for k in range(len(rings)) if k != i and size[k] < size[i]), key=lambda k: (-size[k], k)):
            if not clip.is_simple(exact[k]):
                continue
            common = size[k] - float(area(clip.difference([exact[k]], a)))
            if common / size[k] < 0.02 or size[k] >= float(area([shape])):
                continue
            parts = clip.difference(shape, exact[k])
            if len(parts) == 1 and area(parts) >= 0.5 * float(area([shape])):
                shape, n = parts[0], n + 1
        want[i] = (float(area([shape])), n)
    got = cut(sheet(spark, rings))
    assert {i: n for i, (_, _, n) in got.items()} == {i: n for i, (_, n) in want.items()}
    for i, (a, _, _) in got.items():
        assert a == pytest.approx(want[i][0], rel=1e-9)
    assert sum(n for _, n in want.values()) > 20
