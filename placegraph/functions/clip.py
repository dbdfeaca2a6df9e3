"""Exact difference of two polygons: what :func:`placegraph.operators.trimming.trim_overlaps` cuts with.

All decisions are made on rational numbers, so shared corners and shared walls need no tolerance.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

Point = tuple[Fraction, Fraction]
Ring = list[Point]


def exact(ring) -> Ring:
    """Corners as rationals without the closing and other repeated ones; empty if a coordinate is not finite."""
    try:
        pts = [(Fraction(x), Fraction(y)) for x, y in ring]
    except (ValueError, OverflowError):
        return []
    return [p for k, p in enumerate(pts) if p != pts[k - 1]]


def signed_area(ring: Ring) -> Fraction:
    return sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])), Fraction(0)) / 2


def _edges(ring: Ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def _cross(o: Point, a: Point, b: Point) -> Fraction:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _meets(p: Point, q: Point, r: Point, s: Point) -> list[Point]:
    """Points that two edges have in common: none, one, or the ends of a common stretch."""
    if max(p[0], q[0]) < min(r[0], s[0]) or max(r[0], s[0]) < min(p[0], q[0]) or max(p[1], q[1]) < min(r[1], s[1]) or max(r[1], s[1]) < min(p[1], q[1]):
        return []
    d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
    if d:
        t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
        u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
        return [(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if _cross(p, q, r):
        return []
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    return [c for c in (r, s) if on(p, q, c)] + [c for c in (p, q) if on(r, s, c)]


def is_simple(ring: Ring) -> bool:
    """Whether a ring has an area and no edge meets another but at their common corner."""
    e = _edges(ring)
    for i, (p, q) in enumerate(e):
        for j in range(i):
            r, s = e[j]
            common = {c for c in (p, q) if c in (r, s)}
            if set(_meets(p, q, r, s)) - common or (common and j not in (i - 1, (i + 1) % len(e))):
                return False
    return len(ring) > 2 and signed_area(ring) != 0


def _inside(rings: list[Ring], x: Fraction, y: Fraction) -> bool:
    """Even-odd; the point is on no edge."""
    held = False
    for ring in rings:
        for a, b in _edges(ring):
            if (a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]):
                held = not held
    return held


def _pieces(edges, others):
    """Edges of one side cut at every point they share with the other."""
    for p, q in edges:
        at = {p, q}
        for r, s in others:
            at.update(_meets(p, q, r, s))
        far = sorted(at, key=lambda c: (c[0] - p[0]) * (q[0] - p[0]) + (c[1] - p[1]) * (q[1] - p[1]))
        yield from zip(far, far[1:])


def difference(rings: list[Ring], cutter: Ring) -> list[list[Ring]]:
    """Parts of a polygon (outline, then holes) that lie outside a simple ring: outline and holes of each.

    Parts that meet at a corner only are parts of their own.
    """
    left = lambda ring, sign: ring if signed_area(ring) * sign > 0 else ring[::-1]
    rings = [left(r, -1 if k else 1) for k, r in enumerate(rings)]  # what is kept lies on the left of every edge
    cutter = left(cutter, 1)
    own, other = [e for r in rings for e in _edges(r)], _edges(cutter)
    a, b = set(_pieces(own, other)), set(_pieces(other, own))
    half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    kept = [(p, q) for p, q in a if (q, p) in b or ((p, q) not in b and not _inside([cutter], *half(p, q)))]
    kept += [(q, p) for p, q in b if (p, q) not in a and (q, p) not in a and _inside(rings, *half(p, q))]
    ways = defaultdict(list)
    for p, q in kept:
        ways[p].append(q)
    found = []
    while ways:
        start = at = min(ways)
        ring, came = [], None
        while True:
            choices = ways[at]
            nxt = choices[0] if len(choices) == 1 or came is None else min(choices, key=_turn(came, at))
            choices.remove(nxt)
            if not choices:
                del ways[at]
            ring.append(at)
            came, at = at, nxt
            if at == start:
                break
        found.append(_straight(ring))
    outlines = [r for r in found if signed_area(r) > 0]
    holes = [r for r in found if signed_area(r) < 0]
    return [[o, *(h for h in holes if len(outlines) == 1 or _inside([o], *_within(h)))] for o in outlines]


def _turn(came: Point, at: Point):
    """Sorts ways on from a corner, sharpest left first."""
    back = (came[0] - at[0], came[1] - at[1])

    def key(nxt: Point):
        d = (nxt[0] - at[0], nxt[1] - at[1])
        cross, dot = back[0] * d[1] - back[1] * d[0], back[0] * d[0] + back[1] * d[1]
        # Clockwise from the way back: first the half turn on its right, nearest direction first.
        return (0, -_slope(dot, cross)) if cross < 0 or (cross == 0 and dot < 0) else (1, -_slope(dot, cross))

    return key


def _slope(dot: Fraction, cross: Fraction) -> Fraction:
    """Grows as the direction nears that of the way back within a half turn: dot over the sum of both sizes."""
    if cross >= 0:
        dot = -dot
    return dot / (abs(dot) + abs(cross))


def _within(ring: Ring) -> Point:
    """The middle of a ring's first edge."""
    return (ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2


def _straight(ring: Ring) -> Ring:
    """Without corners on a straight line."""
    return [q for p, q, r in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if _cross(p, q, r)]
