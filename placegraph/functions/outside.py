"""Area of a shape outside others widened by a slack, exact: straight edges and round corners in closed form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _line_meets(a: np.ndarray) -> np.ndarray:
    """x of every crossing between segments ``ax, ay, bx, by``."""
    d = a[:, 2:] - a[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = a[None, :, :2] - a[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / cross
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / cross
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (a[:, None, 0] + t * d[:, None, 0])[hit]


def _arc_meets(a: np.ndarray, c: np.ndarray, r: float) -> np.ndarray:
    """x of every crossing of the circles of radius ``r`` about ``c`` with segments and with each other."""
    d = a[:, 2:] - a[:, :2]
    f = a[:, None, :2] - c[None, :, :]
    p, q, s = (d * d).sum(1)[:, None], (f * d[:, None, :]).sum(2), (f * f).sum(2) - r * r
    root = q * q - p * s
    at = np.sqrt(np.maximum(root, 0.0))
    t = np.stack([(-q - at) / p, (-q + at) / p])
    x = (a[None, :, None, 0] + t * d[None, :, None, 0])[(root >= 0) & (t >= 0) & (t <= 1)]
    i, j = np.triu_indices(len(c), 1)
    v = c[j] - c[i]
    dist = np.hypot(v[:, 0], v[:, 1])
    near = (dist > 0) & (dist < 2 * r)
    v, dist, mid = v[near], dist[near], (c[i] + c[j])[near, 0] / 2
    h = np.sqrt(r * r - dist * dist / 4) * v[:, 1] / dist
    return np.concatenate([x, mid - h, mid + h])


def _segments(ring: np.ndarray) -> np.ndarray:
    """Edges of a ring, closed whether or not the last point repeats the first; none of length 0."""
    e = np.hstack([ring, np.roll(ring, -1, 0)])
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def area_outside(ring: np.ndarray, parts: Sequence[np.ndarray], slack: float) -> tuple[float, float]:
    """Area of a ring, and of what lies farther than ``slack`` from every part.

    Insides are even-odd. The plane is cut into upright slabs at every corner and
    crossing; within one the order of all edges and arcs is fixed, so the area
    between two neighbours is the difference of their integrals.
    """
    o = ring[0]
    ring = ring - o
    own = _segments(ring)
    if len(own) < 3 or not np.isfinite(own).all():
        return 0.0, 0.0
    lo, hi = ring.min(0), ring.max(0)
    lines, of, discs = [own], [np.zeros(len(own), int)], []
    n = 1
    for part in parts:
        part = part - o
        if not len(part) or not ((part.min(0) - slack <= hi) & (part.max(0) + slack >= lo)).all():
            continue
        e = _segments(part)
        lines.append(e)
        of.append(np.full(len(e), n))
        n += 1
        if slack <= 0:
            continue
        d = e[:, 2:] - e[:, :2]
        side = slack * np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None]
        for a, b, s in zip(e[:, :2], e[:, 2:], side):
            box = np.stack([a + s, b + s, b - s, a - s])
            if ((box.min(0) <= hi) & (box.max(0) >= lo)).all():
                lines.append(_segments(box))
                of.append(np.full(len(lines[-1]), n))
                n += 1
            if ((a - slack <= hi) & (a + slack >= lo)).all():
                discs.append(a)
    a, of = np.concatenate(lines), np.concatenate(of)
    c = np.array(discs).reshape(-1, 2)
    cuts = [a[:, 0], a[:, 2], _line_meets(a)]
    if len(c):
        c = np.unique(c, axis=0)
        cuts += [c[:, 0] - slack, c[:, 0] + slack, _arc_meets(a, c, slack)]
    x = np.unique(np.clip(np.concatenate(cuts), lo[0], hi[0]))
    upright = a[:, 0] == a[:, 2]
    a, of = a[~upright], of[~upright]
    left, right, mid = x[:-1, None], x[1:, None], (x[:-1, None] + x[1:, None]) / 2
    slope = (a[:, 3] - a[:, 1]) / (a[:, 2] - a[:, 0])
    height = a[:, 1] + slope * (mid - a[:, 0])
    on = (np.minimum(a[:, 0], a[:, 2]) < mid) & (mid < np.maximum(a[:, 0], a[:, 2]))
    under = height * (right - left)
    if len(c):
        u = np.clip(mid - c[:, 0], -slack, slack)
        rise = np.sqrt(slack * slack - u * u)
        whole = lambda v: (v * np.sqrt(slack * slack - v * v) + slack * slack * np.arcsin(v / slack)) / 2
        arc = whole(np.clip(right - c[:, 0], -slack, slack)) - whole(np.clip(left - c[:, 0], -slack, slack))
        flat, seen = c[:, 1] * (right - left), np.abs(mid - c[:, 0]) < slack
        height = np.hstack([height, c[:, 1] - rise, c[:, 1] + rise])
        under = np.hstack([under, flat - arc, flat + arc])
        on = np.hstack([on, seen, seen])
        of = np.concatenate([of, n + np.arange(len(c)), n + np.arange(len(c))])
        n += len(c)
    total = out = 0.0
    step = max(1, 4_000_000 // (len(of) * n))  # slabs at a time, so that marks stay within a few MB
    for i in range(0, len(height), step):
        h = np.where(on[i : i + step], height[i : i + step], np.inf)
        order = np.argsort(h, 1, kind="stable")
        marks = (of[order][..., None] == np.arange(n)) & np.isfinite(np.take_along_axis(h, order, 1))[..., None]
        held = np.logical_xor.accumulate(marks, 1)
        inside, met = held[:, :-1, 0], held[:, :-1, 1:].any(2)
        between = np.diff(np.take_along_axis(under[i : i + step], order, 1), axis=1)
        total += between[inside].sum()
        out += between[inside & ~met].sum()
    return float(total), float(min(max(out, 0.0), total))
