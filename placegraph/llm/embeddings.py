"""Near-duplicate vectors by binary codes of randomly rotated vectors.

A vector's code is the sign pattern of its random rotation; kept beside it is the
inner product of vector and code, the correction that makes ``<code, q> / <code, v>``
an unbiased estimate of ``<v, q>`` with a known error bound. Pairs whose bound stays
below the threshold are dropped on the estimate; all others are recomputed exactly in
double precision.

Vectors meet in cells: further rotations, each naming the axis a vector lies closest
to. A pair at the threshold shares a cell of some table but for the chance ``MISS``;
tables and axes per cell follow from the number of vectors. Cells of any size are
compared block against block, each block pair a group of its own. A pair counts in
the first table that it shares. Only counts and one link per vector leave a task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import components, mix, smallest_reachable
from placegraph.session import materialise

THRESHOLD = 0.9
#: Chance that a pair right at the threshold shares no cell.
MISS = 1e-6
#: Standard deviations that the estimate may be off before a pair is dropped.
SIGMAS = 5.5
#: Vectors per cell that one more axis would bring down.
CROWD = 2048
BLOCK = 2048


def width_of(dim: int) -> int:
    """Rotated width: the next power of two, 64 at least."""
    return 1 << max(6, (dim - 1).bit_length())


@lru_cache(maxsize=512)
def _signs(width: int, index: int) -> np.ndarray:
    return np.random.default_rng((20240, width, index)).choice(np.array([-1.0, 1.0], np.float32), (3, width))


def rotate(x: np.ndarray, index: int) -> np.ndarray:
    """Pseudo-random rotation number ``index``: three rounds of random signs and Hadamard transform."""
    width = width_of(x.shape[1])
    out = np.zeros((len(x), width), np.float32)
    out[:, : x.shape[1]] = x
    for signs in _signs(width, index):
        out *= signs
        h = 1
        while h < width:
            v = out.reshape(len(x), -1, 2, h)
            out = np.concatenate((v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]), axis=2).reshape(len(x), width)
            h *= 2
        out /= np.float32(math.sqrt(width))
    return out


def nearest_axis(x: np.ndarray) -> np.ndarray:
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] > 0)


@lru_cache(maxsize=64)
def agreement(width: int, threshold: float) -> float:
    """Chance that two vectors at the threshold are closest to the same axis, by simulation."""
    rng = np.random.default_rng(1)
    n = 4000 if width <= 256 else 1000
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=(n, width))
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * e
    p = float((nearest_axis(x) == nearest_axis(y)).mean())
    return p - 2 * math.sqrt(p * (1 - p) / n)


def layout(n: int, width: int, threshold: float) -> tuple[int, int]:
    """Axes per cell and number of tables for ``n`` vectors."""
    axes = 1
    while n / (2 * width) ** axes > CROWD:
        axes += 1
    p = agreement(width, threshold) ** axes
    return axes, math.ceil(math.log(MISS) / math.log(1 - p))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (packed) and correction factors ``<code, v>`` of unit vectors."""
    r = rotate(x, 0)
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / np.float32(math.sqrt(r.shape[1]))


def _unit(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision and their norms."""
    x = np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8").astype(np.float64) for b in raw])
    return x, np.sqrt((x * x).sum(axis=1))


def _parse(vectors: DataFrame) -> DataFrame:
    """``vec_id, cid, dim, raw``: null ``cid`` for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            ids, vecs = batch.column("vec_id"), batch.column("v")
            cid, dim, raw = [], [], []
            for i in range(batch.num_rows):
                v = np.asarray(vecs[i].values.to_numpy(zero_copy_only=False), np.float64) if vecs[i].is_valid and len(vecs[i]) else np.zeros(0)
                top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
                if top == 0.0 or not ids[i].is_valid:
                    cid.append(None), dim.append(None), raw.append(None)
                    continue
                if not 1e-100 < top < 1e100:
                    v = v / top
                with np.errstate(over="ignore"):
                    short = v.astype("<f4")
                b = short.tobytes() if (short == v).all() else v.astype("<f8").tobytes()
                cid.append(xxhash.xxh3_64_intdigest(b, len(v)) - (1 << 63)), dim.append(len(v)), raw.append(b)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cid, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "cid", "dim", "raw"])

    return vectors.mapInArrow(run, "vec_id bigint, cid bigint, dim int, raw binary")


def _with_codes(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds code, correction factor and the cell of each table."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, norm = _unit(part.column("raw").to_pylist(), int(dim))
                unit = x / norm[:, None]
                axes, tables = plans[int(dim)]
                cells = np.zeros((len(x), tables), np.uint64)
                for t in range(tables):
                    for a in range(axes):
                        cells[:, t] = cells[:, t] * np.uint64(2 * width_of(int(dim))) + nearest_axis(rotate(unit, 1 + t * axes + a)).astype(np.uint64)
                    cells[:, t] = mix(cells[:, t] * np.uint64(1 << 20) + np.uint64(int(dim)))
                code, factor = codes(unit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("weight"), part.column("dim"), part.column("raw"), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(factor.astype(np.float32)), pa.array(list(cells.view(np.int64)), pa.list_(pa.int64()))],
                    ["cid", "weight", "dim", "raw", "code", "factor", "cells"])

    return classes.select("cid", "weight", "dim", "raw").mapInArrow(run, "cid bigint, weight bigint, dim int, raw binary, code binary, factor float, cells array<bigint>")


def candidates(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, rows: np.ndarray, cols: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` and ``cols`` whose confidence bound reaches the threshold."""
    query = rotate(unit[rows], 0)
    width = query.shape[1]
    signs = (np.unpackbits(code[cols], axis=1)[:, :width].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(width))
    error = np.sqrt(np.maximum(1 - factor[cols] ** 2, 0)) / factor[cols] / math.sqrt(width - 1)
    least = threshold - SIGMAS * error * math.sqrt(1 - threshold**2) - 1e-4
    est = query @ (signs / factor[cols][:, None]).T
    i, j = np.nonzero(est >= least[None, :])
    return rows[i], cols[j]


def _links(coded: DataFrame, threshold: float) -> DataFrame:
    """``cid, links, root``: from each block pair, weights linked in it first and the smallest class they reach there."""
    rows = coded.select("cid", F.posexplode("cells").alias("tab", "cell"))
    sizes = rows.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "tab", "cell", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["tab", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = dealt.select("cid", "tab", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(coded, "cid")

    def compare(pdf):
        import pandas as pd

        x, norm = _unit(list(pdf["raw"]), int(pdf["dim"].iloc[0]))
        unit = (x / norm[:, None]).astype(np.float32)
        code = np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]])
        factor, weight, cid, own = (pdf[c].to_numpy() for c in ("factor", "weight", "cid", "own"))
        cells, tab, bi, bj = np.stack(pdf["cells"]), int(pdf["tab"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        a, b = [], []
        for at in range(0, len(left), 256):
            i, j = candidates(unit, code, factor, left[at : at + 256], right, threshold)
            if bi == bj:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 20_000):
                p, q = i[k : k + 20_000], j[k : k + 20_000]
                near = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
                a.append(p[near]), b.append(q[near])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        first = np.concatenate([(cells[a[k : k + 20_000]] == cells[b[k : k + 20_000]]).argmax(axis=1) for k in range(0, len(a), 20_000)]) == tab if len(a) else np.zeros(0, bool)
        links = np.bincount(a[first], weight[b[first]], len(pdf)) + np.bincount(b[first], weight[a[first]], len(pdf))
        order = np.argsort(cid)
        label = np.empty(len(pdf), np.int64)
        label[order] = np.arange(len(pdf))
        rank = label.copy()
        while len(a):
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = np.minimum(label, label[order[label]])
            if (label == before).all():
                break
        some = np.flatnonzero((links > 0) | (label != rank))
        return pd.DataFrame({"cid": cid[some], "links": links[some].astype(np.int64), "root": cid[order[label[some]]]})

    return task.groupBy("tab", "cell", "i", "j").applyInPandas(compare, "cid bigint, links bigint, root bigint")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Vectors link at a cosine of ``threshold`` or more. Null, empty and zero vectors and
    those with a null or non-finite component link with nothing, as do vectors of
    different lengths; so does a null id, whose component is null. Equal vectors are
    one class with a weight and all linked. Repeated rows count as vectors of their
    own. ``component_id`` is the smallest id reachable, and that vector is kept.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    parsed, _ = materialise(_parse(rows))
    classes, _ = materialise(parsed.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("dim").alias("dim"), F.min("raw").alias("raw")))
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per vector length
    own, counted, roots = classes.select("cid", "rep"), None, None
    if sum(counts.values()) > 1:
        coded, _ = materialise(_with_codes(classes, {d: layout(n, width_of(d), threshold) for d, n in counts.items()}))
        found, seen = materialise(_links(coded, threshold))
        if seen["rows"]:
            counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
            roots, _ = materialise(components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))))
    named = smallest_reachable(own, roots).join(classes.select("cid", "weight"), "cid")
    if counted is not None:
        named = named.join(counted, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    else:
        named = named.withColumn("links", F.lit(0))
    named = named.select("cid", "component", (F.col("links") + F.col("weight") - 1).cast("bigint").alias("links"))
    out = parsed.select("vec_id", "cid").join(named, "cid", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same in SQL, every vector with every other.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1) c LEFT JOIN n ON n.a = c.vec_id
"""
