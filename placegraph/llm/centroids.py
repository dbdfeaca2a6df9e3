"""Lloyd rounds on integer vectors, each vector finding its centroid in a vantage-point tree.

A node of the tree is one centroid; the others are split at the median of their
distance from it, and each half keeps the range of those distances. The tree is a few
kilobytes, built anew and sent out each round. Every vector keeps a queue of open
nodes with a lower bound on the distance to anything below them and always opens the
least; it stops only when that bound is larger than its best distance, so equal
distances are still met and the smaller number wins. Bounds are floating point with
the rounding given away; distances that decide are exact integers.

All vectors of a batch search at once: a step opens one node for each, grouped by node.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.session import discard, materialise

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Largest component whose squared distance to any other fits the fast path; larger ones are summed as Python integers.
FAST = 1 << 26
#: Components beyond this are not kept: their sums would leave 38 digits.
LIMIT = 1 << 62
#: Relative part of a bound given away to rounding.
SLACK = 1e-9


@dataclass
class Tree:
    """Vantage points by node; ``low`` and ``high`` bound the distance of each child's centroids from its parent's vantage point."""

    centroid: list[int]
    children: list[list[int]]
    low: list[float]
    high: list[float]
    vectors: list[list[int]]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def build(vectors: list[list[int]]) -> Tree:
    """A tree over all centroids; nodes are numbered in order of building, the root is 0."""
    tree = Tree([], [], [], [], vectors)

    def add(members: list[int], low: float, high: float) -> int:
        node, (point, *rest) = len(tree.centroid), members
        tree.centroid.append(point), tree.children.append([]), tree.low.append(low), tree.high.append(high)
        far = sorted((squared(vectors[point], vectors[m]), m) for m in rest)
        for half in (far[: (len(far) + 1) // 2], far[(len(far) + 1) // 2 :]):
            if half:
                tree.children[node].append(add([m for _, m in half], float(half[0][0]) ** 0.5, float(half[-1][0]) ** 0.5))
        return node

    if vectors:
        add(list(range(len(vectors))), 0.0, 0.0)
    return tree


def _distances(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Exact squared distances: 64-bit where they fit, else Python integers."""
    d = x - np.array(c, x.dtype)
    return np.einsum("ij,ij->i", d, d) if x.dtype == np.int64 else (d * d).sum(axis=1)


def search(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance and the number of nodes opened, for each row of ``x``."""
    n, nodes = len(x), len(tree.centroid)
    exact = max((abs(v) for c in tree.vectors for v in c), default=0) < FAST and x.dtype == np.int64
    if not exact:
        x = x.astype(object)
    none = -1
    best = np.full(n, none, np.int64)
    dist = np.zeros(n, np.int64 if exact else object)
    radius = np.full(n, np.inf)
    queue = np.full((n, nodes), np.inf)
    queue[:, 0] = 0.0
    opened = np.zeros(n, np.int64)
    active = np.arange(n)
    while len(active):
        node = queue[active].argmin(axis=1)
        bound = queue[active, node]
        going = (bound <= radius[active]) & (bound < np.inf)  # inclusive: an equal distance may have a smaller number
        active, node = active[going], node[going]
        for k in np.unique(node):
            rows = active[node == k]
            own = queue[rows, k]
            queue[rows, k] = np.inf
            opened[rows] += 1
            d = _distances(x[rows], tree.vectors[tree.centroid[k]])
            better = (best[rows] == none) | (d < dist[rows]) | ((d == dist[rows]) & (tree.centroid[k] < best[rows]))
            won = rows[better]
            best[won], dist[won] = tree.centroid[k], d[better]
            root = np.sqrt(d.astype(np.float64))
            radius[won] = root[better] * (1 + SLACK) + SLACK
            for child in tree.children[k]:
                gap = np.maximum(root * (1 - SLACK) - tree.high[child] * (1 + SLACK), tree.low[child] * (1 - SLACK) - root * (1 + SLACK)) - SLACK
                queue[rows, child] = np.maximum(np.maximum(gap, own), 0.0)
    return best, dist, opened


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, name, v``: kept vectors as ``floor(64 * x)`` and the hash that orders first centroids.

    Kept are vectors of exactly 64 components, none null, non-finite or beyond 2^62 after scaling.
    """
    x = F.col("x")
    inside = F.forall(x, lambda c: F.coalesce(c.between(-float(LIMIT) / SCALE, float(LIMIT) / SCALE) & ~F.isnan(c), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        (F.size(x) == DIM) & inside).select(
        "vec_id", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("name"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint")).alias("v"))


def _matrices(batches):
    for batch in batches:
        if batch.num_rows:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            big = np.abs(values).max(axis=1) >= FAST
            for rows in (~big, big):
                if rows.any():
                    x = values[rows]
                    yield batch.filter(pa.array(rows)), x if rows is not big else x.astype(object)


def cluster_sums(kept: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact component sums of each centroid's cluster: one row a task and cluster reaches the shuffle, one a cluster the driver."""
    tree = kept.sparkSession.sparkContext.broadcast(build(centroids))

    def run(batches):
        n, sums = [0] * len(tree.value.centroid), [[0] * DIM for _ in tree.value.centroid]
        for _, x in _matrices(batches):
            best, _, _ = search(tree.value, x)
            for k in np.unique(best).tolist():
                rows = x[best == k]
                n[k] += len(rows)
                for j, s in enumerate(rows.sum(axis=0).tolist()):
                    sums[k][j] += s
        some = [k for k, m in enumerate(n) if m]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[k] for k in some], pa.int64()),
                                          pa.array([[str(s) for s in sums[k]] for k in some], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = kept.select("v").mapInArrow(run, "cluster int, n bigint, sums array<string>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(DIM)]).alias("sums"))
    return {r["cluster"]: (r["n"], [int(s) for s in r["sums"]]) for r in whole.collect()}


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance, opened`` of every kept vector; a distance beyond 64 bits is null."""
    tree = kept.sparkSession.sparkContext.broadcast(build(centroids))

    def run(batches):
        for batch, x in _matrices(batches):
            best, dist, opened = search(tree.value, x)
            told = [int(d) if d < 1 << 63 else None for d in dist.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(told, pa.int64()), pa.array(opened, pa.int32())],
                                             ["vec_id", "cluster", "distance", "opened"])

    return kept.select("vec_id", "v").mapInArrow(run, "vec_id bigint, cluster int, distance bigint, opened int")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, opened`` of every kept vector of ``vec_id, embedding``.

    Fewer vectors than clusters make fewer clusters; none make no rows. A null id is the
    empty text in the hash that picks first centroids; equal hashes (repeated ids) are
    taken in the order of their vectors. Repeated rows count as vectors of their own.
    Distances and inertias that leave 64 bits are null. ``opened`` tells how many nodes
    the search visited. Other columns are ignored.
    """
    kept, seen = materialise(integer_vectors(vectors))
    first = kept.orderBy("name", "v").limit(clusters).collect()  # at most ``clusters`` rows
    centroids = [list(r["v"]) for r in first]
    for _ in range(rounds if seen["rows"] else 0):
        for k, (n, sums) in cluster_sums(kept, centroids).items():
            centroids[k] = [s // n for s in sums]
    assigned, _ = materialise(assign(kept, centroids))
    discard(kept)
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("m"))
    sums = {r["cluster"]: int(r["s"]) if r["n"] == r["m"] else None for r in per.collect()}  # at most ``clusters`` rows
    long = lambda s: s if s is not None and s < 1 << 63 else None
    total = long(sum(sums.values()) if None not in sums.values() else None)
    rows = [(k, long(s), total, sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, s in sums.items()]
    told = kept.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "opened")


def _sql() -> str:
    nearest = """SELECT i, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (
  SELECT v.i, c.k, CAST(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS BIGINT) AS d FROM v, {c} c) GROUP BY i"""
    rounds, at = [], "c0"
    for r in range(ROUNDS):
        rounds.append(f"""a{r} AS ({nearest.format(c=at)}),
s{r} AS (SELECT k, list(CAST(floor_div AS BIGINT) ORDER BY j) AS v FROM (
  SELECT k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM (SELECT a.k, j, v.v[j] AS x FROM a{r} a JOIN v USING (i), range(1, 65) r(j)) GROUP BY k, j) GROUP BY k),
c{r + 1} AS (SELECT c.k, coalesce(s.v, c.v) AS v FROM {at} c LEFT JOIN s{r} s ON s.k = c.k)""")
        at = f"c{r + 1}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER () AS i, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{(',' + chr(10)).join(rounds).replace(' AS (', ' AS MATERIALIZED (')},
z AS MATERIALIZED ({nearest.format(c=at)})
SELECT v.vec_id, CAST(z.k AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN v USING (i) JOIN {at} c ON c.k = z.k
"""


#: The same in SQL, every vector against every centroid.
SQL = _sql()
