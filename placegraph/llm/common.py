"""Helpers shared by the corpus operators: tables, words, hashing and numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placegraph.session import discard, materialise

#: Texts turned into Python objects at once inside a task.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Short runs of rows as Python lists, so that one Arrow batch is never unpacked whole."""
    for batch in batches:
        picked = [batch.column(c) for c in columns]
        for at in range(0, batch.num_rows, SLICE):
            yield tuple(c.slice(at, SLICE).to_pylist() for c in picked)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF and CR, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound; forgetting costs time only."""

    BOUND = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter sequence is one run, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = mix(hashes[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return out


def rank_in_groups(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str) -> DataFrame:
    """0-based gapless position of each row within ``keys``, ordered by ``chunk``, then ``order``.

    Only one chunk of a group is ever windowed in a task: local positions are
    shifted by the sizes of the chunks before, so a group of any size is spread.
    Rows equal in ``order`` take any of their positions. Null keys form a group.
    """
    rows = df.withColumn("_chunk", chunk)
    part = [*keys, "_chunk"]
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)],
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    on = F.lit(True)
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_local", local).join(bases, on).select(
        *df.columns, (F.col("_local") + F.col("_base")).cast("bigint").alias(name))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the table of links ``a, b``: returns ``node, root``.

    Rounds of large-star and small-star joins; each round is one written table, and
    the table settles after about log(nodes) rounds. Nodes without links are absent.
    """
    state = {"rows": F.count(F.lit(1)), "mix": F.bit_xor(F.xxhash64("u", "v")), "back": F.bit_xor(F.xxhash64("v", "u"))}
    e, seen = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), **state)
    while seen["rows"]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hooked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, now = materialise(hooked.unionByName(low.withColumnRenamed("m", "v")).where("u > v").distinct(), **state)
        discard(e)
        settled, e, seen = now == seen, after, now
        if settled:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def smallest_reachable(own: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``cid, component`` of classes ``cid, rep``, given :func:`components` of their links: the smallest ``rep`` reachable."""
    if roots is None:
        return own.select("cid", F.col("rep").alias("component"))
    named = own.join(roots, own["cid"] == roots["node"]).select("cid", "rep", "root")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    return own.join(named.join(least, "root").select("cid", "component"), "cid", "left").select("cid", F.coalesce("component", "rep").alias("component"))
