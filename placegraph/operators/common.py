"""Keyed selection and ordered numbering that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from placegraph.session import materialise

#: Width of the pieces of a sequence that are windowed in one task.
CHUNK = 65_536
#: Most rows of a growing table that a join may send whole to every task. Sizes of files do not tell them: a cell is a bit of a file and 150 bytes of memory.
SENT = 100_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """First row per key in the given order.

    An aggregate rather than a window: partial results shrink every key to one
    row per task before the shuffle.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in keep]).alias("_row"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b._row.{c}").alias(c) for c in keep])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key. The rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def running(df: DataFrame, keys: Sequence[str], seq: str, sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, tie: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Running sums and last non-null values over (keys, order by seq), inclusive.

    ``seq`` is an integer. Rows are windowed in chunks of the sequence (``chunk``,
    by default ``CHUNK`` wide), so a key of any size is spread over tasks; only one
    summary row per chunk meets in the second step. Equal ``seq`` values fall in one chunk.
    """
    sums, lasts, chunk = sums or {}, lasts or {}, chunk or CHUNK
    keyed = df.withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk)))
    for n, c in {**sums, **lasts}.items():
        keyed = keyed.withColumn(f"_v_{n}", c)
    part = [*keys, "_chunk"]
    local = Window.partitionBy(*part).orderBy(seq, *tie).rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct(F.col(seq), *[F.col(t) for t in tie])
    summary = keyed.groupBy(*part).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_t_{n}") for n in lasts])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for n in sums:
        summary = summary.withColumn(f"_t_{n}", F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)))
    for n in lasts:
        summary = summary.withColumn(f"_t_{n}", F.last(f"_t_{n}", ignorenulls=True).over(before))
    for n in sums:
        keyed = keyed.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(local))
    for n in lasts:
        keyed = keyed.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(local))
    summary = summary.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], *[f"_t_{n}" for n in {**sums, **lasts}])
    cond = F.lit(True)
    for i, c in enumerate(part):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = keyed.join(summary, cond)
    return out.select(*df.columns, *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_t_{n}")).alias(n) for n in sums],
                      *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_t_{n}")).alias(n) for n in lasts])


def apart(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join whose smaller side has up to ``rows`` rows: above ``SENT`` both are sorted, and neither passes through the driver."""
    return df.hint("merge") if rows > SENT else df


def number_rows(df: DataFrame, keys: Sequence[str], seq: str, name: str = "n", tie: Sequence[str] = (),
                chunk: int | None = None) -> DataFrame:
    """1-based position of each row within its key, ordered by an integer column."""
    return running(df, keys, seq, sums={name: F.lit(1)}, tie=tie, chunk=chunk)


def long_keys(df: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame | None:
    """Keys with more than ``most`` rows (by default ``CHUNK``), written; None where there is none.

    Keys are counted in groups by hash first, which are few at any size; only those of a
    large group are counted one by one.
    """
    most = most or CHUNK
    group = F.pmod(F.xxhash64(*keys), F.lit(65_536)).alias("_g")
    groups, n = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_g"))
    if not n["rows"]:
        return None
    some = df.select(*keys, group).join(groups, "_g", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found, n = materialise(some.where(F.col("_n") > most).select(*keys))
    return found if n["rows"] else None


def split_long(df: DataFrame, keys: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that a task holds with ease, and rows of the others, if there are any."""
    found = long_keys(df, keys, most)
    if found is None:
        return df, None
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(found[k])
    return df.join(F.broadcast(found), same, "left_anti"), df.join(F.broadcast(found), same, "left_semi")


def number_ranges(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Gapless numbers from 0 in the order of columns, for tables of any size.

    Rows are sorted in ranges, numbered within their task and shifted by the sizes of
    the ranges before; rows equal in ``order`` take any of their numbers.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            marks = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "_part", "_at"])
            at += n

    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    ranges, _ = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranges.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranges.join(bases, F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_base") + F.col("_at")).cast("bigint").alias(name))


def with_previous(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], prefix: str = "prev_",
                  chunk: int | None = None) -> DataFrame:
    """Columns of the row one step back, for gap-free integer sequences.

    The last row of each chunk is copied into the next, so a long sequence is
    windowed in pieces and no piece waits for another.
    """
    chunk = chunk or CHUNK
    copies = F.when(F.pmod(F.col(seq), F.lit(chunk)) == chunk - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    marked = df.withColumn("_copy", F.explode(copies)).withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk)) + F.col("_copy"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    out = marked.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in columns], F.lag(seq).over(w).alias("_pseq")).where("_copy = 0")
    near = F.col("_pseq") == F.col(seq) - 1
    return out.select(*df.columns, *[F.when(near, F.col(prefix + c)).alias(prefix + c) for c in columns])
