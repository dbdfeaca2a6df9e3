"""Rendezvous hashing of stable record keys over weighted shards.

Each record draws one number per shard from a hash of its key and the shard's name
and goes to the shard with the best draw. A shard's draw does not depend on the
other shards, so a new shard takes records only into itself and leaves the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.llm.common import rank_in_groups

SHARDS = 40
OVERHEAD = 16


def draw(key: Column, shard: int, weight: float) -> Column:
    """Logarithm of a uniform number divided by the weight; the largest wins (weighted rendezvous)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("bigint")
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def assign(df: DataFrame, key: Column, weights: Sequence[float], grown_by: float = 1.0,
           shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with its shard and the shard it would have with one more of weight ``grown_by``.

    ``key`` is a string; null counts as the empty key. On equal draws the lower
    number wins. Existing columns of the two names are replaced.
    """
    k = F.coalesce(key, F.lit(""))
    draws = F.array(*[F.struct(draw(k, i, w).alias("d"), F.lit(-i).alias("i")) for i, w in enumerate(weights)])
    n = len(weights)
    out = df.withColumn("_best", F.array_max(draws)).withColumn("_next", draw(k, n, grown_by))
    own = (-F.col("_best.i")).cast("int")
    out = out.withColumn(shard, own).withColumn(grown, F.when(F.col("_next") > F.col("_best.d"), F.lit(n)).otherwise(F.col(shard)).cast("int"))
    return out.drop("_best", "_next")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Shard, gapless slot, size and checksum of every document.

    Size is the UTF-8 bytes of the text plus 16; a null text has none and checksum
    0. A null id is the empty key. Repeated rows each get a slot of their shard.
    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
                       F.crc32(text).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"))
    key = F.col("doc_id").cast("string")
    placed = assign(rows, key, weights)
    name = F.md5(F.coalesce(key, F.lit("")))
    ordered = placed.withColumn("_name", name)
    out = rank_in_groups(ordered, ["shard"], F.substring("_name", 1, 2), [F.col("_name"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same in SQL: checksums by table over the bytes, draws by md5, for equal weights.
SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
rows AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
sized AS (
  SELECT r, doc_id, k, CAST(length(bytes) / 2 + {OVERHEAD} AS BIGINT) AS size,
         CAST(xor(list_reduce(range(CAST(length(bytes) / 2 AS BIGINT)), lambda c, i:
              xor(c >> 8, crc_table.tab[CAST((xor(c, ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT) & 255) + 1 AS BIGINT)]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM rows, crc_table),
draws AS (
  SELECT r, CAST(s AS INTEGER) AS s, ln((('0x' || substr(md5(k || ':' || CAST(s AS VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS d
  FROM rows, range({SHARDS + 1}) AS shards(s)),
best AS (SELECT r, s, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY d DESC, s) AS place FROM draws WHERE s < {SHARDS}) WHERE place = 1)
SELECT z.doc_id, z.size, z.text_crc32, 'key' AS law, b.s AS shard,
       ROW_NUMBER() OVER (PARTITION BY b.s ORDER BY md5(z.k), z.text_crc32, z.size) - 1 AS slot,
       CASE WHEN n.d > b.d THEN n.s ELSE b.s END AS grown_shard
FROM sized z JOIN best b ON b.r = z.r JOIN draws n ON n.r = z.r AND n.s = {SHARDS}
"""
