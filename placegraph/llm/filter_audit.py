"""How five removal filters interact, by the potential of the removal game.

A coalition of filters removes every document that fails one of them. That count, for
all 32 coalitions, is the whole game: what a filter takes at its place in an order is
the difference of two coalitions, and the potential

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|,   P(empty) = 0

turns it into shares: a filter's Shapley value is P(all) less P(all without it).

Documents shrink to the histogram of their failure masks per part: texts equal in
content are one class, counted before anything is joined.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MIN_WORDS = 100
#: Failing marks of filter D.
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D that a text fails; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, chars = F.size(words), F.length(text)
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * chars, text.rlike(MARKS)]
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0)).cast("int")


def failure_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and set of failed filters.

    Bit 4 (E) is set where a smaller id holds the same text anywhere in the table. A
    null id is neither smaller nor larger than any, so it never fails E; repeated
    rows of one id do not fail it by each other. Of repeated labels the larger counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text_mask(F.col("text")).alias("bits"), F.unhex(F.sha2(text, 256)).alias("content"))
    rows = rows.groupBy("doc_id", "part", "bits", "content").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    classes = named.groupBy("content", "bits", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("low"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_low"))
    first = classes.groupBy("content").agg(F.min("low").alias("first"))
    told = classes.join(first, "content").withColumn(
        "new", F.col("unnamed") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("new").alias("k")),
                              F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("new")).alias("k"))))
    return told.select("part", "good", "toxic", sides.alias("s")).groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.k").alias("n"), F.sum(F.col("good") * F.col("s.k")).alias("good"), F.sum(F.col("toxic") * F.col("s.k")).alias("toxic"))


def game(histogram: list[int]) -> list[int]:
    """How many documents each coalition removes, from the counts per failure mask."""
    return [sum(n for mask, n in enumerate(histogram) if mask & s) for s in range(len(histogram))]


def potential(v: list[int]) -> list[int]:
    """Potential of every coalition times the number of orders, an integer."""
    players = len(v).bit_length() - 1
    p = [0] * len(v)
    for s in range(1, len(v)):
        inside = [i for i in range(players) if s >> i & 1]
        p[s] = (factorial(players) * v[s] + sum(p[s ^ 1 << i] for i in inside)) // len(inside)
    return p


def order_steps(n: list[int], good: list[int], toxic: list[int]):
    """One tuple for each order of the filters and step: all columns but the part."""
    v, vg, vt = game(n), game(good), game(toxic)
    p = potential(v)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            yield ("".join(FILTERS[k] for k in order), step, sum(n) - v[after], removed, v[1 << i] - removed, v[ALL] - v[ALL ^ 1 << i],
                   vg[after] - vg[before], vt[after] - vt[before], p[ALL] - p[ALL ^ 1 << i])
            before = after


COLUMNS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the filters for every part (``lang``; null is the part of the empty string).

    ``shapley`` is the filter's Shapley value times the number of orders: what it
    removes summed over all of them. Steps that remove nothing have rows of zeros. An
    empty table has no parts and no rows. Other columns are ignored.
    """
    wide = failure_histogram(docs, labels).groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(ALL + 1)]).alias(c) for c in ("n", "good", "toxic")])

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for pdf in batches:
            for part, *counts in zip(*(pdf[c] for c in ("part", "n", "good", "toxic"))):
                yield pd.DataFrame([(part, *row) for row in order_steps(*([int(x) for x in c] for c in counts))], columns=names)

    return wide.mapInPandas(run, COLUMNS)


#: The same in SQL, every document against every order.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = w.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o, s, substr(o, s, 1) AS f, left(o, s - 1) AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
told AS (
  SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone, fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone
  FROM h, steps),
r AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, f,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
