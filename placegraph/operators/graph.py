"""Graph operators as rounds of joins: components, arcs, ways back along pointers.

Every round ends in one written table (see ``session.materialise``), so lineage
stays short, lost executors cost one round at most, and the stop condition comes
with the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.session import discard, materialise

ENTRY_M = 1000.0
NOT_THOROUGHFARE = ("room", "service")


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(e: DataFrame) -> DataFrame:
    sym = _both_ways(e)
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return sym.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hook = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hook.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame, order: str = "ord") -> DataFrame:
    """Connected component of every node, named by the lowest ``order`` in it.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the edge
    table never grows and settles in a number of rounds that follows the log of
    the node count, not the network's diameter. Returns ``nid, ord, component``.
    """
    ids = nodes.select("nid", F.col(order).cast("bigint").alias("ord"))
    a = ids.select(F.col("nid").alias("a"), F.col("ord").alias("u"))
    b = ids.select(F.col("nid").alias("b"), F.col("ord").alias("v"))
    state = {"rows": F.count(F.lit(1)), "mix": F.bit_xor(F.xxhash64("u", "v")), "back": F.bit_xor(F.xxhash64("v", "u"))}
    e = edges.select("a", "b").join(a, "a").join(b, "b").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, seen = materialise(e, **state)
    while seen["rows"]:
        after, now = materialise(_small_star(_large_star(e)), **state)
        discard(e)
        settled, e, seen = now == seen, after, now
        if settled:
            break
    roots = e.select(F.col("u").alias("ord"), F.col("v").alias("component"))
    return ids.join(roots, "ord", "left").select("nid", "ord", F.coalesce("component", "ord").alias("component"))


def main_component(comps: DataFrame) -> DataFrame:
    """The largest component, the one with the earliest node on a tie: one row ``component, size``."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.agg(F.min(F.struct((-F.col("size")).alias("s"), "component")).alias("m"))
    return best.where(F.col("m").isNotNull()).select(F.col("m.component").alias("component"), (-F.col("m.s")).alias("size"))


def on_main(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes of the main component."""
    main = main_component(comps).select("component")
    return nodes.join(comps.join(main, "component", "left_semi").select("nid"), "nid", "left_semi")


def arcs_of(nodes: DataFrame, edges: DataFrame, entry_m: float = ENTRY_M) -> DataFrame:
    """Edges both ways with what it costs to set foot in the far node."""
    both = edges.select("a", "b", "metres").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres"))
    into = nodes.select(F.col("nid").alias("b"), F.col("room").alias("b_room"),
                        F.when(F.col("space").isin(*NOT_THOROUGHFARE), F.lit(entry_m)).otherwise(0.0).alias("entry"))
    return both.join(into, "b").select("a", "b", F.col("metres").alias("w"), "entry", "b_room")


def walk_back(answers: DataFrame, state: DataFrame) -> DataFrame:
    """The nodes of every walk in order: ``query_id, step, nid``.

    Pointers are doubled each round, so a walk of n nodes takes log2(n) rounds.
    """
    cost = answers.select("query_id", "cost")
    jump = state.join(cost, "query_id").where((F.col("dist") <= F.col("cost")) & F.col("prev").isNotNull()).select(
        "query_id", "node", F.col("prev").alias("up"))
    path = answers.select("query_id", F.col("goal").alias("node"), F.lit(0).cast("bigint").alias("back"))
    jump, hops = materialise(jump)
    path, _ = materialise(path)
    width = 1
    while hops["rows"]:
        on = ["query_id", "node"]
        more = path.join(jump, on).select("query_id", F.col("up").alias("node"), (F.col("back") + width).alias("back"))
        longer, n = materialise(path.withColumn("_new", F.lit(False)).unionByName(more.withColumn("_new", F.lit(True))),
                                new=F.count_if("_new"))
        path = longer.drop("_new")
        if not n["new"]:
            break
        twice = jump.join(jump.select("query_id", F.col("node").alias("up"), F.col("up").alias("top")), ["query_id", "up"]).select(
            "query_id", "node", F.col("top").alias("up"))
        after, hops = materialise(twice)
        discard(jump)
        jump, width = after, width * 2
    last = path.groupBy("query_id").agg(F.max("back").alias("_last"))
    return path.join(last, "query_id").select("query_id", (F.col("_last") - F.col("back")).alias("step"), F.col("node").alias("nid"))
