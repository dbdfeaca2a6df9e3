"""Snapshots, deltas and guards for the network document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.functions import text
from placegraph.operators.common import first_by


def feature_key() -> Column:
    """``n:<nid>`` for a node, ``p:<a>|<b>`` (sorted) for a link, NULL for anything else."""
    pair = F.array_sort(F.array("a", "b"))
    return (F.when((F.col("type") == "node") & text.filled("nid"), F.concat(F.lit("n:"), F.col("nid")))
            .when((F.col("type") == "path") & F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat(F.lit("p:"), F.array_join(pair, "|"))))


def signature(columns: Sequence[str]) -> Column:
    """A fixed-order fingerprint of a row's content, NULLs included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``key, op`` (add, update, remove) between two snapshots; unkeyed rows and equal rows give nothing.

    Where a key repeats, its last row in file order counts.
    """
    last = lambda df, n: df.withColumn("key", feature_key()).where("key IS NOT NULL").groupBy("key").agg(F.max_by(signature(columns), "ord").alias(n))
    j = last(before, "_was").join(last(after, "_now"), "key", "full_outer")
    op = F.when(F.col("_was").isNull(), "add").when(F.col("_now").isNull(), "remove").when(F.col("_was") != F.col("_now"), "update")
    return j.select("key", op.alias("op")).where("op IS NOT NULL")


def apply_delta(existing: DataFrame, delta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every key met, with its content after the change and what happened to it.

    ``existing``: ``ord`` and the feature columns; ``delta``: ``op, seq, key`` and
    the feature columns (``key`` is only read on removes). Removes go first, then
    adds, then updates; a later row of a key wins. Survivors keep their place,
    new keys follow in order of arrival. Output: ``key, kept, section, pos``,
    the feature columns, and the counts ``added, updated, removed`` of the key.
    Rows without a key are dropped; :func:`dropped_unkeyed` counts them.
    """
    content = F.struct(*columns)
    base = existing.withColumn("key", feature_key()).where("key IS NOT NULL").groupBy("key").agg(
        F.min("ord").alias("_pos"), F.max_by(content, "ord").alias("_old"))
    put = delta.where(F.col("op").isin("add", "update")).withColumn("key", feature_key()).where("key IS NOT NULL")
    turn = F.struct(F.when(F.col("op") == "add", 0).otherwise(1).alias("o"), "seq")
    put = put.groupBy("key").agg(F.min(turn).alias("_first"), F.max_by(content, turn).alias("_new"), F.count(F.lit(1)).alias("_n"))
    gone = delta.where(F.col("op") == "remove").select("key").where("key IS NOT NULL").distinct().withColumn("_gone", F.lit(True))
    j = base.join(put, "key", "full_outer").join(gone, "key", "left")
    was, removed = F.col("_old").isNotNull(), F.coalesce("_gone", F.lit(False))
    survives = was & ~removed
    fresh = F.col("_new").isNotNull() & ~survives
    n = F.coalesce("_n", F.lit(0))
    row = F.coalesce("_new", F.when(survives, F.col("_old")))
    return j.select(
        "key", row.isNotNull().alias("kept"), F.when(survives, 0).otherwise(1).alias("section"),
        F.when(survives, F.struct(F.lit(0).alias("o"), F.col("_pos").cast("bigint").alias("seq"))).otherwise(
            F.struct(F.col("_first.o").alias("o"), F.col("_first.seq").cast("bigint").alias("seq"))).alias("pos"),
        *[row[c].alias(c) for c in columns],
        F.when(fresh, F.lit(1)).otherwise(0).cast("bigint").alias("added"),
        (n - F.when(fresh, F.lit(1)).otherwise(0)).alias("updated"),
        F.when(was & removed, F.lit(1)).otherwise(0).cast("bigint").alias("removed"))


def merged_features(applied: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The features of an applied delta in document order."""
    return applied.where("kept").orderBy("section", "pos").select("key", *columns)


def delta_counts(applied: DataFrame) -> DataFrame:
    return applied.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "updated", "removed")], F.count_if("kept").alias("features"))


def dropped_unkeyed(existing: DataFrame) -> DataFrame:
    return existing.agg(F.count_if(feature_key().isNull()).alias("dropped_unkeyed"))


def check_features(features: DataFrame) -> DataFrame:
    """``error`` of each network feature, NULL when fine."""
    point = F.col("lng").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lng") & ~F.isnan("lat")
    error = (F.when((F.col("type") == "node") & ~point, "NODE_WITHOUT_POINT")
             .when((F.col("type") == "node") & ~text.filled("nid"), "NODE_WITHOUT_ID")
             .when((F.col("type") == "path") & (F.col("a").isNull() | F.col("b").isNull()), "LINK_WITHOUT_ENDS")
             .when(~F.coalesce(F.col("type").isin("node", "path"), F.lit(False)), "KIND_UNKNOWN"))
    return features.withColumn("error", error)


def check_sheet(features: DataFrame) -> DataFrame:
    """``error`` of each sheet feature: ``geom_type, points`` (array), ``connects``, ``nodes``."""
    n = F.coalesce(F.size("points"), F.lit(-1))
    ends = F.coalesce(F.size("nodes"), F.lit(-1))
    error = (F.when((F.col("geom_type") == "Polygon") & (n < 4), "OUTLINE_TOO_SHORT")
             .when((F.col("geom_type") == "Point") & (n != 1), "MARKER_WITHOUT_POINT")
             .when((F.col("geom_type") == "Point") & (F.size("connects") > 2), "MARKER_OVERLINKED")
             .when((F.col("geom_type") == "LineString") & (n != 2), "PATH_NOT_TWO_POINTS")
             .when((F.col("geom_type") == "LineString") & (ends != 2), "PATH_NOT_TWO_NODES")
             .when(~F.coalesce(F.col("geom_type").isin("Polygon", "Point", "LineString"), F.lit(False)), "SHAPE_UNKNOWN"))
    return features.withColumn("error", error)


def check_ends(requests: DataFrame) -> DataFrame:
    """Asked-for points outside the world are dropped; labels are cut to 80 characters."""
    ok = F.coalesce((F.abs("lng") <= 180) & (F.abs("lat") <= 90) & ~F.isnan("lng") & ~F.isnan("lat"), F.lit(False))
    return requests.withColumn("valid", ok).withColumn("label", F.substring("label", 1, 80))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("nid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def version_guard(delta: DataFrame, current_version: int) -> DataFrame:
    """``accepted`` is false for changes made against any other version."""
    return delta.withColumn("accepted", F.coalesce(F.col("base_version") == current_version, F.lit(False)))


def shrink_guard(had: DataFrame, now: DataFrame, forced: bool = False) -> DataFrame:
    """Refuse a write that would leave less than half of more than ten nodes. One row: ``had, now, refused``."""
    a, b = had.agg(F.count_distinct("nid").alias("had")), now.agg(F.count_distinct("nid").alias("now"))
    # Two one-row aggregates.
    return a.join(b).select("had", "now", ((F.col("had") > 10) & (F.col("now") < F.col("had") / 2) & F.lit(not forced)).alias("refused"))


def write_mode(diff: DataFrame, features: DataFrame, limit: float = 0.6) -> DataFrame:
    """Whether to send the change or the whole document. One row: ``changes, features, mode``."""
    c = diff.agg(F.count_if(F.col("op").isin("add", "update")).alias("changes"), F.count(F.lit(1)).alias("_all"))
    f = features.agg(F.count(F.lit(1)).alias("features"))
    mode = F.when(F.col("_all") == 0, "unchanged").when(F.col("changes") > F.col("features") * limit, "full").otherwise("delta")
    return c.join(f).select("changes", "features", mode.alias("mode"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent fingerprint of a table: one row ``rows, mix, total``, sums of digits of each row's md5."""
    text_of = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (columns or df.columns)]
    h = F.md5(F.concat_ws("\x1f", *text_of))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 7), 16, 10).cast("bigint")), F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("mix"), part(8).alias("total"))


def toggle_links(links: DataFrame, toggles: DataFrame) -> DataFrame:
    """Joining a joined pair parts it: pairs left after toggling ``a, b`` rows in any number."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    have = links.where("a <> b").select(*pair).distinct().withColumn("n", F.lit(1).cast("bigint"))
    flips = toggles.where("a <> b").select(*pair).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return have.unionByName(flips).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n % 2 = 1").select("a", "b")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keyed merge: the newest incoming row of a key replaces the stored one."""
    new = first_by(incoming.withColumn("_o", -F.col(order).cast("bigint")), list(keys), ["_o"], [c for c in current.columns if c not in keys])
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*current.columns))


def promote_guard(live: DataFrame, generated: DataFrame, least: float = 0.9) -> DataFrame:
    """Whether a generated set may replace the live one: not below nine tenths of its rows."""
    a, b = live.agg(F.count(F.lit(1)).alias("live")), generated.agg(F.count(F.lit(1)).alias("generated"))
    return a.join(b).select("live", "generated", (F.col("generated") >= F.col("live") * least).alias("promote"))
