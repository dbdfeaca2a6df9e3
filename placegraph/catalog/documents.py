"""Change-data and naming queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query
from placegraph.operators import changes as X
from placegraph.operators import naming as N

COLUMNS = ["type", "nid", "a", "b", "building", "floor", "lng", "lat", "metres"]
KEY = "CASE WHEN type = 'node' THEN 'n:' || nid ELSE 'p:' || LEAST(a, b) || '|' || GREATEST(a, b) END"
SIG = "COALESCE(nid, '') || '~' || COALESCE(a, '') || '~' || COALESCE(b, '') || '~' || COALESCE(building, '') || '~' || COALESCE(floor, '') || '~' || COALESCE(CAST(lng AS STRING), '') || '~' || COALESCE(CAST(lat AS STRING), '') || '~' || COALESCE(CAST(metres AS STRING), '')"


def before(spark, sf):
    return D.view(spark, sf, "features_before")


def after(spark, sf):
    return D.view(spark, sf, "features_after")


DIFF = f"""
b AS (SELECT {KEY} AS key, ARG_MAX({SIG}, ord) AS sig FROM features_before GROUP BY 1),
n AS (SELECT {KEY} AS key, ARG_MAX({SIG}, ord) AS sig FROM features_after GROUP BY 1),
diff AS (SELECT COALESCE(b.key, n.key) AS key, CASE WHEN b.key IS NULL THEN 'add' WHEN n.key IS NULL THEN 'remove' WHEN b.sig <> n.sig THEN 'update' END AS op
  FROM b FULL OUTER JOIN n ON b.key = n.key)"""
FV = ("features_before", "features_after")


@query("snapshot_diff", f"WITH {DIFF} SELECT key, op FROM diff WHERE op IS NOT NULL", FV)
def snapshot_diff(spark, sf):
    return X.snapshot_diff(before(spark, sf), after(spark, sf), COLUMNS)


def delta(spark, sf):
    """Removes every tenth node, adds the new ones and every other removed one again, moves the next tenth."""
    b, n = before(spark, sf), after(spark, sf)
    cols = [F.col(c) for c in COLUMNS]
    none = [F.lit(None).cast(n.schema[c].dataType).alias(c) for c in COLUMNS]
    gone = b.where("type = 'node' AND ord % 10 = 0")
    remove = gone.select(F.lit("remove").alias("op"), F.col("ord").alias("seq"), X.feature_key().alias("key"), *none)
    put = n.where("ord >= 2000000000000").unionByName(gone.where("ord % 20 = 0")).select(F.lit("add").alias("op"), F.col("ord").alias("seq"), F.lit(None).cast("string").alias("key"), *cols)
    change = n.where("type = 'node' AND ord % 10 = 1 AND ord < 1000000000000").select(F.lit("update").alias("op"), F.col("ord").alias("seq"), F.lit(None).cast("string").alias("key"), *cols)
    return remove.unionByName(put).unionByName(change)


@query("apply_delta", f"""
WITH b AS (SELECT {KEY} AS key, MIN(ord) AS pos, ARG_MAX(lng, ord) AS lng, ARG_MAX_NULL(metres, ord) AS metres FROM features_before GROUP BY 1),
u AS (SELECT {KEY} AS key, lng, metres, ord FROM features_after WHERE type = 'node' AND ord % 10 = 1 AND ord < 1000000000000),
a AS (SELECT {KEY} AS key, lng, metres, ord FROM features_after WHERE ord >= 2000000000000 UNION ALL SELECT {KEY}, lng, metres, ord FROM features_before WHERE type = 'node' AND ord % 20 = 0),
r AS (SELECT {KEY} AS key FROM features_before WHERE type = 'node' AND ord % 10 = 0)
SELECT b.key, r.key IS NULL OR a.key IS NOT NULL AS kept, CASE WHEN r.key IS NULL THEN 0 ELSE 1 END AS section, CASE WHEN r.key IS NULL THEN b.pos ELSE COALESCE(a.ord, -1) END AS pos,
  CASE WHEN u.key IS NOT NULL THEN u.lng WHEN r.key IS NULL THEN b.lng ELSE a.lng END AS lng, CASE WHEN r.key IS NULL THEN b.metres END AS metres,
  CAST(CASE WHEN r.key IS NOT NULL AND a.key IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN u.key IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS updated,
  CAST(CASE WHEN r.key IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS removed
FROM b LEFT JOIN u ON u.key = b.key LEFT JOIN r ON r.key = b.key LEFT JOIN a ON a.key = b.key
UNION ALL SELECT key, TRUE, 1, ord, lng, metres, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM a WHERE ord >= 2000000000000""", FV)
def apply_delta(spark, sf):
    applied = X.apply_delta(before(spark, sf), delta(spark, sf), COLUMNS)
    return applied.select("key", "kept", "section", F.coalesce("pos.seq", F.lit(-1)).alias("pos"), "lng", "metres", "added", "updated", "removed")


@query("delta_counts", f"""WITH b AS (SELECT DISTINCT {KEY} AS key FROM features_before), c AS (SELECT
 (SELECT COUNT(*) FROM features_after WHERE ord >= 2000000000000) AS m, (SELECT COUNT(*) FROM nodes WHERE ord % 20 = 0) AS back, (SELECT COUNT(*) FROM nodes WHERE ord % 10 = 1) AS moved,
 (SELECT COUNT(*) FROM nodes WHERE ord % 10 = 0) AS gone, (SELECT COUNT(*) FROM b) AS had)
SELECT m + back AS added, moved AS updated, gone AS removed, had - gone + m + back AS features FROM c""", FV)
def delta_counts(spark, sf):
    return X.delta_counts(X.apply_delta(before(spark, sf), delta(spark, sf), COLUMNS))


@query("guards", f"""WITH {DIFF}, c AS (SELECT (SELECT COUNT(*) FROM diff WHERE op IN ('add', 'update')) AS changes, (SELECT COUNT(*) FROM features_after) AS features,
 (SELECT COUNT(*) FROM features_before WHERE type = 'node') AS had, (SELECT COUNT(*) FROM features_after WHERE type = 'node' AND ord % 3 = 0) AS now)
SELECT had, now, had > 10 AND now < had / 2 AS refused, changes, features, CASE WHEN changes > features * 0.6 THEN 'full' ELSE 'delta' END AS mode FROM c""", FV)
def guards(spark, sf):
    b, a = before(spark, sf), after(spark, sf)
    shrink = X.shrink_guard(b.where("type = 'node'"), a.where("type = 'node' AND ord % 3 = 0"))
    return shrink.join(X.write_mode(X.snapshot_diff(b, a, COLUMNS), a))


@query("duplicate_ids", "WITH u AS (SELECT nid FROM nodes UNION ALL SELECT 'n' || CAST(ord * 3 AS STRING) FROM places) SELECT nid, COUNT(*) AS rows FROM u GROUP BY nid HAVING COUNT(*) > 1", ("nodes", "places"))
def duplicate_ids(spark, sf):
    p = D.view(spark, sf, "places").select(F.concat(F.lit("n"), (F.col("ord") * 3).cast("string")).alias("nid"))
    return X.duplicate_ids(B.nodes(spark, sf).select("nid").unionByName(p))


@query("check_features", """SELECT ord, CASE WHEN type = 'node' AND (lng IS NULL OR ord % 13 = 0) THEN 'NODE_WITHOUT_POINT' WHEN type = 'node' AND ord % 29 = 0 THEN 'NODE_WITHOUT_ID'
 WHEN type = 'path' AND ord % 31 = 0 THEN 'LINK_WITHOUT_ENDS' WHEN ord % 37 = 0 THEN 'KIND_UNKNOWN' END AS error FROM features_after""", FV)
def check_features(spark, sf):
    a = after(spark, sf)
    kind = F.when((F.col("ord") % 37 == 0) & ((F.col("type") == "path") & (F.col("ord") % 31 != 0) | (F.col("type") == "node") & (F.col("ord") % 13 != 0) & (F.col("ord") % 29 != 0)), "room").otherwise(F.col("type"))
    broken = a.select("ord", kind.alias("type"), F.when(F.col("ord") % 29 != 0, F.col("nid")).alias("nid"), F.when(F.col("ord") % 31 != 0, F.col("a")).alias("a"), "b",
                      F.when(F.col("ord") % 13 != 0, F.col("lng")).alias("lng"), "lat")
    return X.check_features(broken).select("ord", "error")


@query("version_guard", "SELECT event_id, event_id % 5 = 3 AS accepted FROM activity", ("activity",))
def version_guard(spark, sf):
    d = D.view(spark, sf, "activity").withColumn("base_version", F.col("event_id") % 5)
    return X.version_guard(d, 3).select("event_id", "accepted")


@query("toggle_links", """WITH t AS (SELECT LEAST('n' || CAST(event_id % 700 AS STRING), node_id) AS a, GREATEST('n' || CAST(event_id % 700 AS STRING), node_id) AS b FROM activity),
u AS (SELECT DISTINCT LEAST(a, b) AS a, GREATEST(a, b) AS b FROM links WHERE a <> b UNION ALL SELECT a, b FROM t WHERE a <> b)
SELECT a, b FROM u GROUP BY a, b HAVING COUNT(*) % 2 = 1""", ("links", "activity"))
def toggle_links(spark, sf):
    t = D.view(spark, sf, "activity").select(F.concat(F.lit("n"), (F.col("event_id") % 700).cast("string")).alias("a"), F.col("node_id").alias("b"))
    return X.toggle_links(B.links(spark, sf), t)


@query("placement_upsert", """WITH inc AS (SELECT building || '-' || CAST(event_id % 4 AS STRING) AS sheet, ARG_MAX(event_id, event_id) AS width FROM activity GROUP BY 1),
cur AS (SELECT DISTINCT building || '-' || floor AS sheet, CAST(-1 AS BIGINT) AS width FROM spaces)
SELECT COALESCE(i.sheet, c.sheet) AS sheet, COALESCE(i.width, c.width) AS width FROM cur c FULL OUTER JOIN inc i ON i.sheet = c.sheet""", ("activity", "spaces"))
def placement_upsert(spark, sf):
    cur = B.spaces(spark, sf).select(F.concat_ws("-", "building", "floor").alias("sheet"), F.lit(-1).cast("bigint").alias("width")).distinct()
    inc = D.view(spark, sf, "activity").select(F.concat_ws("-", "building", (F.col("event_id") % 4).cast("string")).alias("sheet"), F.col("event_id").alias("width"), "event_id")
    return X.upsert(cur, inc, ["sheet"], "event_id")


_TEXT = ", ".join(f"COALESCE(CAST({c} AS STRING), '\\N')" for c in COLUMNS)


@query("fingerprint", f"""SELECT COUNT(*) AS rows, CAST(SUM(('0x' || SUBSTR(h, 1, 7))::BIGINT) AS BIGINT) AS mix, CAST(SUM(('0x' || SUBSTR(h, 8, 7))::BIGINT) AS BIGINT) AS total
FROM (SELECT md5(CONCAT_WS(CHR(31), {_TEXT})) AS h FROM features_after)""", FV)
def fingerprint(spark, sf):
    return X.fingerprint(after(spark, sf), COLUMNS)


@query("node_names")
def node_names(spark, sf):
    """Every node with a name of its own. Greedy and sequential by rule, so checked by brute force in the tests."""
    return N.name_network(B.nodes(spark, sf), B.spaces(spark, sf)).select("nid", "name")


@query("stale_names", r"""
WITH t AS (SELECT DISTINCT building FROM spaces WHERE type IS NOT NULL AND type <> 'building'),
m AS (SELECT n.*, COALESCE(n.building, 'OUT') AS prefix, n.building IN (SELECT building FROM t) AS marked,
  REGEXP_EXTRACT(name, '^(.*)-([0-9]*)H([0-9]+)$', 1) AS mp, REGEXP_EXTRACT(name, '^(.*)-([0-9]*)H([0-9]+)$', 2) AS mf, REGEXP_EXTRACT(name, '^(.*)-([0-9]+)$', 1) AS pp FROM nodes n),
s AS (SELECT *, CASE WHEN mp <> '' THEN mp ELSE NULLIF(pp, '') END AS sp, mp <> '' AS sm, mp <> '' OR (pp <> '' AND pp NOT IN (SELECT building FROM t)) AS counted FROM m WHERE name IS NOT NULL)
SELECT nid, counted AND (room IS NOT NULL OR sp <> prefix OR sm <> COALESCE(marked, FALSE) OR (COALESCE(marked, FALSE) AND mf <> COALESCE(floor, ''))) AS stale FROM s""", ("nodes", "spaces"))
def stale_names(spark, sf):
    n = B.nodes(spark, sf).where("name IS NOT NULL")
    t = N.traced_buildings(B.spaces(spark, sf))
    n = n.join(t, F.col("building") == F.col("traced"), "left").withColumn("prefix", F.coalesce("building", F.lit("OUT"))).withColumn("marked", F.col("traced").isNotNull())
    return N.stale_names(n, B.spaces(spark, sf)).select("nid", "stale")


@query("display_names", """
WITH no AS (SELECT nid, room, ROW_NUMBER() OVER (ORDER BY ord) AS no FROM nodes), t AS (SELECT nid, 'N' || CAST(no AS STRING) || CASE WHEN room IS NOT NULL THEN ' (' || room || ')' ELSE '' END AS t FROM no)
SELECT l.ord, 'Link ' || COALESCE(x.t, '?') || ' ↔ ' || COALESCE(y.t, '?') AS title FROM links l LEFT JOIN t x ON x.nid = l.a LEFT JOIN t y ON y.nid = l.b
UNION ALL SELECT -1 - n.ord, COALESCE(n.name, 'Node ' || CAST(no.no AS STRING)) FROM nodes n JOIN no ON no.nid = n.nid""", ("nodes", "links"))
def display_names(spark, sf):
    null = lambda t: F.lit(None).cast(t)
    n = B.nodes(spark, sf).select("ord", F.lit("point").alias("kind"), F.lit("node").alias("type"), "nid", null("string").alias("a"), null("string").alias("b"), "room", "building", "name", null("array<string>").alias("connects"))
    l = B.links(spark, sf).select("ord", F.lit("path").alias("kind"), F.lit("path").alias("type"), null("string").alias("nid"), "a", "b", null("string").alias("room"), null("string").alias("building"), null("string").alias("name"), null("array<string>").alias("connects"))
    # Nodes and links have file positions of their own here; titles only count within a kind.
    d = N.display_names(n.unionByName(l.withColumn("ord", F.col("ord") + 1_000_000_000_000)))
    return d.select(F.when(F.col("ord") >= 1_000_000_000_000, F.col("ord") - 1_000_000_000_000).otherwise(-1 - F.col("ord")).alias("ord"), "title")
