"""Search, timetable and activity queries and their checks."""

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.catalog.base import query
from placegraph.catalog.rollups import INDEX_CTE, index
from placegraph.functions import clock, text
from placegraph.operators import activity as A
from placegraph.operators import coverage as C
from placegraph.operators import search as S
from placegraph.operators import timetable as T

TEXTS = """
texts AS (SELECT k AS query_id, CASE k % 7 WHEN 0 THEN 'B' || CAST(s_nationkey AS STRING) WHEN 1 THEN ' b' || CAST(s_nationkey AS STRING) || '  20'
  WHEN 2 THEN CAST(1000 + (k * 7) % 3050 AS STRING) WHEN 3 THEN 'hot p' WHEN 4 THEN SUBSTR('restroom red', 1, CAST(1 + k % 12 AS INT))
  WHEN 5 THEN 'lot ' || CAST(CAST(FLOOR(k / 10) AS BIGINT) AS STRING) ELSE 'B' || CAST(s_nationkey AS STRING) || '-' || CAST(1 + k % 4 AS STRING) END AS text FROM place_base),
codes AS (SELECT name, MIN(display) AS display, MIN(kind) AS kind FROM places GROUP BY name)"""
TV = ("places", "spaces")


def _typed(spark, sf):
    tables = D.with_clause("places")[5:]
    scan = f"supplier AS (SELECT * FROM parquet.`{sf}/supplier.parquet`)"
    return spark.sql(f"WITH {scan}, {tables}, {TEXTS} SELECT * FROM texts"), spark.sql(f"WITH {scan}, {tables}, {TEXTS} SELECT * FROM codes")


@query("suggest_rooms", f"""WITH {INDEX_CTE}, {TEXTS}, t AS (SELECT query_id, UPPER(TRIM(text)) AS w, REPLACE(UPPER(TRIM(text)), ' ', '') AS q FROM texts),
c AS (SELECT t.query_id, i.label, i.building, i.room, CASE WHEN UPPER(i.room) = q OR UPPER(label) = q THEN 0 WHEN STARTS_WITH(UPPER(i.room), q) THEN 1
   WHEN STARTS_WITH(UPPER(label), q) OR STARTS_WITH(COALESCE(UPPER(name), ''), w) THEN 2 WHEN CONTAINS(UPPER(label), q) OR CONTAINS(COALESCE(UPPER(name), ''), w) THEN 3 END AS score FROM t CROSS JOIN idx i
  UNION ALL SELECT t.query_id, p.name, p.name, '', CASE WHEN UPPER(p.name) = q THEN -1 WHEN STARTS_WITH(UPPER(p.name), q) THEN 1.5 END FROM t CROSS JOIN codes p)
SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(score AS DOUBLE) AS score, label, building, room FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, CASE WHEN room = '' THEN -1 ELSE CAST(room AS BIGINT) END, label) AS rank FROM c WHERE score IS NOT NULL) WHERE rank <= 8""", TV)
def suggest_rooms(spark, sf):
    texts, codes = _typed(spark, sf)
    return S.suggest(texts, index(spark, sf), codes)


@query("suggest_sections", f"""WITH {INDEX_CTE}, {TEXTS}, t AS (SELECT query_id, LOWER(TRIM(text)) AS q FROM texts),
b AS (SELECT t.query_id, COALESCE(p.display, p.name) AS title, p.name, CASE WHEN STARTS_WITH(LOWER(p.name), q) OR STARTS_WITH(LOWER(COALESCE(p.display, p.name)), q) THEN 0
  WHEN CONTAINS(LOWER(p.name), q) OR CONTAINS(LOWER(COALESCE(p.display, p.name)), q) THEN 1 END AS score FROM t CROSS JOIN codes p),
r AS (SELECT t.query_id, i.label AS title, i.source, i.ord FROM t JOIN idx i ON CONTAINS(LOWER(i.label), q))
SELECT query_id, section, CAST(rank AS BIGINT) AS rank, title FROM (
 SELECT query_id, 'Buildings' AS section, title, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, title, name) AS rank FROM b WHERE score IS NOT NULL
 UNION ALL SELECT query_id, 'Rooms', title, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY source, ord) FROM r) WHERE rank <= 6""", TV)
def suggest_sections(spark, sf):
    texts, codes = _typed(spark, sf)
    return S.suggest_sections(texts, index(spark, sf), codes)


PARSE = r"""
names AS (SELECT UPPER(name) AS name, COUNT(*) AS rooms, MIN(building) AS nb, MIN(room) AS nr FROM idx WHERE name IS NOT NULL GROUP BY 1),
refs AS (SELECT query_id, text, UPPER(REGEXP_REPLACE(TRIM(text), '\s+', ' ', 'g')) AS s FROM texts UNION ALL
         SELECT 1000000 + ord, name, UPPER(TRIM(name)) FROM spaces WHERE name IS NOT NULL UNION ALL SELECT 2000000 + ord, display, UPPER(display) FROM places WHERE display IS NOT NULL),
split AS (SELECT *, REGEXP_EXTRACT(s, '^([A-Z]+\d*)[-\s]+(\S.*)$', 1) AS head, TRIM(REGEXP_EXTRACT(s, '^([A-Z]+\d*)[-\s]+(\S.*)$', 2)) AS rest FROM refs)"""


@query("parse_refs", f"""WITH {INDEX_CTE}, {TEXTS}, {PARSE}
SELECT r.query_id, CASE WHEN w.name IS NOT NULL THEN s WHEN n.rooms = 1 THEN n.nb WHEN n.rooms > 1 THEN NULL
   WHEN head <> '' AND (h.name IS NOT NULL OR REGEXP_MATCHES(rest, '\\d')) THEN head END AS building,
 CASE WHEN w.name IS NOT NULL THEN '' WHEN n.rooms = 1 THEN n.nr WHEN n.rooms > 1 THEN s
   WHEN head <> '' AND (h.name IS NOT NULL OR REGEXP_MATCHES(rest, '\\d')) THEN rest ELSE s END AS room,
 w.name IS NULL AND COALESCE(n.rooms, 0) > 1 AS ambiguous
FROM split r LEFT JOIN codes w ON UPPER(w.name) = s LEFT JOIN names n ON n.name = s LEFT JOIN codes h ON UPPER(h.name) = head""", TV)
def parse_refs(spark, sf):
    texts, codes = _typed(spark, sf)
    more = B.spaces(spark, sf).where("name IS NOT NULL").select((F.col("ord") + 1000000).alias("query_id"), F.col("name").alias("text")).unionByName(
        D.view(spark, sf, "places").where("display IS NOT NULL").select((F.col("ord") + 2000000).alias("query_id"), F.col("display").alias("text")))
    names = C.rooms_by_name(index(spark, sf))
    return S.parse_refs(texts.unionByName(more), codes.withColumnRenamed("name", "code"), names).select("query_id", "building", "room", "ambiguous")


@query("find_buildings", f"""WITH {TEXTS}, a AS (SELECT ord, name, UPPER(name) AS alias FROM places UNION ALL SELECT ord, name, UPPER(display) FROM places WHERE display IS NOT NULL),
f AS (SELECT alias, ARG_MIN(name, ord) AS name FROM a GROUP BY alias), q AS (SELECT query_id, UPPER(TRIM(text)) AS alias FROM texts UNION ALL SELECT 2000000 + ord, UPPER(display) FROM places WHERE display IS NOT NULL)
SELECT q.query_id, f.name AS building FROM q LEFT JOIN f ON f.alias = q.alias""", TV)
def find_buildings(spark, sf):
    texts, _ = _typed(spark, sf)
    p = D.view(spark, sf, "places").withColumn("code", F.col("name"))
    more = p.where("display IS NOT NULL").select((F.col("ord") + 2000000).alias("query_id"), F.col("display").alias("text"))
    return S.find_buildings(texts.select("query_id", "text").unionByName(more), p, ["name", "display"]).select("query_id", "building")


@query("reference_forms", r"""
WITH t AS (SELECT 's' || CAST(ord AS STRING) AS id, building || ' - ' || room AS t, building FROM spaces WHERE room IS NOT NULL UNION ALL SELECT 'n' || CAST(ord AS STRING), name, building FROM spaces WHERE name IS NOT NULL)
SELECT id, COALESCE(NULLIF(REGEXP_EXTRACT(UPPER(t), '^([A-Z]{1,6}\d{0,3})[-\s]+(.+)$', 1), ''), building) AS building,
 COALESCE(NULLIF(TRIM(REGEXP_EXTRACT(t, '^([A-Za-z]{1,6}\d{0,3})[-\s]+(.+)$', 2)), ''), t) AS room,
 NULLIF(REGEXP_EXTRACT(UPPER(t), '^([A-Z]+\d*)[-\s]+(\S.*)$', 1), '') AS strict_building,
 NULLIF(REGEXP_EXTRACT(UPPER(t), '^([A-Z]{1,4}\d{0,2})[-\s]+([A-Z0-9]+)$', 2), '') AS free_room FROM t""", ("spaces",))
def reference_forms(spark, sf):
    s = B.spaces(spark, sf)
    t = s.where("room IS NOT NULL").select(F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), F.concat_ws(" - ", "building", "room").alias("t"), "building").unionByName(
        s.where("name IS NOT NULL").select(F.concat(F.lit("n"), F.col("ord").cast("string")), F.col("name"), "building").toDF("id", "t", "building"))
    ref = text.parse_ref("t", "building")
    return t.select("id", ref["building"].alias("building"), ref["room"].alias("room"), text.strict_ref("t")["building"].alias("strict_building"),
                    text.free_ref("t")["room"].alias("free_room"))


# -- timetable ----------------------------------------------------------------

def classes(spark, sf):
    return D.view(spark, sf, "classes").select("user_id", "ord", "title", "building", "room", F.lit(None).cast("string").alias("floor"), clock.days_of_bits("day_bits").alias("days"),
                                               clock.hhmm("start_min").alias("start_time"), clock.hhmm("end_min").alias("end_time"))


def ticks(spark, sf):
    return D.view(spark, sf, "ticks")


MEET = """
bits AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 32), (6, 64)) AS v(day, bit)),
meet AS (SELECT c.*, b.day FROM classes c JOIN bits b ON CAST(FLOOR(c.day_bits / b.bit) AS BIGINT) % 2 = 1),
at_min AS (SELECT tick_id, user_id, DAYOFWEEK(ts) AS d, EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS m FROM ticks)"""


@query("now_next", f"""WITH {MEET},
cur AS (SELECT t.tick_id, MAX(m.ord) AS current FROM at_min t JOIN meet m ON m.user_id = t.user_id AND m.day = t.d AND t.m >= m.start_min AND t.m < m.end_min GROUP BY 1),
nx AS (SELECT t.tick_id, m.ord, ((m.day - t.d) * 1440 + m.start_min - t.m + 10080) % 10080 AS delta FROM at_min t JOIN meet m ON m.user_id = t.user_id),
best AS (SELECT tick_id, ord AS next, delta FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tick_id ORDER BY delta, ord) AS rn FROM nx WHERE delta > 0) WHERE rn = 1)
SELECT t.tick_id, COALESCE(CAST(c.current AS STRING), '') AS current, COALESCE(CAST(b.next AS STRING), '') AS next, COALESCE(CAST(b.delta AS STRING), '') AS in_minutes
FROM at_min t LEFT JOIN cur c ON c.tick_id = t.tick_id LEFT JOIN best b ON b.tick_id = t.tick_id""", ("classes", "ticks"))
def now_next(spark, sf):
    n = T.now_and_next(ticks(spark, sf), classes(spark, sf))
    return n.select("tick_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("current", "next", "in_minutes")])


@query("due_now", f"""WITH {MEET},
c AS (SELECT t.tick_id, m.ord, CASE WHEN t.m >= m.start_min AND t.m < m.end_min THEN 0 ELSE 1 END AS later, m.start_min - t.m AS until
  FROM at_min t JOIN meet m ON m.user_id = t.user_id AND m.day = t.d WHERE (t.m >= m.start_min AND t.m < m.end_min) OR (m.start_min > t.m AND m.start_min - t.m <= 30))
SELECT tick_id, ord AS due, CASE WHEN later = 0 THEN 'now' ELSE 'soon' END AS status, CASE WHEN later = 0 THEN '' ELSE CAST(until AS STRING) END AS until FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY tick_id ORDER BY later, CASE WHEN later = 1 THEN until END, ord) AS rn FROM c) WHERE rn = 1""", ("classes", "ticks"))
def due_now(spark, sf):
    d = T.due_now(ticks(spark, sf), classes(spark, sf))
    return d.select("tick_id", "due", "status", F.coalesce(F.col("until").cast("string"), F.lit("")).alias("until"))


@query("week_view", f"""WITH {MEET} SELECT user_id, ord, CAST((day + 6) % 7 AS BIGINT) AS col, CAST(start_min AS BIGINT) AS start_min,
 CAST(CASE WHEN FLOOR(start_min / 60) % 12 = 0 THEN 12 ELSE CAST(FLOOR(start_min / 60) AS BIGINT) % 12 END AS STRING) || ':' || LPAD(CAST(start_min % 60 AS STRING), 2, '0') || CASE WHEN start_min < 720 THEN 'am' ELSE 'pm' END AS starts
FROM meet""", ("classes", "ticks"))
def week_view(spark, sf):
    w = T.week_view(classes(spark, sf))
    return w.select("user_id", "ord", F.col("col").cast("bigint").alias("col"), F.col("start_min").cast("bigint").alias("start_min"), "starts")


@query("timetable_order", """SELECT user_id, ord, CASE WHEN day_bits = 0 THEN 'NO_DAY' ELSE '' END AS error,
 LPAD(CAST(CAST(FLOOR(start_min / 60) AS BIGINT) AS STRING), 2, '0') || ':' || LPAD(CAST(start_min % 60 AS STRING), 2, '0') AS start_time, UPPER(building) AS building FROM classes""", ("classes",))
def timetable_order(spark, sf):
    c = T.clean_classes(T.check_classes(classes(spark, sf)))
    return T.timetable_order(c).select("user_id", "ord", F.coalesce("error", F.lit("")).alias("error"), "start_time", "building")


# -- activity -----------------------------------------------------------------

def activity(spark, sf):
    return D.view(spark, sf, "activity")


def touches(spark, sf):
    return activity(spark, sf).select("user_id", "event_id", clock.micros("ts").alias("t"))


FAV = """
l AS (SELECT user_id, node_id, MAX(CASE WHEN op = 'add' THEN event_id END) AS a, MAX(CASE WHEN op = 'use' THEN event_id END) AS u, MAX(CASE WHEN op = 'remove' THEN event_id END) AS r
  FROM activity GROUP BY 1, 2),
fav AS (SELECT l.user_id, l.node_id, e.ts AS added_at, f.ts AS last_used FROM l JOIN events e ON e.event_id = l.a JOIN events f ON f.event_id = GREATEST(l.a, COALESCE(l.u, -1))
  WHERE l.a IS NOT NULL AND l.a > COALESCE(l.r, -1))"""


@query("favorite_state", f"WITH {FAV} SELECT user_id, node_id, EPOCH_US(added_at) AS added_us, EPOCH_US(last_used) AS used_us FROM fav", ("activity",))
def favorite_state(spark, sf):
    f = A.favourite_state(activity(spark, sf))
    return f.select("user_id", "node_id", clock.micros("added_at").alias("added_us"), clock.micros("last_used").alias("used_us"))


@query("favorites_topk", f"WITH {FAV} SELECT user_id, node_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY last_used DESC, node_id) AS rank FROM fav) WHERE rank <= 3", ("activity",))
def favorites_topk(spark, sf):
    return A.top_favourites(A.favourite_state(activity(spark, sf)), 3).select("user_id", "node_id", "rank")


@query("favorite_markers", f"""WITH {FAV}, m AS (SELECT f.*, f.node_id IN ('n3', 'n5') AS is_room FROM fav f)
SELECT m.user_id, m.node_id, CASE WHEN is_room THEN -1.5 ELSE n.lng END AS lng, CASE WHEN is_room THEN 2.25 ELSE n.lat END AS lat, STRFTIME(m.added_at, '%Y-%m-%d') AS label
FROM m LEFT JOIN nodes n ON n.nid = m.node_id WHERE is_room OR n.nid IS NOT NULL""", ("activity", "nodes"))
def favorite_markers(spark, sf):
    f = A.favourite_state(activity(spark, sf))
    room = F.col("node_id").isin("n3", "n5")
    meta = F.when(room, F.create_map(*[F.lit(v) for v in ("kind", "room", "lng", "-1.5", "lat", "2.25", "building", "B1", "room", "100")])).otherwise(
        F.create_map().cast("map<string,string>"))
    f = f.withColumn("node_meta", meta).withColumn("label", F.lit(None).cast("string"))
    return A.favourite_markers(f, B.nodes(spark, sf))


@query("recents", """
WITH v AS (SELECT * FROM activity WHERE room <> building AND NOT STARTS_WITH(room, building || '-')),
o AS (SELECT user_id, building, room, MAX(event_id) AS newest, ARG_MAX(floor, event_id) FILTER (WHERE floor IS NOT NULL) AS floor FROM v GROUP BY 1, 2, 3)
SELECT user_id, CAST(rank AS BIGINT) AS rank, building, COALESCE(floor, '') AS floor, room FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY newest DESC) AS rank FROM o) WHERE rank <= 8""", ("activity",))
def recents(spark, sf):
    r = A.recents(activity(spark, sf))
    return r.select("user_id", "rank", "building", F.coalesce("floor", F.lit("")).alias("floor"), "room")


GAP = 12 * 3600 * 1_000_000


@query("sessions", f"""
WITH e AS (SELECT user_id, EPOCH_US(ts) AS t, event_id FROM activity), p AS (SELECT *, LAG(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM e),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL OR t - prev >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS sid FROM p)
SELECT user_id, MIN(t) AS start, MAX(t) AS last, COUNT(*) AS events FROM s GROUP BY user_id, sid""", ("activity",))
def sessions(spark, sf):
    return A.sessions(touches(spark, sf), GAP)


@query("touch_throttle", f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, EPOCH_US(ts) AS t FROM activity),
chain AS (SELECT user_id, MIN(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT c.user_id, (SELECT MIN(e.t) FROM e WHERE e.user_id = c.user_id AND e.t >= c.t + {GAP}) FROM chain c WHERE c.t IS NOT NULL)
SELECT user_id, t FROM chain WHERE t IS NOT NULL""", ("activity",))
def touch_throttle(spark, sf):
    return A.throttle(touches(spark, sf), GAP)


@query("status_windows", """
SELECT EPOCH_US(DATE_TRUNC('day', ts)) AS day_us, CAST(2 + CAST(FLOOR(value * 100) AS BIGINT) % 4 AS STRING) || 'xx' AS class, COUNT(*) AS requests FROM events GROUP BY 1, 2""", ())
def status_windows(spark, sf):
    e = D.table(spark, sf, "events")
    e = e.withColumn("status", (F.lit(2) + F.floor(F.col("value") * 100) % 4) * 100)
    e = e.withColumn("day_us", F.floor(clock.micros("ts") / F.lit(86_400_000_000)) * 86_400_000_000)
    return A.status_counts(e, by=["day_us"])


@query("status_classes", """
SELECT CAST(2 + CAST(FLOOR(value * 100) AS BIGINT) % 4 AS STRING) || 'xx' AS class, COUNT(*) AS requests FROM events GROUP BY 1""", ())
def status_classes(spark, sf):
    e = D.table(spark, sf, "events")
    return A.status_counts(e.withColumn("status", (F.lit(2) + F.floor(F.col("value") * 100) % 4) * 100))


@query("critical_log_lines", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'Auth failed for ' || user_id ELSE 'FIREBASE quota at ' || event_type END AS message FROM events WHERE event_type = 'error' AND user_id % 3 < 2""", ())
def critical_log_lines(spark, sf):
    """Log lines that need attention, of lines made up of each event; a third of the errors and all other events do not."""
    e = D.table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    line = (F.when(F.col("event_type") != "error", F.concat(F.lit("ok "), user)).when(F.col("user_id") % 3 == 0, F.concat(F.lit("Auth failed for "), user))
            .when(F.col("user_id") % 3 == 1, F.concat(F.lit("FIREBASE quota at "), "event_type")).otherwise("timeout"))
    return e.select("event_id", line.alias("message")).where(A.is_critical(F.col("message")))


@query("critical_events", """SELECT doc_id FROM documents WHERE LOWER(text) LIKE '%firebase%' OR LOWER(text) LIKE '%auth%'""", ())
def critical_events(spark, sf):
    return D.table(spark, sf, "documents").where(A.is_critical(F.col("text"))).select("doc_id")


@query("expired_sessions", f"""
WITH l AS (SELECT user_id, MAX(EPOCH_US(ts)) AS t FROM activity GROUP BY user_id), n AS (SELECT MAX(t) AS now FROM l)
SELECT user_id FROM l, n WHERE t + {GAP} < now""", ("activity",))
def expired_sessions(spark, sf):
    last = touches(spark, sf).groupBy("user_id").agg(F.max("t").alias("t")).withColumn("expires", F.col("t") + GAP)
    return A.expired(last, last.agg(F.max("t")).scalar()).select("user_id")
