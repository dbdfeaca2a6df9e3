"""The registered SQL functions called from SQL, beside plain formulas."""

from placegraph import datasets as D
from placegraph import sqlfunctions
from placegraph.catalog.base import query


def _over(spark, sf, view: str, sql: str):
    """``sql`` over one derived view, with the library's SQL functions in the session."""
    sqlfunctions.register(spark)
    rows = D.view(spark, sf, view)
    # A row is small and costs much: a file of few splits would leave most cores idle, and sizes would draw tasks together again.
    return spark.sql(sql, v=rows.repartition(4 * spark.sparkContext.defaultParallelism, "ord"))


RECT = "CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1"


@query("sql_ring_functions", f"""
WITH s AS (SELECT ord, {RECT} FROM spaces), t AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM s)
SELECT ord, w * h AS area, (3 * x0 + 2 * x1) / 5 AS mx, (3 * y0 + 2 * y1) / 5 AS my, x1 AS bx, TRUE AS held, FALSE AS beyond, TRUE AS holds, ord % 2 = 0 AS within, 50.0::DOUBLE AS away,
  0.0::DOUBLE AS inside_distance, LEAST(w, h) / 2 AS edge, ROUND(w * h / 4, 6) AS common, ROUND(4 * w * h, 4) AS scaled, ROUND(6 * w * h, 4) AS stretched, CAST(5 AS BIGINT) AS corners, 5.0::DOUBLE AS segment,
  ROUND((ord * 37 % 720 + 45) % 90 - 45, 6)::DOUBLE AS folded, ROUND((ord * 37 % 720 + 180) % 360 - 180, 6)::DOUBLE AS turned, ROUND((ord % 100) / 100.0, 9)::DOUBLE AS u, ROUND((ord % 80) / 80.0, 9)::DOUBLE AS v
FROM t""", ("spaces",))
def sql_ring_functions(spark, sf):
    return _over(spark, sf, "spaces", f"""
WITH s AS (SELECT ord, {RECT} FROM {{v}}), t AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, pg_rectangle(x0, y0, x1, y1) AS ring FROM s),
p AS (SELECT *, pg_plan_to_world((ord % 100) / 100.0D, (ord % 80) / 80.0D, -123.0D, 49.25D, 80.0D, CAST(ord % 360 AS DOUBLE), 0.75D) AS world FROM t),
q AS (SELECT *, pg_world_to_plan(world.x, world.y, -123.0D, 49.25D, 80.0D, CAST(ord % 360 AS DOUBLE), 0.75D) AS plan FROM p)
SELECT ord, pg_area(ring) AS area, pg_centre(ring).x AS mx, pg_centre(ring).y AS my, pg_box(ring).x1 AS bx, pg_contains(ring, x0 + w / 2, y0 + h / 3) AS held, pg_contains(ring, x1 + 1, y0) AS beyond,
  pg_holds(pg_rectangle(x0 - 1, y0 - 1, x1 + 1, y1 + 1), ring) AS holds, pg_holds(pg_rectangle(x0 - 1, y0 - 1, x1 + 1 - 2 * (ord % 2), y1 + 1), ring) AS within, pg_distance_to(ring, x1 + 30, y1 + 40) AS away,
  pg_distance_to(ring, x0 + w / 2, y0 + h / 3) AS inside_distance, pg_edge_distance(ring, x0 + w / 2, y0 + h / 2) AS edge, ROUND(pg_common_area(ring, pg_translate(ring, w / 2, h / 2)), 6) AS common,
  ROUND(pg_area(pg_similarity(ring, 2.0D, 0.5D, 10.0D, 20.0D)), 4) AS scaled, ROUND(pg_area(pg_stretch(ring, 2.0D, 3.0D, 90.0D)), 4) AS stretched, CAST(SIZE(pg_close(SLICE(ring, 1, 4))) AS BIGINT) AS corners,
  pg_segment_distance(x0, y0 + 5, x0 - 10, y0, x0 + 10, y0) AS segment, ROUND(pg_fold_angle(CAST(ord * 37 % 720 AS DOUBLE)), 6) AS folded, ROUND(pg_turn(CAST(ord * 37 % 720 AS DOUBLE)), 6) AS turned,
  ROUND(plan.u, 9) AS u, ROUND(plan.v, 9) AS v FROM q""")


HAV = "12742000 * ASIN(SQRT(POWER(SIN(RADIANS({b} - {a}) / 2), 2) + COS(RADIANS({a})) * COS(RADIANS({b})) * POWER(SIN(RADIANS({d} - {c}) / 2), 2)))"


@query("sql_text_functions", rf"""
WITH n AS (SELECT ord, COALESCE(building, '') AS b, COALESCE(floor, '') AS f, COALESCE(room, '') AS r, COALESCE(name, '') AS nm, building, floor, room, name, lng, lat FROM nodes),
p AS (SELECT *, REGEXP_MATCHES(nm, '^[A-Za-z]{{1,6}}\d{{0,3}}[-\s]+.+$') AS coded FROM n)
SELECT ord, UPPER(nm) AS place, CASE WHEN coded THEN UPPER(REGEXP_EXTRACT(nm, '^([A-Za-z]{{1,6}}\d{{0,3}})[-\s]+(.+)$', 1)) ELSE UPPER(b) END AS ref_building,
  CASE WHEN coded THEN REGEXP_EXTRACT(nm, '^([A-Za-z]{{1,6}}\d{{0,3}})[-\s]+(.+)$', 2) ELSE nm END AS ref_room, CASE WHEN b <> '' AND STARTS_WITH(nm, b || '-') THEN SUBSTR(nm, LENGTH(b) + 2) ELSE nm END AS bare,
  CASE WHEN b = '' THEN 'outdoors' ELSE b END || CASE WHEN f = '' THEN '' ELSE ' floor ' || f END || CASE WHEN r = '' THEN '' ELSE ' · ' || r END AS at_where,
  CASE WHEN b <> '' AND r <> '' THEN b || ' · ' || r WHEN b <> '' AND f <> '' THEN b || ' · Floor ' || f WHEN b <> '' THEN b WHEN r <> '' THEN r ELSE 'Selected point' END AS label,
  'ROOM:' || b || '-' || f || '-' || r AS favourite, COALESCE(NULLIF(nm, ''), NULLIF(r, ''), 'none') AS first, 'b' || LPAD(CAST(ord AS VARCHAR), 19, '0') || 'x' AS natural, CAST(ord % 50 AS BIGINT) AS floor_n,
  LENGTH(nm) BETWEEN 1 AND 3 AND REGEXP_MATCHES(nm, '^[0-9]+$') AS floor_code, CASE WHEN b = '' THEN FALSE ELSE LENGTH(b) <= 8 END AS sheet_code,
  CASE WHEN LENGTH(CAST(ord AS VARCHAR) || ' words of the asker that go on and on without an end in sight') > 60 THEN LEFT(CAST(ord AS VARCHAR) || ' words of the asker that go on and on without an end in sight', 57) || '...'
    ELSE CAST(ord AS VARCHAR) || ' words of the asker that go on and on without an end in sight' END AS quoted, CAST(2 AS BIGINT) AS parts, CAST(3 AS BIGINT) AS items,
  CASE WHEN (ord * 7) // 60 % 12 = 0 THEN '12' ELSE CAST((ord * 7 % 1440) // 60 % 12 AS VARCHAR) END || ':' || LPAD(CAST(ord * 7 % 60 AS VARCHAR), 2, '0') || CASE WHEN ord * 7 % 1440 < 720 THEN 'am' ELSE 'pm' END AS clock,
  CAST(ord * 7 % 1440 AS BIGINT) AS minutes, CAST(BIT_COUNT(CAST(ord % 128 AS INT)) AS BIGINT) AS days,
  ROUND({HAV.format(a='lat', b='(lat + 0.001)', c='lng', d='(lng + 0.002)')}, 3) AS metres, ROUND(SQRT(POWER(0.002 * COS(RADIANS(lat + 0.0005)), 2) + POWER(0.001, 2)) * PI() * 6378137.0 / 180, 3) AS flat
FROM p""", ("nodes",))
def sql_text_functions(spark, sf):
    return _over(spark, sf, "nodes", """
SELECT ord, pg_place_name(name) AS place, pg_parse_ref(name, building).building AS ref_building, pg_parse_ref(name, building).room AS ref_room, pg_bare_room(building, name) AS bare, pg_where_is(building, floor, room) AS at_where,
  pg_room_label(building, floor, room) AS label, pg_favourite_id(building, floor, room) AS favourite, pg_first_filled(pg_first_filled(name, room), 'none') AS first, pg_natural_key(concat('B', ord, 'X')) AS natural,
  pg_floor_key(concat(ord % 50, ' east')).n AS floor_n, pg_is_floor_code(COALESCE(name, '')) AS floor_code, pg_is_sheet_code(building) AS sheet_code,
  pg_quoted(concat(' ', ord, '  words of the asker that go on and on without an end in sight')) AS quoted, CAST(SIZE(pg_lines(concat('a', ord, ' ;; b'))) AS BIGINT) AS parts, CAST(SIZE(pg_comma_list('x, y,,z')) AS BIGINT) AS items,
  pg_twelve_hour(pg_hhmm(CAST(ord * 7 % 1440 AS INT))) AS clock, CAST(pg_minutes_of(pg_hhmm(CAST(ord * 7 % 1440 AS INT))) AS BIGINT) AS minutes, CAST(SIZE(pg_days_of_bits(CAST(ord % 128 AS INT))) AS BIGINT) AS days,
  ROUND(pg_distance_m(lng, lat, lng + 0.002D, lat + 0.001D), 3) AS metres, ROUND(pg_flat_m(lng, lat, lng + 0.002D, lat + 0.001D), 3) AS flat FROM {v}""")
