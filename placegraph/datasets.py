"""Places, networks, timetables and activity derived from the star-schema tables.

Each view is one SELECT in the SQL both Spark and a plain SQL engine accept:
integer arithmetic, one division to double, CASE and joins. Every view reads all
rows of its table, so the derived data grows with the tables. A campus is a
square of 10 007 by 10 007 micro-degrees holding 1 500 nodes, 100 outlines and
2 000 spaces; more data means more campuses, not denser ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Micro-degree offset of a campus, and the change to degrees.
_X0 = "(({c} % 5000) * 20000)"
_Y0 = "(CAST(FLOOR({c} / 5000) AS BIGINT) * 20000)"


def _x0(c: str) -> str:
    return _X0.format(c=c)


def _y0(c: str) -> str:
    return _Y0.format(c=c)


def lng_sql(x: str) -> str:
    return f"(CAST({x} - 123000000 AS DOUBLE) / 1e6)"


def lat_sql(y: str) -> str:
    return f"(CAST({y} + 20000000 AS DOUBLE) / 1e6)"


VIEWS: dict[str, str] = {}

VIEWS["node_base"] = f"""
SELECT c_custkey AS k, CAST(FLOOR(c_custkey / 1500) AS BIGINT) AS campus, c_nationkey, c_mktsegment,
       {_x0("CAST(FLOOR(c_custkey / 1500) AS BIGINT)")} + (c_custkey * 7919) % 10007 AS x,
       {_y0("CAST(FLOOR(c_custkey / 1500) AS BIGINT)")} + (c_custkey * 104729) % 10007 AS y
FROM customer"""

VIEWS["nodes"] = f"""
SELECT k AS ord, 'n' || CAST(k AS STRING) AS nid,
       CASE WHEN k % 7 = 0 THEN NULL
            ELSE 'B' || CAST(campus * 25 + c_nationkey AS STRING) END AS building,
       CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN NULL ELSE CAST(1 + k % 4 AS STRING) END AS floor,
       CASE WHEN k % 3 = 0 THEN CAST((1 + k % 4) * 1000 + (k * 13) % 40 AS STRING) END AS room,
       CASE WHEN k % 5 = 3 THEN 'B' || CAST(campus * 25 + c_nationkey AS STRING) || '-'
                 || CAST((1 + k % 4) * 1000 + (k * 17) % 40 AS STRING)
            WHEN k % 5 = 4 AND k % 7 = 0 THEN 'OUT-' || CAST(1 + k % 90 AS STRING)
            WHEN k % 5 = 4 THEN 'B' || CAST(campus * 25 + c_nationkey AS STRING) || '-'
                 || CAST(1 + k % 4 AS STRING) || 'H' || CAST(1 + k % 9 AS STRING) END AS name,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'room' WHEN 'FURNITURE' THEN 'hallway'
            WHEN 'MACHINERY' THEN 'stairs' WHEN 'BUILDING' THEN 'elevator' ELSE 'service' END AS space,
       {lng_sql("x")} AS lng, {lat_sql("y")} AS lat
FROM node_base"""

VIEWS["link_base"] = """
SELECT o_orderkey, o_custkey AS ka, o_custkey % 1500 AS i, o_custkey - o_custkey % 1500 AS base,
       CAST(FLOOR(SQRT(CASE WHEN o_custkey % 1500 < 500 THEN 0 ELSE o_custkey % 1500 - 500 END)) AS BIGINT) AS c
FROM orders"""

VIEWS["links"] = """
SELECT o_orderkey AS ord, 'n' || CAST(ka AS STRING) AS a,
       CASE WHEN o_orderkey % 400 = 0 THEN 'n-1'
            WHEN o_orderkey % 60 = 7 AND base > 0 AND i < 500
              THEN 'n' || CAST(CAST(FLOOR(base / 3000) AS BIGINT) * 1500 + i AS STRING)
            WHEN i < 500 THEN 'n' || CAST(base + (i + CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7
                                               WHEN 2 THEN 43 ELSE 171 END) % 500 AS STRING)
            ELSE 'n' || CAST(base + 500 + c * c
                 + (i - 500 - c * c + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 11 END)
                   % LEAST(2 * c + 1, 1000 - c * c) AS STRING) END AS b,
       CASE WHEN o_orderkey % 16 < 4 THEN NULL
            ELSE CAST(10 + (o_orderkey * 37) % 2000 AS DOUBLE) / 1e1 END AS metres
FROM link_base"""

VIEWS["space_base"] = f"""
SELECT p_partkey AS k, CAST(FLOOR(p_partkey / 2000) AS BIGINT) AS campus, p_name, p_type, p_size,
       CAST(SUBSTR(p_brand, 7) AS BIGINT) AS brand,
       {_x0("CAST(FLOOR(p_partkey / 2000) AS BIGINT)")} + (p_partkey * 6007) % 9001 AS x0,
       {_y0("CAST(FLOOR(p_partkey / 2000) AS BIGINT)")} + (p_partkey * 3571) % 9001 AS y0,
       300 + (p_partkey % 7) * 250 AS w, 300 + (p_partkey % 5) * 300 AS h
FROM part"""

# Rectangles on the micro-degree lattice, with the sheet they were traced on.
VIEWS["spaces"] = """
SELECT k AS ord, 'B' || CAST(campus * 25 + brand - 1 AS STRING) AS building,
       CAST(1 + p_size % 4 AS STRING) AS floor,
       'B' || CAST(campus * 25 + brand - 1 AS STRING) || '-Floor' || CAST(1 + p_size % 4 AS STRING) AS sheet,
       CASE WHEN k % 10 = 0 THEN NULL ELSE CAST((1 + p_size % 4) * 1000 + k % 40 AS STRING) END AS room,
       CASE WHEN k % 97 = 0 THEN 'building' WHEN p_type = 'ECONOMY' THEN 'room' WHEN p_type = 'SMALL' THEN NULL
            WHEN p_type = 'MEDIUM' THEN 'corridor' WHEN p_type = 'LARGE' THEN 'washroom'
            WHEN p_type = 'PROMO' AND k % 3 = 0 THEN 'shaft' WHEN p_type = 'PROMO' THEN 'stairs'
            WHEN k % 4 = 0 THEN 'elevator' WHEN k % 4 = 1 THEN 'mech' WHEN k % 4 = 2 THEN 'lounge'
            ELSE 'room' END AS type,
       CASE WHEN k % 6 = 0 THEN NULL WHEN k % 23 = 0 THEN p_name || ' lift' WHEN k % 19 = 0 THEN 'Restroom ' || p_name
            ELSE p_name END AS name,
       x0, y0, x0 + w AS x1, y0 + h AS y1
FROM space_base"""

VIEWS["place_base"] = f"""
SELECT s_suppkey AS k, CAST(FLOOR(s_suppkey / 100) AS BIGINT) AS campus, s_nationkey, s_name,
       {_x0("CAST(FLOOR(s_suppkey / 100) AS BIGINT)")} + (s_suppkey * 6143) % 10007 AS cx,
       {_y0("CAST(FLOOR(s_suppkey / 100) AS BIGINT)")} + (s_suppkey * 7877) % 10007 AS cy,
       150 + (s_suppkey % 3) * 100 AS hw, 120 + (s_suppkey % 4) * 60 AS hh
FROM supplier"""

# Hexagon outlines: buildings before car parks, several pieces may share a name.
VIEWS["places"] = """
SELECT k AS ord, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS prio,
       CASE WHEN k % 5 = 0 THEN 'parking' ELSE 'building' END AS kind,
       CASE WHEN k % 5 = 0 THEN 'LOT ' || CAST(CAST(FLOOR(k / 10) AS BIGINT) AS STRING)
            ELSE 'B' || CAST(campus * 25 + s_nationkey AS STRING) END AS name,
       CASE WHEN k % 5 = 0 THEN NULL ELSE 'Hall ' || CAST(campus * 25 + s_nationkey AS STRING) END AS display,
       cx, cy, hw, hh
FROM place_base"""

VIEWS["place_vertices"] = f"""
SELECT p.ord, p.prio, p.kind, p.name, p.display, v.seq, {lng_sql("p.cx + CAST(p.hw * v.dx AS BIGINT)")} AS x,
       {lat_sql("p.cy + CAST(p.hh * v.dy AS BIGINT)")} AS y
FROM places p CROSS JOIN (VALUES (0, -2, 0), (1, -1, -2), (2, 1, -2), (3, 2, 0), (4, 1, 2), (5, -1, 2)) AS v(seq, dx, dy)"""

VIEWS["place_edges"] = """
SELECT a.ord, a.prio, a.name, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by
FROM place_vertices a JOIN place_vertices b ON a.ord = b.ord AND b.seq = (a.seq + 1) % 6"""

VIEWS["classes"] = """
SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, o_orderkey AS ord,
       'Course ' || CAST(o_orderkey % 500 AS STRING) AS title,
       'b' || CAST(o_custkey % 25 AS STRING) AS building, CAST(1000 + o_orderkey % 40 AS STRING) AS room,
       (o_orderkey * 37) % 128 AS day_bits,
       480 + ((o_orderkey * 35) % 120) * 5 AS start_min,
       480 + ((o_orderkey * 35) % 120) * 5 + 50 + (o_orderkey % 3) * 30 AS end_min
FROM orders"""

VIEWS["ticks"] = """
SELECT event_id AS tick_id, 'u' || CAST(user_id AS STRING) AS user_id, ts FROM events"""

VIEWS["activity"] = """
SELECT event_id, ts, 'u' || CAST(user_id AS STRING) AS user_id,
       CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'view' WHEN 'click' THEN 'use'
            WHEN 'error' THEN 'touch' ELSE 'remove' END AS op,
       'n' || CAST((event_id * 31) % 17 AS STRING) AS node_id,
       'B' || CAST(event_id % 5 AS STRING) AS building,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1 + (event_id * 7) % 4 AS STRING) END AS floor,
       CASE WHEN event_id % 41 = 0 THEN 'B' || CAST(event_id % 5 AS STRING) || '-' || CAST(event_id % 9 AS STRING)
            WHEN event_id % 43 = 0 THEN 'B' || CAST(event_id % 5 AS STRING)
            ELSE CAST(1000 + (event_id * 7) % 12 AS STRING) END AS room
FROM events"""

# One walk request per supplier: points, rooms, bare numbers, places and mistakes.
VIEWS["route_requests"] = f"""
SELECT p.k AS query_id, 'B' || CAST(p.campus * 25 + p.s_nationkey AS STRING) AS building,
       CASE p.k % 5 WHEN 0 THEN NULL
            WHEN 1 THEN 'B' || CAST(p.campus * 25 + c.c_nationkey AS STRING) || '-' || CAST((1 + c.c_custkey % 4) * 1000 + (c.c_custkey * 13) % 40 AS STRING)
            WHEN 2 THEN 'LOT ' || CAST(CAST(FLOOR(p.k / 10) AS BIGINT) AS STRING)
            WHEN 3 THEN 'b' || CAST(p.campus * 25 + c.c_nationkey AS STRING) || ' ' || CAST((1 + c.c_custkey % 4) * 1000 + (c.c_custkey * 13) % 40 AS STRING)
            ELSE 'B' || CAST(p.campus * 25 + p.s_nationkey AS STRING) END AS start_ref,
       CASE WHEN p.k % 5 = 0 THEN {lng_sql("p.cx")} END AS start_lng,
       CASE WHEN p.k % 5 = 0 THEN {lat_sql("p.cy")} END AS start_lat,
       CASE p.k % 9 WHEN 0 THEN '99999'
            WHEN 1 THEN 'B' || CAST(p.campus * 25 + p.s_nationkey AS STRING)
            WHEN 2 THEN 'Hall ' || CAST(p.campus * 25 + (p.s_nationkey + 3) % 25 AS STRING)
            WHEN 3 THEN ''
            ELSE 'B' || CAST(p.campus * 25 + d.c_nationkey AS STRING) || '-' || CAST((1 + d.c_custkey % 4) * 1000 + (d.c_custkey * 13) % 40 AS STRING) END AS goal_ref
FROM place_base p
LEFT JOIN customer c ON c.c_custkey = p.campus * 1500 + ((p.k * 37) % 160) * 3
LEFT JOIN customer d ON d.c_custkey = p.campus * 1500 + ((p.k * 53 + 11) % 160) * 3"""


# Features of a network document, and the document after a round of edits.
VIEWS["features_before"] = """
SELECT ord, 'node' AS type, nid, CAST(NULL AS STRING) AS a, CAST(NULL AS STRING) AS b, building, floor, lng, lat, CAST(NULL AS DOUBLE) AS metres FROM nodes
UNION ALL SELECT 1000000000000 + ord, 'path', CAST(NULL AS STRING), a, b, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), metres FROM links"""

VIEWS["features_after"] = """
SELECT ord, type, nid, a, b, building, floor, CASE WHEN type = 'node' AND ord % 10 = 1 THEN lng + 0.0001e0 ELSE lng END AS lng, lat,
       CASE WHEN type = 'path' AND ord % 9 = 0 THEN 7.5e0 ELSE metres END AS metres
FROM features_before WHERE NOT (type = 'node' AND ord % 10 = 0)
UNION ALL SELECT 2000000000000 + k, 'node', 'm' || CAST(k AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       CAST(x0 - 123000000 AS DOUBLE) / 1e6, CAST(y0 + 20000000 AS DOUBLE) / 1e6, CAST(NULL AS DOUBLE) FROM space_base"""

# Points of stored routes: one route per customer, one point per order (step is added by order).
VIEWS["route_points_raw"] = f"""
SELECT o_custkey AS query_id, o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'anchor' ELSE 'node' END AS kind,
       CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE 'B' || CAST((o_custkey + CAST(FLOOR(o_orderkey / 4000) AS BIGINT)) % 3 AS STRING) END AS building,
       CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE CAST(1 + CAST(FLOOR(o_orderkey / 1000) AS BIGINT) % 2 AS STRING) END AS floor,
       CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 4 < 3 THEN NULL ELSE CAST(100 + CAST(FLOOR(o_orderkey / 2000) AS BIGINT) AS STRING) END AS room,
       CASE WHEN o_orderkey % 6 = 5 THEN 'Name ' || CAST(o_orderkey % 3 AS STRING) END AS name,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 8 = 3 THEN 'stairs' WHEN o_orderkey % 8 = 6 THEN 'elevator' ELSE 'hallway' END AS space,
       {lng_sql("(o_orderkey * 7919) % 10007")} AS lng, {lat_sql("(o_orderkey * 104729) % 10007")} AS lat
FROM orders"""


# Ten by ten cell floors, three to a building, one cell per order.
VIEWS["cells"] = """
SELECT 'R' || CAST(CAST(FLOOR(o_orderkey / 300) AS BIGINT) AS STRING) AS building, CAST(1 + CAST(FLOOR(o_orderkey / 100) AS BIGINT) % 3 AS INT) AS floor,
       CAST(FLOOR((o_orderkey % 100) / 10) AS INT) AS r, CAST(o_orderkey % 10 AS INT) AS c,
       (o_orderkey * 7919 + CAST(FLOOR(o_orderkey / 100) AS BIGINT) * 31) % 11 < 3 AND o_orderkey % 100 NOT IN (22, 50, 59) AS blocked
FROM orders"""

VIEWS["cell_requests"] = """
SELECT s_suppkey AS query_id, 'R' || CAST(CAST(FLOOR(s_suppkey / 2) AS BIGINT) AS STRING) AS building, CAST(1 + s_suppkey % 3 AS INT) AS floor,
       CAST((s_suppkey * 3) % 10 AS INT) AS r, CAST((s_suppkey * 7) % 10 AS INT) AS c,
       'R' || CAST(CAST(FLOOR(s_suppkey / 2) AS BIGINT) + CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS STRING) AS to_building, CAST(1 + (s_suppkey + 1) % 3 AS INT) AS to_floor,
       CAST((s_suppkey * 5 + 4) % 10 AS INT) AS to_r, CAST((s_suppkey * 11 + 3) % 10 AS INT) AS to_c
FROM supplier"""

# Labels as read off a plan: numbers with look-alike letters, room words, shaft words.
VIEWS["label_reads"] = """
SELECT ord, building, floor, CASE ord % 9 WHEN 0 THEN 'STAIR ' WHEN 1 THEN 'ELEV ' WHEN 2 THEN 'SSIAIR ' ELSE '' END ||
       CASE WHEN ord % 5 = 0 THEN REPLACE(n, '0', 'O') WHEN ord % 5 = 1 THEN REPLACE(n, '1', 'I') WHEN ord % 13 = 2 THEN SUBSTR(n, 2) WHEN ord % 13 = 3 THEN n || '7' WHEN ord % 17 = 4 THEN '5' || SUBSTR(n, 2) ELSE n END AS raw,
       CASE ord % 9 WHEN 0 THEN 'stairs' WHEN 1 THEN 'elevator' ELSE 'room' END AS kind, ord % 3 <> 0 AS anchor, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area
FROM (SELECT *, floor || CAST(10 + ord % 40 AS STRING) AS n FROM spaces)"""


def _needs(name: str, seen: list[str]) -> None:
    for word in sorted(set(re.findall(r"\b[a-z_]+\b", VIEWS[name]))):
        if word in VIEWS and word != name and word not in seen:
            _needs(word, seen)
    if name not in seen:
        seen.append(name)


def with_clause(*names: str) -> str:
    """``WITH ...`` holding the named views and those they read, in order."""
    order: list[str] = []
    for name in names:
        _needs(name, order)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def oracle(body: str, *names: str) -> str:
    """SQL text over the derived views; ``body`` may open with more CTEs."""
    body = body.strip()
    head = with_clause(*names)
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE" + head[4:] + ",\n" + rest[10:]
        return head + ",\n" + rest
    return head + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; the scan keeps pruning and pushdown."""
    head = with_clause(name)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", head)]
    scans = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"WITH {scans}, {head[5:]} SELECT * FROM {name}")
