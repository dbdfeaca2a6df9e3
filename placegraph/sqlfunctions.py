"""The library's column functions as SQL functions of a session.

Each is registered with ``CREATE TEMPORARY FUNCTION ... RETURN``, its body written out
from the column expression itself, so SQL and DataFrame users run one definition and
Catalyst sees through it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from placegraph.functions import clock, geo, text

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_PART = re.compile(
    r"(?P<text>'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<float>\d+\.\d+(?![\dE]))|(?P<number>\d[\dE.+-]*)|(?P<arrow>->)|(?P<sign>[^\s\w'(),.\[\]]+)(?=\()")

#: name, parameters, expression of the parameters
FUNCTIONS: list[tuple[str, str, Callable[..., Column]]] = [
    ("pg_distance_m", "lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE", geo.haversine_m),
    ("pg_flat_m", "lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE", geo.flat_m),
    ("pg_local_x", "lng DOUBLE, lng0 DOUBLE, lat0 DOUBLE", geo.local_x),
    ("pg_local_y", "lat DOUBLE, lat0 DOUBLE", geo.local_y),
    ("pg_from_local", "x DOUBLE, y DOUBLE, lng0 DOUBLE, lat0 DOUBLE", geo.from_local),
    ("pg_rectangle", "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", geo.rectangle),
    ("pg_box", f"ring {_RING}", geo.box),
    ("pg_area", f"ring {_RING}", geo.area),
    ("pg_centre", f"ring {_RING}", geo.vertex_mean),
    ("pg_contains", f"ring {_RING}, x DOUBLE, y DOUBLE", geo.inside_ring),
    ("pg_holds", f"ring {_RING}, other {_RING}", lambda ring, other: geo.holds(geo.edges(ring), other)),
    ("pg_segment_distance", "px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, b_y DOUBLE", geo.segment_distance),
    ("pg_edge_distance", f"ring {_RING}, x DOUBLE, y DOUBLE", lambda ring, x, y: geo.edge_distance(geo.edges(ring), x, y)),
    ("pg_distance_to", f"ring {_RING}, x DOUBLE, y DOUBLE", lambda ring, x, y: geo.distance_to_shape(geo.edges(ring), x, y)),
    ("pg_common_area", f"a {_RING}, b {_RING}", geo.intersection_area),
    ("pg_similarity", f"ring {_RING}, scale DOUBLE, theta DOUBLE, tx DOUBLE, ty DOUBLE", geo.similarity),
    ("pg_close", f"ring {_RING}", geo.close_ring),
    ("pg_translate", f"ring {_RING}, dx DOUBLE, dy DOUBLE", geo.translate),
    ("pg_stretch", f"ring {_RING}, sx DOUBLE, sy DOUBLE, degrees DOUBLE", geo.stretch_about_mean),
    ("pg_plan_to_world", "u DOUBLE, v DOUBLE, lng0 DOUBLE, lat0 DOUBLE, width_m DOUBLE, rotation DOUBLE, aspect DOUBLE", geo.plan_to_world),
    ("pg_world_to_plan", "lng DOUBLE, lat DOUBLE, lng0 DOUBLE, lat0 DOUBLE, width_m DOUBLE, rotation DOUBLE, aspect DOUBLE", geo.world_to_plan),
    ("pg_fold_angle", "degrees DOUBLE", geo.fold_angle),
    ("pg_turn", "degrees DOUBLE", geo.turn),
    ("pg_filled", "x STRING", text.filled),
    ("pg_blank_to_null", "x STRING", text.blank_to_null),
    ("pg_first_filled", "a STRING, b STRING", text.first_filled),
    ("pg_place_name", "x STRING", text.place_name),
    ("pg_natural_key", "x STRING", text.natural_key),
    ("pg_floor_key", "x STRING", text.floor_key),
    ("pg_parse_ref", "ref STRING, fallback STRING", text.parse_ref),
    ("pg_strict_ref", "raw STRING", text.strict_ref),
    ("pg_free_ref", "raw STRING", text.free_ref),
    ("pg_bare_room", "building STRING, room STRING", text.bare_room),
    ("pg_room_after_prefix", "building STRING, room STRING", text.room_after_prefix),
    ("pg_room_label", "building STRING, floor STRING, room STRING", text.room_label),
    ("pg_where_is", "building STRING, floor STRING, room STRING", text.where_is),
    ("pg_index_label", "building STRING, room STRING", text.index_label),
    ("pg_index_query", "label STRING, name STRING", text.index_query),
    ("pg_favourite_id", "building STRING, floor STRING, room STRING", text.favourite_id),
    ("pg_recent_key", "building STRING, room STRING", text.recent_key),
    ("pg_quoted", "x STRING", text.quoted),
    ("pg_lines", "x STRING", text.lines),
    ("pg_comma_list", "x STRING", text.comma_list),
    ("pg_is_sheet_code", "x STRING", text.is_sheet_code),
    ("pg_is_floor_code", "x STRING", text.is_floor_code),
    ("pg_is_destination", "kind STRING", text.is_destination),
    ("pg_digits_read", "raw STRING", text.digits_read),
    ("pg_stairs_tag", "number STRING, kind STRING", text.stairs_tag),
    ("pg_minutes_of", "hhmm STRING", clock.minutes_of),
    ("pg_hhmm", "minutes INT", clock.hhmm),
    ("pg_twelve_hour", "hhmm STRING", clock.twelve_hour),
    ("pg_weekday", "ts TIMESTAMP", clock.weekday),
    ("pg_minute_of_day", "ts TIMESTAMP", clock.minute_of_day),
    ("pg_week_slot", "ts TIMESTAMP", clock.week_slot),
    ("pg_days_of_bits", "bits INT", clock.days_of_bits),
]


def as_sql(column: Column) -> str:
    """SQL text of an expression: operators as quoted function names, fractions as doubles."""
    def part(m: re.Match) -> str:
        if m["float"]:
            return m["float"] + "D"
        if m["sign"] or (m["name"] in ("and", "or", "in", "not") and m.string[m.end() : m.end() + 1] == "("):
            return f"`{m[0]}`"
        return m[0]

    return _PART.sub(part, column._jc.node().sql())


def parameters(told: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) (?=[A-Z])", told)


def register(spark: SparkSession) -> list[str]:
    """Make every function of :data:`FUNCTIONS` known to the session; returns their names."""
    for name, told, expression in FUNCTIONS:
        body = as_sql(expression(*map(F.col, parameters(told))))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({told}) RETURN {body}")
    return [name for name, _, _ in FUNCTIONS]
