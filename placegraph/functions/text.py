"""Names, references and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x) -> Column:
    """Not NULL and not empty."""
    return F.coalesce(_c(x) != "", F.lit(False))


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def first_filled(*xs) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def place_name(x) -> Column:
    """A name as it is looked up: trimmed, upper case, single spaces."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), r"\s+", " "))


def natural_key(x) -> Column:
    """Sort key that puts B2 before B10: every digit run padded to 19 places."""
    padded = F.regexp_replace(F.lower(_c(x)), r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{19})(?!\d)", "$1")


def floor_key(x) -> Column:
    """Bottom-first floor order: leading numbers first, by value; the rest after."""
    n = F.regexp_extract(F.trim(_c(x)), r"^([+-]?\d+)", 1)
    return F.struct((n == "").alias("word"), F.when(n != "", n.cast("bigint")).alias("n"))


def parse_ref(ref, fallback) -> Column:
    """``struct<building, room>`` of a room reference; a bare room takes the fallback building."""
    t = F.trim(F.coalesce(_c(ref), F.lit("")))
    fb = F.upper(F.coalesce(_c(fallback), F.lit("")))
    form = r"^([A-Za-z]{1,6}\d{0,3})[-\s]+(.+)$"
    head = F.upper(F.regexp_extract(t, form, 1))
    rest = F.trim(F.regexp_extract(t, form, 2))
    return F.when(head != "", F.struct(head.alias("building"), rest.alias("room"))).otherwise(
        F.struct(fb.alias("building"), t.alias("room")))


def strict_ref(raw) -> Column:
    """Building and room of a timetable reference, or NULL when it is not one."""
    s = F.upper(F.trim(F.coalesce(_c(raw), F.lit(""))))
    form = r"^([A-Z]+\d*)[-\s]+(\S.*)$"
    return F.when(s.rlike(form), F.struct(F.regexp_extract(s, form, 1).alias("building"),
                                          F.trim(F.regexp_extract(s, form, 2)).alias("room")))


def free_ref(raw) -> Column:
    """Room pattern in free text: building, room and the floor its first digit suggests; NULL otherwise."""
    s = F.upper(F.trim(F.coalesce(_c(raw), F.lit(""))))
    form = r"^([A-Z]{1,4}\d{0,2})[-\s]+([A-Z0-9]+)$"
    room = F.regexp_extract(s, form, 2)
    digit = F.regexp_extract(room, r"(\d)", 1)
    return F.when(s.rlike(form), F.struct(F.regexp_extract(s, form, 1).alias("building"), room.alias("room"),
                                          F.when(digit == "", F.lit("1")).otherwise(digit).alias("floor")))


def bare_room(building, room) -> Column:
    """The room without its building code in front."""
    b, r = F.trim(F.coalesce(_c(building), F.lit(""))), F.trim(F.coalesce(_c(room), F.lit("")))
    return F.when((b != "") & F.startswith(F.upper(r), F.concat(F.upper(b), F.lit("-"))),
                  F.substr(r, F.length(b) + 2)).otherwise(r)


def room_after_prefix(building, room) -> Column:
    """The room with a leading building code and any dashes or spaces cut off, in any case."""
    b, r = F.upper(_c(building)), F.trim(_c(room))
    return F.when((b != "") & F.startswith(F.upper(r), b),
                  F.regexp_replace(F.substr(r, F.length(b) + 1), r"^[-\s]*", "")).otherwise(r)


def room_label(building, floor, room) -> Column:
    b, f = F.trim(F.coalesce(_c(building), F.lit(""))), F.trim(F.coalesce(_c(floor), F.lit("")))
    r = bare_room(building, room)
    return (F.when((b != "") & (r != ""), F.concat_ws(" · ", b, r))
            .when((b != "") & (f != ""), F.concat(b, F.lit(" · Floor "), f))
            .when(b != "", b).when(r != "", r).otherwise("Selected point"))


def where_is(building, floor, room) -> Column:
    """Where a node is, in words."""
    place = F.when(filled(building), _c(building)).otherwise("outdoors")
    at = F.when(filled(floor), F.concat(place, F.lit(" floor "), _c(floor))).otherwise(place)
    return F.when(filled(room), F.concat(at, F.lit(" · "), _c(room))).otherwise(at)


def index_label(building, room) -> Column:
    return F.concat(F.coalesce(_c(building), F.lit("")), F.lit("-"), _c(room))


def index_query(label, name) -> Column:
    return F.when(filled(name), F.concat_ws(" ", _c(label), _c(name))).otherwise(_c(label))


def favourite_id(building, floor, room) -> Column:
    t = lambda x: F.trim(F.coalesce(_c(x), F.lit("")))
    return F.upper(F.concat(F.lit("room:"), t(building), F.lit("-"), t(floor), F.lit("-"), t(room)))


def recent_key(building, room) -> Column:
    return F.concat(F.upper(_c(building)), F.lit("|"), _c(room))


def quoted(x, longest: int = 60) -> Column:
    """Asker's words on one line, cut to a length worth repeating."""
    one = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > longest, F.concat(F.substring(one, 1, longest - 3), F.lit("..."))).otherwise(one)


def lines(x) -> Column:
    """Parts of a value written on several lines or with ; or , between."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[\n;,]"), lambda t: F.trim(t)), lambda t: t != "")


def comma_list(x) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def array_or_json(arr, raw) -> Column:
    """A list property that may have been stored as JSON text."""
    return F.coalesce(_c(arr), F.from_json(_c(raw), "array<string>"), F.array().cast("array<string>"))


def is_sheet_code(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^[A-Za-z][A-Za-z0-9]{0,7}$"), F.lit(False))


def is_floor_code(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^[0-9]{1,3}$"), F.lit(False))


def is_destination(kind) -> Column:
    return F.lower(F.coalesce(F.nullif(_c(kind), F.lit("")), F.lit("room"))) == "room"


# Letters a stencil font confuses with digits, and the digits meant.
LOOKALIKE_LETTERS = "OoDQUCcIl|LTJiZzSsGbeBgqA"
LOOKALIKE_DIGITS = "0000000111111122556668994"


def digits_read(raw) -> Column:
    """A label read as digits, look-alike letters included; NULL unless 2 to 5 digits result."""
    d = F.regexp_replace(F.translate(_c(raw), LOOKALIKE_LETTERS, LOOKALIKE_DIGITS), "[^0-9]", "")
    return F.when(d.rlike(r"^\d{2,5}$"), d)


def stairs_tag(number, kind) -> Column:
    """A stairwell tag whose S was read as 5."""
    return F.when((_c(kind) == "stairs") & _c(number).rlike(r"^5\d{2,3}$"),
                  F.concat(F.lit("S"), F.substr(_c(number), F.lit(2)))).otherwise(_c(number))
