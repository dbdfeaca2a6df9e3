"""Placing nodes in buildings and rooms, and giving every node a name of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.functions import text
from placegraph.operators import spatial
from placegraph.operators.common import number_rows, running
from placegraph.session import discard, materialise

OUTDOOR_PREFIX = "OUT"
MARK = "H"


def fill_blank_building(nodes: DataFrame, outlines: DataFrame) -> DataFrame:
    """Give nodes without a building the place they stand in; never overwrite one. ``filled`` marks the changes."""
    placed = spatial.place_of(nodes, outlines)
    own = F.nullif("building", F.lit(""))
    return placed.withColumn("filled", own.isNull() & F.col("place").isNotNull()).withColumn(
        "building", F.coalesce(own, "place")).drop("place")


def take_placements(working: DataFrame, placed: DataFrame) -> DataFrame:
    """Take back buildings decided elsewhere (``nid, building``) into a working copy."""
    p = placed.select("nid", F.col("building").alias("_b"))
    return working.join(p, "nid", "left").withColumn("building", F.coalesce("_b", "building")).select(*working.columns)


def reassign_buildings(nodes: DataFrame, outlines: DataFrame) -> DataFrame:
    """Set every node's building from where it stands; outdoors loses its floor. ``move`` and ``moved`` added."""
    placed = spatial.place_of(nodes, outlines)
    moved = ~F.col("building").eqNullSafe(F.col("place"))
    move = F.concat_ws(" -> ", F.coalesce("building", F.lit("outdoors")), F.coalesce("place", F.lit("outdoors")))
    return (placed.withColumn("moved", moved).withColumn("move", move)
            .withColumn("floor", F.when(moved & F.col("place").isNull(), F.lit(None)).otherwise(F.col("floor")))
            .withColumn("building", F.col("place")).drop("place"))


def split_from_sheets(nodes: DataFrame, outlines: DataFrame) -> DataFrame:
    """Nodes lifted off the sheets they were drawn on (``sheet_building, sheet_floor``).

    The sheet's floor is kept only inside that sheet's own building.
    """
    placed = spatial.place_of(nodes, outlines)
    here = F.col("place")
    return placed.select(*nodes.columns, here.alias("building"), F.when(here == F.col("sheet_building"), F.col("sheet_floor")).alias("floor"),
                         (~here.eqNullSafe(F.col("sheet_building"))).alias("moved"))


def match_rooms_on_sheet(nodes: DataFrame, spaces: DataFrame, building: str, floor: str) -> DataFrame:
    """Give roomless nodes the room they stand in on one open sheet.

    ``action`` says what happened: already, elsewhere (another floor), named,
    outside. A node on no storey that stands in a room here takes this floor.
    """
    sheet = spaces.where((F.upper("building") == building.upper()) & (F.col("floor") == floor))
    blank_floor = F.coalesce(F.nullif("floor", F.lit("")).isNull(), F.lit(True))
    elsewhere = (F.upper("building") == building.upper()) & ~blank_floor & (F.col("floor") != floor)
    probe = nodes.withColumn("_own", F.col("floor")).withColumn("floor", F.when(blank_floor, F.lit(floor)).otherwise(F.col("floor")))
    found = spatial.room_of(probe, sheet).withColumn("floor", F.col("_own"))
    action = (F.when(text.filled("room"), "already").when(F.coalesce(elsewhere, F.lit(False)), "elsewhere")
              .when(F.col("found_room").isNotNull(), "named").otherwise("outside"))
    found = found.withColumn("action", action)
    named = F.col("action") == "named"
    return found.select(*[c for c in nodes.columns if c not in ("room", "floor")],
                        F.when(named, F.col("found_room")).otherwise(F.col("room")).alias("room"),
                        F.when(named & F.nullif("floor", F.lit("")).isNull(), F.lit(floor)).otherwise(F.col("floor")).alias("floor"), "action")


def match_rooms(nodes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every sheet at once: roomless nodes take the smallest room holding them on their own floor."""
    found = spatial.room_of(nodes, spaces)
    return found.withColumn("matched", ~text.filled("room") & F.col("found_room").isNotNull()).withColumn(
        "room", F.coalesce(F.nullif("room", F.lit("")), "found_room")).select(*nodes.columns, "matched")


def traced_buildings(spaces: DataFrame) -> DataFrame:
    """Buildings with at least one traced sheet: their counted names carry the mark."""
    return spaces.where(F.col("type").isNotNull() & (F.col("type") != "building")).select(F.upper("building").alias("traced")).distinct()


def name_prefixes(nodes: DataFrame, spaces: DataFrame) -> DataFrame:
    """What each node's name is built on: its building, or OUT when it stands in none of its traced spaces."""
    stand = spatial.inside_any(nodes, spaces)
    t = traced_buildings(spaces)
    place = F.trim(F.coalesce("building", F.lit("")))
    out = stand.join(t, F.upper(place) == F.col("traced"), "left")
    keep = text.filled("room") | F.col("traced").isNull() | F.col("inside")
    prefix = F.when(place == "", OUTDOOR_PREFIX).when(keep, place).otherwise(OUTDOOR_PREFIX)
    out = out.withColumn("prefix", prefix)
    marked = F.col("traced").isNotNull() & (F.col("prefix") != OUTDOOR_PREFIX)
    return out.withColumn("marked", marked).select(*nodes.columns, "prefix", "marked")


def spare_name(name) -> Column:
    """Read a counted name back: ``struct<prefix, floor, marked>``; the unmarked form is only a candidate."""
    marked, plain = r"^(.*)-([0-9]*)H([0-9]+)$", r"^(.*)-([0-9]+)$"
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.rlike(marked), F.struct(F.regexp_extract(c, marked, 1).alias("prefix"), F.regexp_extract(c, marked, 2).alias("floor"), F.lit(True).alias("marked"))).when(
        c.rlike(plain), F.struct(F.regexp_extract(c, plain, 1).alias("prefix"), F.lit("").alias("floor"), F.lit(False).alias("marked")))


def stale_names(nodes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Nodes with ``prefix``/``marked`` whose counted name no longer describes them: ``stale`` added."""
    t = traced_buildings(spaces).withColumnRenamed("traced", "_np")
    n = nodes.withColumn("_s", spare_name("name"))
    n = n.join(t, F.upper("_s.prefix") == F.col("_np"), "left")
    counted = F.col("_s").isNotNull() & (F.col("_s.marked") | F.col("_np").isNull() | (F.col("_s.prefix") == OUTDOOR_PREFIX))
    fl = F.coalesce("floor", F.lit(""))
    stale = counted & (text.filled("room") | (F.col("_s.prefix") != F.col("prefix")) | (F.col("_s.marked") != F.col("marked"))
                       | (F.col("marked") & (F.col("_s.floor") != fl)))
    return n.select(*nodes.columns, F.coalesce(stale, F.lit(False)).alias("stale"))


def _free_slots(todo: DataFrame, used: DataFrame) -> DataFrame:
    """The t-th row of a series takes its t-th unused number.

    ``todo``: ``series, t, ...``; ``used``: ``series, n`` distinct. The j-th used
    number moves every row with ``t > n - j`` one on, so one running count over
    both lists places all rows without listing candidates. ``n`` is added.
    """
    u = number_rows(used.select("series", "n"), ["series"], "n", "j").select(
        "series", (F.col("n") - F.col("j") + 1).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("nid"))
    both = u.unionByName(todo.select("series", "t", F.lit(1).alias("kind"), "nid"))
    counted = running(both, ["series"], "t", sums={"skips": 1 - F.col("kind")}, tie=["kind", "nid"])
    return counted.where("kind = 1").select("nid", (F.col("t") + F.col("skips")).alias("n"))


def _taken(names: DataFrame, series: DataFrame, spare: bool) -> DataFrame:
    """The ``series, n`` slots that names stand for, of the series given (``series``).

    A room's own name is number 1 of its series and ``-2`` to ``-99`` follow; a
    counted name is its series and the digits after it. Numbers of more than 18 digits
    stand for no slot: none is ever handed out, as slots are counted up from 1.
    """
    if spare:
        digits = F.regexp_extract("name", r"([0-9]+)$", 1)
        split = names.where(digits != "").withColumn("_k", F.explode(F.sequence(F.lit(1), F.length(digits)))).select(
            F.substr("name", F.lit(1), F.length("name") - F.col("_k")).alias("series"), F.right("name", F.col("_k")).alias("_d"))
        split = split.where(~F.startswith("_d", F.lit("0")) & (F.length("_d") <= 18)).select("series", F.col("_d").cast("bigint").alias("n"))
    else:
        tail = r"^(.*)-([1-9][0-9]?)$"
        split = names.select(F.col("name").alias("series"), F.lit(1).cast("bigint").alias("n")).unionByName(
            names.where(F.col("name").rlike(tail)).select(F.regexp_extract("name", tail, 1).alias("series"),
                                                         F.regexp_extract("name", tail, 2).cast("bigint").alias("n")).where("n >= 2"))
    return split.join(series, "series", "left_semi").distinct()


def _count_on(rows: DataFrame, taken: DataFrame) -> DataFrame:
    ranked = number_rows(rows, ["series"], "ord", "t", tie=["nid"])
    return ranked.join(_free_slots(ranked, taken), "nid")


def assign_names(nodes: DataFrame, rename: bool = False) -> DataFrame:
    """A name of its own for every unnamed node; names already there are kept.

    ``nodes``: ``nid, ord, name, room, floor, prefix, marked``. Nodes with a room
    go first, in file order: ``PLACE-ROOM``, then ``-2`` to ``-99``, then a counted
    name; the rest are counted, ``PLACE-<floor>H<n>`` where the place has traced
    floors and ``PLACE-<n>`` elsewhere. Each series is numbered at once; when two
    series of room nodes meet on one name the later node moves on, and only then
    is that part repeated. Returns ``nid, new_name``.
    """
    kept = F.lit(False) if rename else text.filled("name")
    room, fl = F.trim("room"), F.coalesce("floor", F.lit(""))
    todo = nodes.where(~kept).select(
        "nid", "ord", F.when(text.filled("room"), F.concat_ws("-", "prefix", room)).alias("base"),
        F.when(F.col("marked"), F.concat(F.col("prefix"), F.lit("-"), fl, F.lit(MARK))).otherwise(F.concat(F.col("prefix"), F.lit("-"))).alias("spare"))
    todo, _ = materialise(todo)
    used, _ = materialise(nodes.where(kept).select("name").distinct())
    in_rooms = todo.where("base IS NOT NULL")
    bases = in_rooms.select(F.col("base").alias("series")).distinct()
    spares = todo.select(F.col("spare").alias("series")).distinct()
    taken_rooms, _ = materialise(_taken(used, bases, False))
    taken_spare, _ = materialise(_taken(used, spares, True))
    losses = None
    while True:
        lost_in = lambda p: losses.where(F.col("pass") == p).select("series", "n")
        t1 = taken_rooms if losses is None else taken_rooms.unionByName(lost_in(1)).distinct()
        t2 = taken_spare if losses is None else taken_spare.unionByName(lost_in(2)).distinct()
        placed = _count_on(in_rooms.select("nid", "ord", F.col("base").alias("series"), "spare"), t1)
        n = F.col("n").cast("string")
        fits = placed.where("n <= 99").select("nid", "ord", "series", "n", F.lit(1).alias("pass"), F.when(F.col("n") == 1, F.col("series")).otherwise(F.concat_ws("-", "series", n)).alias("new_name"))
        over = _count_on(placed.where("n > 99").select("nid", "ord", F.col("spare").alias("series")), t2).select(
            "nid", "ord", "series", "n", F.lit(2).alias("pass"), F.concat("series", n).alias("new_name"))
        first, _ = materialise(fits.unionByName(over))
        rivals = first.groupBy("new_name").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ord", "nid", "series")).alias("w")).where("c > 1")
        lost, found = materialise(first.join(rivals, "new_name").where(F.col("nid") != F.col("w.nid")).select("series", "n", "pass", "ord", "nid", "w"))
        if not found["rows"]:
            break
        # A winner is final only when its own series loses nothing before it.
        early = lost.groupBy(F.col("series").alias("_s")).agg(F.min(F.struct("ord", "nid")).alias("_f"))
        sure = lost.join(early, F.col("w.series") == F.col("_s"), "left").where(
            F.col("_f").isNull() | (F.struct(F.col("w.ord").alias("ord"), F.col("w.nid").alias("nid")) < F.col("_f"))).select("series", "n", "pass")
        losses, _ = materialise(sure if losses is None else losses.unionByName(sure).distinct())
        discard(first)
    # Counted names cannot meet each other, only names given before.
    rest = todo.where("base IS NULL").select("nid", "ord", F.col("spare").alias("series"))
    now = taken_spare.unionByName(_taken(first.select(F.col("new_name").alias("name")), spares, True)).distinct()
    counted = _count_on(rest, now).select("nid", F.concat("series", F.col("n").cast("string")).alias("new_name"))
    return first.select("nid", "new_name").unionByName(counted)


def name_network(nodes: DataFrame, spaces: DataFrame, rename: bool = False) -> DataFrame:
    """Match rooms, build prefixes, assign names: the whole naming job in one call."""
    with_rooms = match_rooms(nodes, spaces)
    ready = name_prefixes(with_rooms.drop("matched"), spaces)
    ready, _ = materialise(ready)
    fresh = assign_names(ready, rename)
    return ready.join(fresh, "nid", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def display_names(features: DataFrame) -> DataFrame:
    """List titles by position: nodes, doors and entrances are numbered in file order, links by their ends.

    ``features``: ``ord, kind, type, nid, a, b, room, building, name, connects``.
    """
    group = F.when(F.col("kind") == "path", "path").when(F.col("type").isin("node", "door", "entrance"), F.col("type")).otherwise("shape")
    f = number_rows(features.withColumn("_g", group), ["_g"], "ord", "no")
    ends = f.where("_g = 'node'").select("nid", F.concat(F.lit("N"), F.col("no").cast("string"), F.when(text.filled("room"), F.concat(F.lit(" ("), F.col("room"), F.lit(")"))).otherwise("")).alias("t"))
    e1 = ends.select(F.col("nid").alias("a"), F.col("t").alias("_ta"))
    e2 = ends.select(F.col("nid").alias("b"), F.col("t").alias("_tb"))
    f = f.join(e1, "a", "left").join(e2, "b", "left")
    no, word = F.col("no").cast("string"), F.initcap("_g")
    title = (F.when(F.col("_g") == "path", F.concat(F.lit("Link "), F.coalesce("_ta", F.lit("?")), F.lit(" ↔ "), F.coalesce("_tb", F.lit("?"))))
             .when(F.col("_g") == "node", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Node "), no)))
             .when(F.col("_g") == "shape", F.coalesce(F.nullif("room", F.lit("")), F.lit("(unnumbered)")))
             .otherwise(F.concat_ws(" ", word, no)))
    sub = (F.when(F.col("_g") == "path", "path")
           .when(F.col("_g") == "node", F.when(text.filled("room"), F.concat(F.lit("serves "), F.col("room"))).otherwise(F.coalesce(F.nullif("building", F.lit("")), F.lit("outdoors"))))
           .when(F.col("_g") == "shape", F.col("type"))
           .otherwise(F.coalesce(F.nullif(F.array_join("connects", " ↔ "), F.lit("")), F.lit("unlinked"))))
    return f.select("ord", title.alias("title"), sub.alias("sub"))
