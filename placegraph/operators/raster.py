"""Floors as grids of cells: scanning, neighbours, shortest walks, smoothing, rasterising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.operators import walks
from placegraph.operators.common import apart, number_ranges, running, with_previous
from placegraph.session import materialise

CELL = ("building", "floor", "r", "c")


def cell_id(building="building", floor="floor", r="r", c="c") -> Column:
    return F.concat_ws("|", building, F.col(floor).cast("string"), F.col(r).cast("string"), F.col(c).cast("string"))


def labels_to_cells(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """Labels as typed cells: stairs by name, entrances by label, rooms by number.

    ``labels``: ``building, floor, label, x, y``; ``meta``: ``building, floor, min_x, max_y, cell_size``.
    """
    text = F.lower(F.trim("label"))
    kind = F.when(F.startswith(text, F.lit("stairs")), "stairs").when(F.startswith(text, F.lit("entrance")), "entrance").when(
        F.regexp_replace(text, " ", "").rlike(r"^\d+$"), "room")
    name = F.when(kind == "stairs", F.upper(F.element_at(F.split(text, r"\s+"), -1))).otherwise(text)
    j = labels.join(meta, ["building", "floor"])
    return j.select("building", "floor", kind.alias("kind"), name.alias("name"),
                    ((F.col("max_y") - F.col("y")) / F.col("cell_size")).cast("int").alias("r"),
                    ((F.col("x") - F.col("min_x")) / F.col("cell_size")).cast("int").alias("c")).where("kind IS NOT NULL")


def cell_centre(r: Column, c: Column, min_x: Column, max_y: Column, size: Column) -> Column:
    return F.struct((min_x + c * size + size / 2).alias("x"), (max_y - r * size - size / 2).alias("y"))


def portal_rows(connections: DataFrame) -> DataFrame:
    """Parallel arrays of a floor's connections as rows; the label list is nested once more.

    ``connections``: ``building, floor, entrances array<array<string>>, buildings, floors`` (floors like F2).
    """
    z = connections.select("building", "floor", F.explode(F.arrays_zip("entrances", "buildings", "floors")).alias("z"))
    return z.select("building", "floor", F.lower(F.get("z.entrances", 0)).alias("entrance"), F.col("z.buildings").alias("to_building"),
                    F.substr("z.floors", F.lit(2)).try_cast("int").alias("to_floor"), F.lower(F.get("z.entrances", 1)).alias("to_entrance")).where("to_floor IS NOT NULL")


def arcs(cells: DataFrame, stairs: DataFrame, portals: DataFrame, entrances: DataFrame) -> DataFrame:
    """Moves between cells: the four neighbours, stairs between floors, portals between buildings.

    ``stairs``: ``building, name, floor, r, c``; ``entrances``: ``building, floor,
    label, r, c, ord``. A stairwell of n floors is joined through one hub at half
    a step each way, so it adds 2n rows and every floor change costs one step.
    """
    grid = cells.select(*CELL, (~F.col("blocked")).alias("free"))
    side = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((1, 0), (0, 1))])
    near = grid.select("building", "floor", F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("free").alias("free1"), F.explode(side).alias("d")).select(
        "building", "floor", "r1", "c1", "free1", (F.col("r1") + F.col("d.dr")).alias("r"), (F.col("c1") + F.col("d.dc")).alias("c"))
    # Each pair of neighbours meets once. Cells grow with the floors, so no side may be sent whole to every task.
    pair = near.hint("merge").join(grid, list(CELL)).select(cell_id(r="r1", c="c1").alias("p"), "free1", cell_id().alias("q"), "free")
    ways = F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b"), F.col("free").alias("into")), F.struct(F.col("q").alias("a"), F.col("p").alias("b"), F.col("free1").alias("into")))
    walk = pair.select(F.explode(F.filter(ways, lambda x: x["into"])).alias("x")).select("x.a", "x.b", F.lit(1.0).alias("w"))
    at = stairs.groupBy("building", "name", "floor").agg(F.max(F.struct("r", "c")).alias("p")).select(
        cell_id(r="p.r", c="p.c").alias("cell"), F.concat_ws("|", F.lit("stairs"), "building", "name").alias("hub"))
    up = at.select(F.col("cell").alias("a"), F.col("hub").alias("b"), F.lit(0.5).alias("w")).unionByName(
        at.select(F.col("hub").alias("a"), F.col("cell").alias("b"), F.lit(0.5).alias("w")))
    first = entrances.groupBy("building", "floor", "label").agg(F.min_by(F.struct("r", "c"), "ord").alias("p"))
    there = first.select(F.col("building").alias("to_building"), F.col("floor").alias("to_floor"), F.col("label").alias("to_entrance"), cell_id(r="p.r", c="p.c").alias("b"))
    here = entrances.select("building", "floor", F.col("label").alias("entrance"), cell_id().alias("a"))
    cross = portals.hint("merge").join(here, ["building", "floor", "entrance"]).join(there.hint("merge"), ["to_building", "to_floor", "to_entrance"]).select("a", "b", F.lit(1.0).alias("w"))
    both = walk.unionByName(up).unionByName(cross)
    return both.select("a", "b", "w", F.lit(0.0).alias("entry"), F.lit(None).cast("string").alias("b_room"))


#: Cells of a block of floors, about those of a tile of a large one.
BLOCK = 2_048


def tile_blocks(moves: DataFrame, tile: int = 45) -> DataFrame:
    """``nid, block`` of the ends of moves: runs of ``BLOCK`` cells in the order of building, floor and square tiles; a hub goes with its first cell.

    A large floor is cut in about its tiles; small floors of a building, and small buildings, share a block.
    """
    cells = moves.select(F.col("a").alias("nid")).unionByName(moves.select(F.col("b").alias("nid"))).distinct().where(~F.startswith("nid", F.lit("stairs|")))
    part = F.split("nid", r"\|")
    of = lambda k: F.floor(F.element_at(part, k).cast("bigint") / tile)
    tiled = cells.select("nid", F.concat_ws("|", F.slice(part, 1, F.size(part) - 2)).alias("at"), of(-2).alias("tr"), of(-1).alias("tc"))
    tiles, _ = materialise(number_ranges(tiled, ["at", "tr", "tc", "nid"], "_n").select("nid", F.floor(F.col("_n") / BLOCK).cast("bigint").alias("block")))
    hubs = moves.where(F.startswith("b", F.lit("stairs|"))).groupBy(F.col("b").alias("nid")).agg(F.min("a").alias("a"))
    return tiles.unionByName(hubs.hint("merge").join(tiles.select(F.col("nid").alias("a"), "block"), "a").select("nid", "block"))


def shortest_paths(moves: DataFrame, starts: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fewest steps for a table of queries, and the cells walked: ``query_id, step, cell``."""
    moves, _ = materialise(moves)
    cells = moves.select(F.col("a").alias("nid")).unionByName(moves.select(F.col("b").alias("nid"))).distinct()
    alone = starts.select("nid").distinct().join(cells.hint("merge"), "nid", "left_anti").select("nid", (-1 - F.pmod(F.xxhash64("nid"), F.lit(65_536))).alias("block"))  # no move is in these
    answers, path = walks.shortest_walks(moves, starts, goals, blocks=tile_blocks(moves).unionByName(alone))
    path, _ = materialise(path.withColumn("hub", F.startswith("nid", F.lit("stairs|"))))
    hubs = running(path, ["query_id"], "step", sums={"hubs": F.col("hub").cast("int")})
    cells = hubs.where(~F.col("hub")).select("query_id", (F.col("step") - F.col("hubs")).alias("step"), F.col("nid").alias("cell"))
    return answers, cells


def snap_to_free(states: DataFrame, cells: DataFrame, key: str = "query_id", start: int = 4) -> DataFrame:
    """The nearest free cell in steps of each state's floor; ties to the upper, then the left one.

    Blocks of cells around the state are searched, doubling until the answer lies
    within a block's width; a state with no free cell on its floor stays put.
    """
    free, _ = materialise(cells.where(~F.col("blocked")).select(*CELL))
    extent = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    todo, _ = materialise(states.select(key, *CELL))
    largest = 2 * max(extent.r or 0, extent.c or 0) + 2
    answer, size = None, start
    off = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        left = todo.withColumn("_r", F.explode(F.transform(off, lambda d: F.floor(F.col("r") / size) + d))).withColumn(
            "_c", F.explode(F.transform(off, lambda d: F.floor(F.col("c") / size) + d)))
        right = free.select("building", "floor", F.col("r").alias("fr"), F.col("c").alias("fc"), F.floor(F.col("r") / size).alias("_r"), F.floor(F.col("c") / size).alias("_c"))
        d = (F.abs(F.col("r") - F.col("fr")) + F.abs(F.col("c") - F.col("fc"))).alias("d")
        # Sizes of files tell nothing of nine rows a state, so neither side may be sent whole to every task.
        best = left.hint("merge").join(right, ["building", "floor", "_r", "_c"]).groupBy(key).agg(F.min(F.struct(d, "fr", "fc")).alias("m"))
        last = size >= largest
        ok = F.coalesce(F.lit(last) | (F.col("m.d") <= size), F.lit(last))
        tried, n = materialise(todo.join(best, key, "left").withColumn("ok", ok), left=F.count_if(~ok))
        got = tried.where("ok").select(key, "building", "floor", F.coalesce("m.fr", "r").alias("r"), F.coalesce("m.fc", "c").alias("c"))
        answer = got if answer is None else answer.unionByName(got)
        if last or not n["left"]:
            return answer
        todo = tried.where(~F.col("ok")).select(key, *CELL)
        size *= 2


def closest_label_pair(starts: DataFrame, goals: DataFrame) -> DataFrame:
    """The cheapest (start, goal) pair of each query by steps apart, floors at 10 and another building at 1000.

    Both sides ``query_id, ord`` and a cell; candidates are the few cells that carry one label.
    """
    s = starts.select("query_id", *[F.col(x).alias("s_" + x) for x in ("ord", *CELL)])
    g = goals.select("query_id", *[F.col(x).alias("g_" + x) for x in ("ord", *CELL)])
    cost = (F.abs(F.col("s_r") - F.col("g_r")) + F.abs(F.col("s_c") - F.col("g_c")) + 10 * F.abs(F.col("s_floor") - F.col("g_floor"))
            + F.when(F.col("s_building") != F.col("g_building"), 1000).otherwise(0))
    return s.join(g, "query_id").groupBy("query_id").agg(F.min(F.struct(cost.alias("cost"), "s_ord", "g_ord")).alias("m")).select("query_id", "m.*")


def cells_on_segment(r1, c1, r2, c2) -> Column:
    """Cells a straight line steps through, ends included, in order.

    Rows are entered at k/rows of the way and columns at k/columns; where both
    fall together the step is diagonal.
    """
    r1, c1, r2, c2 = (F.col(x) if isinstance(x, str) else x for x in (r1, c1, r2, c2))
    dr, dc = F.abs(r2 - r1), F.abs(c2 - c1)
    none = F.array().cast("array<bigint>")
    times = lambda n, other: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k * F.greatest(other, F.lit(1))).cast("bigint"))).otherwise(none)
    marks = F.array_sort(F.array_distinct(F.concat(times(dr, dc), times(dc, dr))))
    step = lambda t: F.struct(
        (r1 + F.signum(r2 - r1).cast("int") * F.floor(t / F.greatest(dc, F.lit(1)))).cast("int").alias("r"),
        (c1 + F.signum(c2 - c1).cast("int") * F.floor(t / F.greatest(dr, F.lit(1)))).cast("int").alias("c"))
    flat = F.when(dr == 0, F.transform(marks, lambda t: F.struct(r1.cast("int").alias("r"), (c1 + F.signum(c2 - c1).cast("int") * t).cast("int").alias("c")))).when(
        dc == 0, F.transform(marks, lambda t: F.struct((r1 + F.signum(r2 - r1).cast("int") * t).cast("int").alias("r"), c1.cast("int").alias("c"))))
    return F.concat(F.array(F.struct(r1.cast("int").alias("r"), c1.cast("int").alias("c"))), F.coalesce(flat, F.transform(marks, step)))


def sight_cells(r1, c1, r2, c2) -> Column:
    """Cells tested for a clear line of sight: one per step of the longer side, the start left out."""
    r1, c1, r2, c2 = (F.col(x) if isinstance(x, str) else x for x in (r1, c1, r2, c2))
    dr, dc = F.abs(r2 - r1), F.abs(c2 - c1)
    sr, sc = F.when(r1 < r2, 1).otherwise(-1), F.when(c1 < c2, 1).otherwise(-1)
    far, near = F.greatest(dr, dc), F.least(dr, dc)
    # The side step comes when half the long side is used up strictly.
    side = lambda k: F.when(far > 0, F.ceil((k * near * 2 - far) / (2 * far))).otherwise(0)
    tall = dr >= dc
    return F.transform(F.sequence(F.lit(1), F.greatest(far, F.lit(1))), lambda k: F.struct(
        (r1 + sr * F.when(tall, k).otherwise(side(k))).cast("int").alias("r"), (c1 + sc * F.when(tall, side(k)).otherwise(k)).cast("int").alias("c")))


def smooth_paths(path: DataFrame, cells: DataFrame, window: int = 64) -> DataFrame:
    """Paths with points dropped while the one two on is in sight from the last kept.

    ``path``: ``query_id, step, building, floor, r, c``. The next point kept from
    any point is where sight first fails; those pointers are found for every
    point at once by looking ahead in growing stretches, and the kept points are
    the chain of pointers from the start, followed by doubling. Returns the kept rows.
    """
    path, points = materialise(path)
    walls, blocked = materialise(cells.where("blocked").select(*CELL))
    points, walls = points["rows"], apart(walls, blocked["rows"])
    last = path.groupBy("query_id").agg(F.max("step").alias("last"))
    todo, n = materialise(path.join(apart(last, points), "query_id").where(F.col("step") < F.col("last")).withColumn("seen", F.col("step") + 1))
    found, span = None, window
    target = path.select("query_id", F.col("step").alias("ahead"), F.col("building").alias("tb"), F.col("floor").alias("tf"), F.col("r").alias("tr"), F.col("c").alias("tc"))
    while n["rows"]:
        look = todo.withColumn("ahead", F.explode(F.when(F.col("seen") < F.col("last"), F.sequence(F.col("seen") + 1, F.least(F.col("seen") + span, F.col("last")))).otherwise(F.array(F.col("last") + 1))))
        pair = look.join(apart(target, points), ["query_id", "ahead"], "left")
        other = F.col("tb").isNull() | (F.col("tb") != F.col("building")) | (F.col("tf") != F.col("floor"))
        close = F.abs(F.col("r") - F.col("tr")) + F.abs(F.col("c") - F.col("tc")) <= 1
        cut = pair.where(other).select("query_id", "step", "ahead")
        sight = pair.where(~other & ~close).select("query_id", "step", "ahead", "building", "floor", F.explode(sight_cells("r", "c", "tr", "tc")).alias("s")).select(
            "query_id", "step", "ahead", "building", "floor", "s.r", "s.c").join(walls, list(CELL), "left_semi").select("query_id", "step", "ahead")
        fail = cut.unionByName(sight).groupBy("query_id", "step").agg((F.min("ahead") - 1).alias("next"))
        tried, m = materialise(todo.join(apart(fail, points), ["query_id", "step"], "left"), rows=F.count_if(F.col("next").isNull()))
        got = tried.where("next IS NOT NULL").select("query_id", "step", F.least("next", "last").alias("next"))
        found = got if found is None else found.unionByName(got)
        todo, n = tried.where("next IS NULL").withColumn("seen", F.least(F.col("seen") + span, F.col("last"))).drop("next"), m
        span *= 4
    kept = path.where("step = 0").select("query_id", "step")
    if found is not None:
        hop, n = materialise(found)
        while n["rows"]:
            more = kept.join(apart(hop, points), ["query_id", "step"]).select("query_id", F.col("next").alias("step"))
            kept, k = materialise(kept.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1))).groupBy("query_id", "step").agg(F.min("_n").alias("_n")), new=F.sum("_n"))
            kept = kept.drop("_n")
            if not k["new"]:
                break
            hop, n = materialise(hop.join(apart(hop.select("query_id", F.col("step").alias("next"), F.col("next").alias("far")), points), ["query_id", "next"]).select("query_id", "step", F.col("far").alias("next")))
    return path.join(apart(kept, points), ["query_id", "step"], "left_semi")


# -- line work ----------------------------------------------------------------

def drawing_segments(vertices: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Segments of polylines from gap-free vertex rows ``keys, seq, x, y``."""
    return with_previous(vertices, list(keys), "seq", ["x", "y"]).where("prev_x IS NOT NULL").select(
        *keys, "seq", F.col("prev_x").alias("x1"), F.col("prev_y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def drop_small(vertices: DataFrame, keys: Sequence[str] = ("entity",), least: float = 35.0) -> DataFrame:
    """Polylines whose box is too small to be a wall are lettering: left out."""
    size = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    big = vertices.groupBy(*keys).agg(size.alias("d"), F.count(F.lit(1)).alias("n")).where((F.col("d") >= least) & (F.col("n") >= 2))
    return vertices.join(big.select(*keys), list(keys), "left_semi")


def erase_box(vertices: DataFrame, x1: float, y1: float, x2: float, y2: float, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Polylines with any vertex in the box are removed whole."""
    hit = vertices.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2)).select(*keys).distinct()
    return vertices.join(hit, list(keys), "left_anti")


def crop_to_window(segments: DataFrame, keys: Sequence[str], cell: float, top: float = 0.9, zoom: float = 1.1) -> DataFrame:
    """Segments with an end inside the middle of the top part of each drawing."""
    b = segments.groupBy(*keys).agg(
        F.min(F.least("x1", "x2")).alias("lx"), F.max(F.greatest("x1", "x2")).alias("hx"), F.min(F.least("y1", "y2")).alias("ly"), F.max(F.greatest("y1", "y2")).alias("hy"))
    span = lambda lo, hi: ((F.col(hi) - F.col(lo)) / cell).cast("int") + 1
    b = b.withColumn("w", span("lx", "hx")).withColumn("h", (span("ly", "hy") * top).cast("int"))
    b = b.withColumn("nh", (F.col("h") / zoom).cast("int")).withColumn("nw", (F.col("w") / zoom).cast("int"))
    b = b.withColumn("sy", F.floor((F.col("h") - F.col("nh")) / 2)).withColumn("sx", F.floor((F.col("w") - F.col("nw")) / 2))
    b = b.select(*keys, (F.col("lx") + F.col("sx") * cell).alias("wx1"), (F.col("lx") + (F.col("sx") + F.col("nw")) * cell).alias("wx2"),
                 (F.col("hy") - (F.col("sy") + F.col("nh")) * cell).alias("wy1"), (F.col("hy") - F.col("sy") * cell).alias("wy2"))
    inside = lambda n: F.col(f"x{n}").between(F.col("wx1"), F.col("wx2")) & F.col(f"y{n}").between(F.col("wy1"), F.col("wy2"))
    return segments.join(b, list(keys)).where(inside(1) | inside(2)).select(*segments.columns)


def rasterise(segments: DataFrame, keys: Sequence[str], cell: float, buffer: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Blocked cells of line work per drawing, and the grid of each drawing.

    Grid: ``keys, min_x, max_x, min_y, max_y, cell_size, rows, cols``. Cells: ``keys, r, c``, each once.
    """
    b = segments.groupBy(*keys).agg(
        F.min(F.least("x1", "x2")).alias("lx"), F.max(F.greatest("x1", "x2")).alias("hx"), F.min(F.least("y1", "y2")).alias("ly"), F.max(F.greatest("y1", "y2")).alias("hy"))
    px, py = (F.col("hx") - F.col("lx")) * buffer, (F.col("hy") - F.col("ly")) * buffer
    grid = b.select(*keys, (F.col("lx") - px).alias("min_x"), (F.col("hx") + px).alias("max_x"), (F.col("ly") - py).alias("min_y"), (F.col("hy") + py).alias("max_y"), F.lit(cell).alias("cell_size"))
    count = lambda lo, hi: (((F.col(hi) - F.col(lo)) / cell).cast("int") + 1)
    grid = grid.withColumn("rows", count("min_y", "max_y")).withColumn("cols", count("min_x", "max_x"))
    col = lambda x: ((F.col(x) - F.col("min_x")) / cell).cast("int")
    row = lambda y: ((F.col("max_y") - F.col(y)) / cell).cast("int")
    s = segments.join(grid, list(keys)).select(*keys, row("y1").alias("r1"), col("x1").alias("c1"), row("y2").alias("r2"), col("x2").alias("c2"))
    line = F.when(F.struct(F.col("r1").alias("r"), F.col("c1").alias("c")) == F.struct(F.col("r2").alias("r"), F.col("c2").alias("c")),
                  F.array(F.struct(F.col("r1").alias("r"), F.col("c1").alias("c")))).otherwise(
        F.concat(F.array(F.struct(F.col("r1").alias("r"), F.col("c1").alias("c"))), sight_cells("r1", "c1", "r2", "c2")))
    cells = s.select(*keys, F.explode(line).alias("p")).select(*keys, "p.r", "p.c").distinct()
    return cells, grid
