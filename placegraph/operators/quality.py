"""Audits of traced floors, and rules that turn noisy label reads into graded rooms."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placegraph.functions import geo, text
from placegraph.functions.outside import area_outside
from placegraph.operators import pyramid, spatial
from placegraph.operators.common import first_by
from placegraph.session import materialise

SHEET = ["building", "floor"]
VERTICAL_TYPES = ("stairs", "elevator", "shaft")


def overlap_audit(shapes: DataFrame, least: float = 0.05) -> DataFrame:
    """Rooms, overlapping pairs, worst and total overlap of every floor. Touching edges do not count."""
    pairs = spatial.overlaps(shapes, SHEET).withColumn("frac", F.col("common") / F.least("a_area", "b_area")).where(F.col("frac") >= least)
    p = pairs.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("pairs"), F.max("frac").alias("worst"), F.sum("common").alias("shared"))
    t = shapes.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_rooms"), F.sum(geo.area("ring")).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return t.join(p, SHEET, "left").select(
        *SHEET, "n_rooms", F.coalesce("pairs", F.lit(0)).cast("bigint").alias("overlap_pairs"), zero("worst").alias("worst_overlap_frac"),
        F.when(F.col("total") > 0, zero("shared") / F.col("total")).otherwise(0.0).alias("total_overlap_area_frac"))


def sample_points(shapes: DataFrame, most: int = 24) -> DataFrame:
    """Points standing for each shape's area, for the search of a fit: its outline and its centre, at equal weight.

    An outline of more than ``most`` vertices is thinned evenly.
    """
    n = F.size("_open")
    open_ring = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    s = shapes.withColumn("_open", open_ring).withColumn("_area", geo.area("ring")).where("_area > 0")
    thin = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at("_open", (i * (n - 1) / (most - 1)).cast("int") + 1))
    pts = F.concat(F.when(n > most, thin).otherwise(F.col("_open")), F.array(geo.vertex_mean("_open")))
    s = s.withColumn("_pts", pts)
    return s.select(*[c for c in shapes.columns if c != "ring"], (F.col("_area") / F.size("_pts")).alias("weight"), F.posexplode("_pts").alias("i", "_p")).select(
        "*", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")).drop("_p")


def _outside(slack_m: float):
    """Column function: a shape's area and its area outside the parts, from their x and y and the parts' sizes."""
    @F.pandas_udf("area double, out double")
    def measured(xs: pd.Series, ys: pd.Series, part_xs: pd.Series, part_ys: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, px, py, n in zip(xs, ys, part_xs, part_ys, sizes):
            parts = np.split(np.stack([px, py], 1), np.cumsum(n)[:-1]) if len(n) else []
            rows.append(area_outside(np.stack([x, y], 1), parts, slack_m))
        return pd.DataFrame(rows, columns=["area", "out"])

    return measured.asNondeterministic()  # else a filter on the area measures every shape once more


def alignment_audit(shapes: DataFrame, footprints: DataFrame, slack_m: float = 2.0, bad_pct: float = 15.0) -> DataFrame:
    """Share of each floor's area outside its building's footprint, exact.

    ``shapes``: ``building, floor, ord, ring``; ``footprints``: ``building, ring``,
    all in degrees. The footprint is all of a building's rings, widened by the slack
    with round corners. Shapes without area do not count; ``ord`` is unique on a floor. A building without a footprint gives ``measurable`` false.
    """
    f = footprints.select(F.upper(F.trim("building")).alias("b"), "ring").where(F.size("ring") >= 4)
    verts = f.select("b", F.explode("ring").alias("p"))
    origin = verts.groupBy("b").agg(F.avg("p.x").alias("x0"), F.avg("p.y").alias("y0"))
    local = lambda ring: geo.map_ring(ring, lambda x, y: geo.local_x(x, F.col("x0"), F.col("y0")), lambda x, y: geo.local_y(y, F.col("y0")))
    foot = f.join(origin, "b").select("b", local("ring").alias("ring"))
    s = shapes.select(*SHEET, "ord", F.upper("building").alias("b"), "ring").join(origin, "b", "left")
    flat = s.where("x0 IS NOT NULL").select(*SHEET, "ord", "b", local("ring").alias("ring")).where(F.size("ring") > 0)
    # A row for each shape and footprint ring near it. A shape that one ring holds is inside, one that none meets is outside;
    # only shapes on a border go to the kernel, with the rings near them.
    met = spatial.meeting_boxes(flat, foot.withColumn("edges", geo.edges("ring")), ["b"], slack_m)
    met = met.withColumn("held", geo.holds("b_edges", "a_ring"))
    per = met.groupBy(F.col("a_b").alias("b"), F.col("a_building").alias("building"), F.col("a_floor").alias("floor"), F.col("a_ord").alias("ord")).agg(
        F.bool_or("held").alias("held"), F.collect_list(F.when(~F.col("held"), F.col("b_ring"))).alias("near"))
    sized = flat.join(per, ["b", *SHEET, "ord"], "left").withColumn("area", geo.area("ring"))
    flat_parts = F.flatten("near")
    border = sized.where("held = false").select(*SHEET, _outside(slack_m)(geo.xs("ring"), geo.ys("ring"), geo.xs(flat_parts), geo.ys(flat_parts),
                                                                         F.transform("near", lambda r: F.size(r))).alias("_m")).select(*SHEET, "_m.area", "_m.out")
    plain = sized.where("held IS NULL OR held").select(*SHEET, "area", F.when(F.col("held"), F.lit(0.0)).otherwise(F.col("area")).alias("out"))
    room = plain.unionByName(border).where("area > 0")
    floors = room.groupBy(*SHEET).agg((F.sum("out") / F.sum("area") * 100).alias("pct_area_outside"),
                                      F.count_if(F.col("out") > F.col("area") / 2).alias("rooms_mostly_outside"), F.count(F.lit(1)).alias("polygons"))
    missing = s.where("x0 IS NULL").select(*SHEET).distinct()
    out = floors.withColumn("measurable", F.lit(True)).unionByName(missing.withColumn("measurable", F.lit(False)), allowMissingColumns=True)
    return out.withColumn("bad", F.coalesce(F.col("pct_area_outside") > bad_pct, F.lit(False)))


def worst_first(report: DataFrame, column: str, least: float | None = None) -> DataFrame:
    """Rows of a report, worst first; those below ``least`` left out if it is given."""
    kept = report if least is None else report.where(F.col(column) >= least)
    return kept.orderBy(F.col(column).desc(), *SHEET)


def stair_stacking(shapes: DataFrame, match_m: float = 8.0) -> DataFrame:
    """How well shafts stack over the lowest floor of each building.

    A shaft of the lowest floor matches the nearest one of each other floor
    within ``match_m``; the rest only say that a shaft was not seen. Median is
    the upper one. ``shapes``: ``building, floor, ord, type, ring`` in degrees.
    """
    v = shapes.select("building", "floor", "ord", "type", "ring")
    pts = v.select("building", "floor", F.explode("ring").alias("p")).groupBy("building", "floor").agg(F.avg("p.x").alias("cx"), F.avg("p.y").alias("cy"))
    shafts = v.where(F.col("type").isin(*VERTICAL_TYPES)).select("building", "floor", "ord", geo.vertex_mean("ring").alias("m"))
    floors = pts.join(shafts.groupBy("building", "floor").agg(F.count(F.lit(1)).alias("n")), SHEET, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    floors = floors.withColumn("_k", F.struct(F.length("floor").alias("l"), F.col("floor").alias("f")))
    base = floors.groupBy("building").agg(F.min_by(F.struct("floor", "cx", "cy", "n"), "_k").alias("b"), F.count(F.lit(1)).alias("floors"),
                                          F.sort_array(F.collect_list(F.struct("_k", "n"))).alias("_per")).where("floors >= 2")
    base = base.select("building", "floors", F.transform("_per", lambda s: s["n"]).alias("verticals_per_floor"), "b.floor", "b.cx", "b.cy", "b.n").withColumnsRenamed(
        {"floor": "b_floor", "cx": "bx", "cy": "by", "n": "b_n"})
    drift = floors.join(base, "building").where(F.col("floor") != F.col("b_floor")).groupBy("building").agg(
        F.max(F.hypot(geo.local_x("cx", F.col("bx"), F.col("by")), geo.local_y("cy", F.col("by")))).alias("drift"), F.count(F.lit(1)).alias("others"))
    at = shafts.join(base.select("building", "b_floor", "bx", "by"), "building").select(
        "building", "floor", "ord", "b_floor", geo.local_x("m.x", F.col("bx"), F.col("by")).alias("x"), geo.local_y("m.y", F.col("by")).alias("y"))
    low = at.where(F.col("floor") == F.col("b_floor")).select("building", "ord", "x", "y")
    rest = at.where(F.col("floor") != F.col("b_floor")).select("building", "floor", "x", "y")
    near = spatial.within_reach(low, rest, match_m, on=["building"]).groupBy("building", "ord", "t_floor").agg(F.min("d").alias("d"))
    # Ranked by distance: the upper median is the row half way up, no list needed.
    matched = near.groupBy("building").agg(F.count(F.lit(1)).alias("matched"), F.max("d").alias("worst"))
    seq = near.join(matched, "building").withColumn("_rn", F.row_number().over(Window.partitionBy("building").orderBy("d", "ord", "t_floor")))
    mid = seq.where(F.col("_rn") == F.floor(F.col("matched") / 2) + 1).select("building", F.col("d").alias("median"))
    out = base.join(drift, "building").join(matched, "building", "left").join(mid, "building", "left")
    m = F.coalesce("matched", F.lit(0))
    return out.select("building", "floors", "verticals_per_floor", m.alias("matched"), (F.col("b_n") * F.col("others") - m).alias("unmatched"),
                      F.round("median", 2).alias("matched_median_m"), F.round("worst", 2).alias("matched_worst_m"), F.round("drift", 1).alias("center_drift_m"))


def extraction_report(rooms: DataFrame) -> DataFrame:
    """Features, doors, high-confidence and to-review rooms of every floor; an unknown residual is NULL."""
    return rooms.groupBy(*SHEET).agg(
        F.count_if(F.col("type") != "door").alias("features"), F.count_if(F.col("type") == "door").alias("doors"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"), F.count_if((F.col("type") != "door") & (F.col("confidence") != "high")).alias("needs_review"),
        F.max(F.when(~F.isnan("residual"), F.col("residual"))).alias("residual_m"))


# -- label reads --------------------------------------------------------------

# Words on a plan and the type each stands for, most specific first.
KEYWORDS = {
    "STAIR": "stairs", "ESCALATOR": "stairs", "ELEV": "elevator", "CORRIDOR": "corridor", "CORR": "corridor",
    "LOBBY": "corridor", "VESTIBULE": "corridor", "SHAFT": "shaft", "MECH": "mech", "ELEC": "elec", "JANITOR": "service",
    "WASH-RM": "washroom", "WASHRM": "washroom", "STOR-GEN": "storage", "STOR": "storage", "CLASS": "room", "OFFICE": "room", "LAB": "room",
}


#: Likeness of a word to a keyword, of 1, that makes it one.
LIKE = 0.7
#: Characters of the longest word that can be so like a keyword: all of the keyword's would have to be in it.
LONGEST = int(max(map(len, KEYWORDS)) * (2 / LIKE - 1))


def _letters(words: pd.Series) -> np.ndarray:
    """How often each letter of the keywords is in each word."""
    return np.stack([words.str.count(re.escape(c)).to_numpy(dtype=np.int64) for c in sorted(set("".join(KEYWORDS)))], axis=1)


@F.pandas_udf(StringType())
def _fuzzy_kind(words: pd.Series) -> pd.Series:
    """Type of a word by similarity of at least 0.7 to a keyword.

    Letters in common bound the similarity from above, so only words that share enough of
    a keyword's letters are compared in order.
    """
    out = np.full(len(words), None, dtype=object)
    if not len(words):
        return pd.Series(out)
    have, need, sizes = _letters(words), _letters(pd.Series(list(KEYWORDS))), words.str.len().to_numpy(dtype=np.int64)
    for (k, v), n in zip(KEYWORDS.items(), need):
        near = 2.0 * np.minimum(have, n).sum(axis=1) / (sizes + len(k)) >= LIKE
        for i in np.flatnonzero(near & (out == None)):  # noqa: E711
            if difflib.SequenceMatcher(None, words.iloc[i], k).ratio() >= LIKE:
                out[i] = v
    return pd.Series(out)


_fuzzy_kind = _fuzzy_kind.asNondeterministic()  # else the test of its answer moves below the distinct, and every word of every label is compared


def classify_labels(reads: DataFrame, raw: str = "raw", name: str = "kind", key: str | None = None) -> DataFrame:
    """Type of each label: a keyword inside it, else a word much like one, else a room.

    Only distinct words of labels without a keyword reach Python, and of these only such
    as are short enough to be like one; the few that are like one are written, so that the
    words of labels meet a small table. Answers are joined back by ``key``, which tells
    labels apart; without one by the label itself.
    """
    exact = None
    for word, kind in KEYWORDS.items():
        hit = F.contains(F.col(raw), F.lit(word))
        exact = F.when(hit, kind) if exact is None else exact.when(hit, kind)
    r = reads.withColumn("_exact", exact).withColumn("_id", F.col(key or raw))
    found = F.regexp_extract_all(raw, F.lit(r"([A-Z][A-Z\-]{2,})"), F.lit(1))
    loose = r.where(F.col("_exact").isNull()).select("_id", F.posexplode(found).alias("i", "word")).where(F.length("word") <= LONGEST)
    words, _ = materialise(loose.select("word").distinct().withColumn("k", _fuzzy_kind("word")).where("k IS NOT NULL"))
    near = loose.join(words, "word").groupBy("_id").agg(F.min_by("k", "i").alias("_near"))
    return r.join(near, "_id", "left").withColumn(name, F.coalesce("_exact", "_near", F.lit("room"))).select(*reads.columns, name)


def _first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key, the one seen first on a tie."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("a"), "_o", F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value))


def graded_rooms(reads: DataFrame) -> DataFrame:
    """Numbered, graded rooms from label reads: ``building, floor, ord, raw, kind, area, anchor``.

    A number as long as the floor's usual one is kept, a longer one cut to it, a
    shorter one dropped; a number whose first digit contradicts its floor goes
    with its row; the rest is graded by the floor's own number lengths and
    prefixes, as read from unambiguous labels. Equal numbers keep the largest shape.
    """
    r = reads.withColumn("number", text.digits_read("raw"))
    usual = _first_mode(r.where("number IS NOT NULL").withColumn("usual", F.length("number")), SHEET, "usual", "ord")
    r = r.join(usual, SHEET, "left")
    number = F.when(F.length("number") >= F.col("usual"), F.substr("number", F.lit(1), F.col("usual")))
    r = r.withColumn("number", text.stairs_tag(number, F.col("kind")))
    r = r.withColumn("room", F.when(~F.col("kind").isin("stairs", "elevator"), F.col("number")))
    wrong = F.col("floor").rlike(r"^\d+$") & F.col("room").rlike(r"^\d") & (F.substring("room", 1, 1) != F.substring("floor", 1, 1))
    r = r.where(~F.coalesce(wrong, F.lit(False)))
    sure = r.where(F.col("anchor") & F.col("room").isNotNull())
    expected = _first_mode(sure.withColumn("expected", F.length("room")), SHEET, "expected", "ord")
    pre = sure.where(F.col("room").rlike(r"^\d+$")).groupBy(*SHEET, F.substring("room", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    twice = pre.groupBy(*SHEET).agg(F.max(F.col("n") >= 2).alias("twice"))
    common = pre.join(twice, SHEET).where((F.col("n") >= 2) | ~F.col("twice")).select(*SHEET, "prefix", F.lit(True).alias("is_common"))
    r = r.withColumn("prefix", F.substring("room", 1, 2)).join(expected, SHEET, "left").join(common, [*SHEET, "prefix"], "left").join(twice, SHEET, "left")
    fits = F.col("room").rlike(r"^\d{2,5}$") & (F.col("expected").isNull() | (F.length("room") == F.col("expected")))
    grade = (F.when(F.col("room").isNull(), "low").when(F.col("room").rlike(r"^S\d{3}$"), "medium")
             .when(fits & (F.col("is_common") | F.col("twice").isNull()), "high").when(fits, "medium"))
    kept = r.withColumn("confidence", grade).where("confidence IS NOT NULL").withColumn("_big", -F.col("area"))
    cols = ["building", "floor", "ord", "kind", "room", "area", "confidence"]
    best = first_by(kept.where("room IS NOT NULL"), [*SHEET, "room"], ["_big", "ord"], ["ord", "kind", "area", "confidence"])
    return kept.where("room IS NULL").select(*cols).unionByName(best.select(*cols))


def drop_overlaps(shapes: DataFrame, least: float = 0.3) -> DataFrame:
    """Shapes that overlap too much to be rooms, marked ``dropped``.

    An unnumbered shape goes when it overlaps anything; a numbered one when it is
    over three times its floor's median and swallows at least two numbered ones.
    ``shapes``: ``building, floor, ord, room, ring``.
    """
    s = shapes.withColumn("_area", geo.area("ring"))
    hits = spatial.overlaps(shapes, SHEET).where(F.col("common") / F.least("a_area", "b_area") >= least)
    both = hits.select(*SHEET, F.col("a_ord").alias("ord"), F.col("b_ord").alias("other")).unionByName(
        hits.select(*SHEET, F.col("b_ord").alias("ord"), F.col("a_ord").alias("other")))
    numbered = s.where(text.filled("room")).select(*SHEET, F.col("ord").alias("other"), F.lit(1).alias("one"))
    met = both.join(numbered, [*SHEET, "other"], "left").groupBy(*SHEET, "ord").agg(F.count(F.lit(1)).alias("all"), F.sum("one").alias("labelled"))
    median = s.where(text.filled("room")).groupBy(*SHEET).agg(F.percentile("_area", F.lit(0.5)).alias("median"))
    j = s.join(met, [*SHEET, "ord"], "left").join(median, SHEET, "left")
    drop = F.col("all").isNotNull() & (~text.filled("room") | ((F.col("median") > 0) & (F.col("_area") > 3 * F.col("median")) & (F.coalesce("labelled", F.lit(0)) >= 2)))
    return j.select(*shapes.columns, F.coalesce(drop, F.lit(False)).alias("dropped"))


def trim_off_plan(shapes: DataFrame, outlines: DataFrame, margin: float = 0.01) -> DataFrame:
    """Regions whose centre is off the floor's outline, marked ``dropped``; a floor losing over half keeps all.

    ``outlines``: ``building, floor, ring``, one per floor.
    """
    o = outlines.select(*SHEET, geo.edges("ring").alias("_e"), geo.box("ring").alias("_b"))
    j = shapes.join(o, SHEET, "left").withColumn("_m", geo.vertex_mean("ring"))
    slack = margin * F.hypot(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"))
    off = F.coalesce(geo.distance_to_shape("_e", "_m.x", "_m.y") > slack, F.lit(False))
    j = j.withColumn("_off", off)
    guard = j.groupBy(*SHEET).agg((F.count_if("_off") > F.count(F.lit(1)) * 0.5).alias("_bad"))
    return j.join(guard, SHEET).select(*shapes.columns, (F.col("_off") & ~F.col("_bad")).alias("dropped"))


def attach_labels(labels: DataFrame, regions: DataFrame, reach: float = 60.0) -> DataFrame:
    """Each label with the region under it, else the nearest within reach: ``label_id, region``."""
    near = spatial.nearest_shapes(labels, regions.select(*SHEET, "ord", "ring"), reach, "label_id", 1, on=[(k, k) for k in SHEET])
    return labels.join(near.select("label_id", F.col("s_ord").alias("region")), "label_id", "left")


def nearest_owner(items: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """The owner with the nearest centre for each item, the lowest on a tie, by tiles of each key's owners.

    ``items``: ``keys, ord, x, y`` (ord unique); ``owners``: ``keys, owner, ox, oy``.
    """
    d = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    got = pyramid.nearest_by_tiles(items.select(*keys, "ord", "x", "y"), owners, "ord", [F.col("x"), F.col("y")], [F.col("ox"), F.col("oy")], d, ["owner"], on=keys)
    return got.select(*keys, "ord", "owner")


def absorb_regions(regions: DataFrame, touching: DataFrame) -> DataFrame:
    """Unlabelled regions joined to the labelled one they belong to: ``ord, owner``.

    Unlabelled regions that touch form a group; a group touching one labelled
    region joins it, one touching several splits to the nearest centres.
    ``regions``: ``ord, labelled, x, y`` (ord unique); ``touching``: ``a, b``.
    """
    from placegraph.operators import graph

    loose = regions.where(~F.col("labelled")).select(F.col("ord").cast("string").alias("nid"), "ord")
    pairs = touching.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    groups = graph.components(loose, pairs).select("ord", "component")
    both = touching.unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b")))
    owner = regions.where("labelled").select(F.col("ord").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = groups.join(both, F.col("ord") == F.col("a")).join(owner, "b").select("component", F.col("b").alias("owner"), "ox", "oy").distinct()
    items = groups.join(regions.select("ord", "x", "y"), "ord")
    return nearest_owner(items, met, ["component"]).select("ord", "owner")


def cluster_glyphs(boxes: DataFrame, keys: list[str], wide: float = 2.2, tall: float = 1.8) -> DataFrame:
    """Glyph boxes near enough to be one label: ``ord, cluster, line`` with lines numbered from the top.

    ``boxes``: ``keys, ord, x0, y0, x1, y1``. Gaps are multiples of the sheet's median height.
    """
    from placegraph.operators import graph

    med = boxes.groupBy(*keys).agg(F.percentile(F.col("y1") - F.col("y0") + 1, F.lit(0.5)).alias("h"))
    b = boxes.join(med, keys)
    grown = b.select(*keys, "ord", geo.rectangle(F.col("x0") - F.col("h") * wide / 2, F.col("y0") - F.col("h") * tall / 2,
                                                 F.col("x1") + F.col("h") * wide / 2, F.col("y1") + F.col("h") * tall / 2).alias("ring"))
    pairs = spatial.overlapping_boxes(grown, keys).select(F.col("a_ord").cast("string").alias("a"), F.col("b_ord").cast("string").alias("b"))
    comp = graph.components(boxes.select(F.col("ord").cast("string").alias("nid"), "ord"), pairs).select("ord", F.col("component").alias("cluster"))
    w = Window.partitionBy("cluster").orderBy("y0", "ord")
    j = boxes.join(comp, "ord").withColumn("_new", F.when(F.coalesce(F.col("y0") - F.lag("y0").over(w) < F.col("y1") - F.col("y0") + 1, F.lit(False)), 0).otherwise(1))
    return j.withColumn("line", F.sum("_new").over(w)).select("ord", "cluster", "line")
