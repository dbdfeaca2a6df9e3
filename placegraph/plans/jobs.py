"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegraph.functions import geo
from placegraph.operators import coverage, graph, naming, network, quality, raster, registration, routes, search
from placegraph.session import materialise
from placegraph.sources import sinks


def rebuild(nodes: DataFrame, links: DataFrame, spaces: DataFrame) -> dict[str, DataFrame]:
    """Search index and walking graph after edits.

    Tables: ``rooms, nodes, edges, places, unreachable, components, unknown_links, inferred``.
    """
    labelled, _ = materialise(network.label_nodes(nodes, network.space_labels(spaces)))
    steps, _ = materialise(network.stairwell_steps(labelled))
    edges, _ = materialise(network.build_edges(links, labelled, steps))
    return {
        "rooms": coverage.index_rooms(spaces), "nodes": labelled, "edges": edges, "places": network.place_rollup(labelled),
        "unreachable": network.unreachable_rooms(spaces, labelled), "components": graph.components(labelled, edges),
        "unknown_links": network.unknown_links(links, nodes), "inferred": steps}


def write_rebuild(tables: dict[str, DataFrame], root: str, version: int) -> None:
    sinks.write_rooms(tables["rooms"], f"{root}/rooms/version={version}")
    sinks.write_graph(tables["nodes"], tables["edges"], tables["places"], tables["unreachable"], f"{root}/graph", version)


def promote_and_audit(generated: DataFrame, live_root: str, nodes: DataFrame, links: DataFrame, footprints: DataFrame) -> dict[str, DataFrame]:
    """Promote generated spaces, rebuild, then audit alignment, overlap and stairs; raises when refused."""
    if not sinks.promote(generated, live_root):
        raise ValueError("the generated set lost over a tenth of the live rows")
    live = sinks.read_version(generated.sparkSession, live_root)
    out = rebuild(nodes, links, live)
    out["alignment"] = quality.alignment_audit(live, footprints)
    out["overlap"] = quality.overlap_audit(live.select("building", "floor", "ord", "ring"))
    out["stairs"] = quality.stair_stacking(live)
    return out


def name_network(nodes: DataFrame, spaces: DataFrame, rename: bool = False) -> DataFrame:
    return naming.name_network(nodes, spaces, rename)


def batch_directions(requests: DataFrame, nodes: DataFrame, edges: DataFrame, centres: DataFrame) -> dict[str, DataFrame]:
    """Requests to answers, points, sheets to show, legs and steps in words."""
    nodes, _ = materialise(nodes)
    edges, _ = materialise(edges)
    comps, _ = materialise(graph.components(nodes, edges))
    answers, points = routes.find_routes(requests, nodes, edges, comps, centres)
    legs, _ = materialise(routes.attribute_distances(routes.legs(points)))
    return {"answers": answers, "points": points, "sheets": routes.floor_per_building(points).orderBy("query_id", "at"), "legs": legs, "steps": routes.directions(legs)}


def typed_directions(asks: DataFrame, codes: DataFrame, names: DataFrame, nodes: DataFrame, edges: DataFrame, centres: DataFrame) -> dict[str, DataFrame]:
    """The directions form for a whole table: typed From and To to references, walks and steps in words.

    ``asks``: ``query_id, from_text, to_text`` and, where the asker's spot is known,
    ``lng, lat``; ``codes`` and ``names`` as in :func:`search.direction_ends`. An ask
    without From starts at the spot. Tables as of :func:`batch_directions`; the answers also
    hold asks that were not walked, with what is missing as their ``status``.
    """
    at = lambda c: (F.col(c) if c in asks.columns else F.lit(None)).cast("double")
    ends = search.direction_ends(asks.select("query_id", "from_text", "to_text"), codes, names)
    ends, _ = materialise(ends.join(asks.select("query_id", at("lng").alias("lng"), at("lat").alias("lat")), "query_id"))
    here = (F.col("status") == "from_here") & F.col("lng").isNotNull()
    known = ends.where((F.col("status") == "ok") | here)
    spot = lambda c: F.when(here, F.col(c)).alias(f"start_{c}")
    requests = known.select("query_id", F.coalesce(F.nullif("fallback", F.lit("")), F.regexp_extract("goal_ref", r"^([^-]*)", 1)).alias("building"),
                            F.when(~here, F.col("start_ref")).alias("start_ref"), spot("lng"), spot("lat"), "goal_ref")
    out = batch_directions(requests, nodes, edges, centres)
    refused = ends.join(known.select("query_id"), "query_id", "left_anti").select("query_id", "status")
    out["answers"] = out["answers"].unionByName(refused, allowMissingColumns=True)
    return out


def clean_labels(reads: DataFrame, shapes: DataFrame) -> DataFrame:
    """Label reads to graded rooms with shapes, overlaps that cannot be rooms left out.

    ``reads``: ``building, floor, ord, raw, area, anchor``; ``shapes``: ``building, floor, ord, ring``.
    """
    kinds = quality.classify_labels(reads.withColumn("raw", F.upper("raw")).drop("kind"))
    graded, _ = materialise(quality.graded_rooms(kinds).join(shapes, ["building", "floor", "ord"]))
    marked = quality.drop_overlaps(graded.select("building", "floor", "ord", "room", "ring"))
    keep = marked.where(~F.col("dropped")).select("building", "floor", "ord")
    return graded.join(keep, ["building", "floor", "ord"])


def register_plans(shapes: DataFrame, footprints: DataFrame, outlines: DataFrame | None = None, rounds: int = 12) -> DataFrame:
    """Fits of floor plans onto building footprints: ``building, floor, scale, theta, tx, ty, inside, own``.

    ``shapes``: ``building, floor, ord, ring`` in plan units; ``footprints``:
    ``building, ring`` in metres; ``outlines`` (``building, floor, ring``): the drawn
    outline to fit by, else the rooms' own points are. Every floor is fitted; the fit best for the whole
    building is shared, a floor under 85 % inside keeps its own when that gains
    over 5 %, and each is nudged at the end when that gains anything worth having.
    """
    keys = ["building", "floor"]
    samples, _ = materialise(quality.sample_points(shapes).select(*keys, "x", "y", "weight"))
    foot, _ = materialise(shapes.select(*keys).distinct().join(footprints.select("building", "ring"), "building"))
    outer = samples if outlines is None else outlines.select(*keys, F.explode("ring").alias("p")).select(*keys, "p.x", "p.y")
    plan_hull, _ = materialise(registration.convex_hulls(outer, keys))
    foot_hull, _ = materialise(registration.convex_hulls(foot.select(*keys, F.explode("ring").alias("p")).select(*keys, "p.x", "p.y"), keys))
    fits, _ = materialise(registration.icp(plan_hull, foot_hull, registration.turns(plan_hull, foot_hull, keys), keys, rounds))
    shares = registration.inside_share(samples, fits.select(*keys, "k", "scale", "theta", "tx", "ty"), foot, keys, ["k"])
    own, _ = materialise(registration.best_fit(fits, shares, keys))
    # Every floor's fit tried on every floor of its building (floors of a building are few).
    every = own.select("building", F.col("floor").alias("fit"), "scale", "theta", "tx", "ty", "residual").join(own.select(*keys), "building")
    score = registration.inside_share(samples, every.select(*keys, "fit", "scale", "theta", "tx", "ty"), foot, keys, ["fit"])
    score, _ = materialise(score.join(own.select("building", F.col("floor").alias("fit"), "residual"), ["building", "fit"]))
    chosen = registration.best_shared_fit(score).select("building", "fit")
    shared = own.select("building", F.col("floor").alias("fit"), *[F.col(c).alias("s_" + c) for c in ("scale", "theta", "tx", "ty")]).join(chosen, ["building", "fit"])
    j = own.join(shared, "building").join(score.select("building", "fit", "floor", F.col("inside").alias("s_inside")), ["building", "fit", "floor"])
    refit = (F.col("floor") != F.col("fit")) & (F.col("s_inside") < 0.85) & (F.col("inside") > F.col("s_inside") + 0.05)
    pick = lambda c: F.when(refit, F.col(c)).otherwise(F.col("s_" + c)).alias(c)
    base, _ = materialise(j.select(*keys, *[pick(c) for c in ("scale", "theta", "tx", "ty", "inside")], refit.alias("own")))
    nudged = registration.refine(samples, base, foot, keys).select(*keys, *[F.col(c).alias("n_" + c) for c in ("scale", "theta", "tx", "ty", "inside")])
    better = F.col("n_inside") > F.col("inside") + 0.005
    take = lambda c: F.when(better, F.col("n_" + c)).otherwise(F.col(c)).alias(c)
    return base.join(nudged, keys).select(*keys, *[take(c) for c in ("scale", "theta", "tx", "ty", "inside")], (F.col("own") | better).alias("own"))


def placed_shapes(shapes: DataFrame, fits: DataFrame) -> DataFrame:
    """Shapes under their floor's fit, rings closed."""
    j = shapes.join(fits.select("building", "floor", "scale", "theta", "tx", "ty"), ["building", "floor"])
    return j.select(*[c for c in shapes.columns if c != "ring"], geo.similarity("ring", F.col("scale"), F.col("theta"), F.col("tx"), F.col("ty")).alias("ring"))


def drawing_to_grid(vertices: DataFrame, keys: list[str], cell: float, erase: list[tuple[float, float, float, float]] = ()) -> tuple[DataFrame, DataFrame]:
    """Line work to an occupancy grid: lettering out, boxes erased, window cropped, cells marked."""
    entity = [*keys, "entity"]
    v = raster.drop_small(vertices, entity)
    for box in erase:
        v = raster.erase_box(v, *box, entity)
    return raster.rasterise(raster.crop_to_window(raster.drawing_segments(v, entity), keys, cell), keys, cell)
