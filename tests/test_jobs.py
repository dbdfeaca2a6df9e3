"""Readers, sinks, streams, rasters, auto-linking, registration and whole jobs."""

import json
import math
import random

from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.functions import clock, geo
from placegraph.operators import activity, autolink, changes, coverage, network, quality, raster, registration
from placegraph.plans import jobs
from placegraph.sources import features as R
from placegraph.sources import sinks
from placegraph.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def _feature(props, geometry):
    return {"type": "Feature", "properties": props, "geometry": geometry}


def _square(x, y, w=1.0):
    return [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]


# -- readers and sinks --------------------------------------------------------

def test_read_documents(spark, tmp_path):
    node = lambda nid, x, **p: _feature({"type": "node", "nid": nid, **p}, {"type": "Point", "coordinates": [x, 1.0]})
    net = {"type": "FeatureCollection", "version": 4, "features": [
        node("a", 0.123456789, building="B1", floor=""), node("a", 5.0), node("", 1.0), _feature({"type": "path", "nodes": ["a", "b"], "metres": 3.5}, {"type": "LineString", "coordinates": [[0, 1], [1, 1]]})]}
    sheet = {"type": "FeatureCollection", "links": [{"nodes": ["a", "s"], "metres": 9}], "features": [
        _feature({"type": "room", "room": "100", "name": "Gym", "odd": [1]}, {"type": "Polygon", "coordinates": _square(0, 0) + _square(0.2, 0.2, 0.1)}),
        _feature({"type": "room", "room": "101"}, {"type": "MultiPolygon", "coordinates": [_square(2, 0), _square(4, 0)]}), node("s", 2.0, building="XX")]}
    docs = {"net.geojson": net, "B1-Floor2.geojson": sheet, "topo.json": {"type": "Topology", "arcs": []}, "lone.json": _feature({}, {"type": "Point", "coordinates": [1, 2]}),
            "bare.json": {"type": "Polygon", "coordinates": _square(0, 0)}, "many.json": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}}
    for name, d in docs.items():
        (tmp_path / name).write_text(json.dumps(d))
    (tmp_path / "broken.json").write_text("{nope")
    feats, rejects = R.normalise_roots(R.read_documents(spark, str(tmp_path)))
    assert dict(rows(rejects)) == {"topo.json": "TopoJSON", "broken.json": "not a JSON document"}
    f = R.parse_features(feats)
    assert {r.source: r.n for r in f.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"net.geojson": 4, "B1-Floor2.geojson": 3, "lone.json": 1, "bare.json": 1, "many.json": 1}
    net_f, sheet_f = f.where("source = 'net.geojson'"), f.where("source LIKE '%Floor%'")
    n = network.collect_nodes(R.network_nodes(net_f), R.network_nodes(sheet_f, from_sheet=True))
    assert rows(n, "nid", "building", "floor", "lng") == [("a", "B1", None, 0.1234568), ("s", "B1", "2", 2.0)]
    assert rows(R.network_links(net_f), "a", "b", "metres") == [("a", "b", 3.5)]
    assert rows(R.document_links(R.read_documents(spark, str(tmp_path / "B1-Floor2.geojson"))), "a", "b", "metres") == [("a", "s", 9.0)]
    sp = R.sheet_spaces(sheet_f)
    assert rows(sp.select("building", "floor", "room", geo.area("ring"))) == [("B1", "2", "100", 1.0), ("B1", "2", "101", 1.0), ("B1", "2", "101", 1.0)]
    assert rows(R.named_outlines(sheet_f, 0, "building", ["name", "room"]), "name", "display") == [("Gym", "100"), ("101", "101"), ("101", "101")][1:] + [("Gym", "100")]


def test_indexes_and_catalogue(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"B1": {"center": [1.0, 2.0]}, "B2": {"lng": 3.0, "lat": 4.0}}))
    assert rows(R.centre_index(R.read_documents(spark, str(tmp_path / "i.json")))) == [("B1", 1.0, 2.0), ("B2", 3.0, 4.0)]
    (tmp_path / "p.json").write_text(json.dumps({"B10-Floor1": {"width": 5, "height": 4}, "B2-Floor1": {"width": 1, "height": 1}}))
    cat = R.sheet_catalogue(R.read_documents(spark, str(tmp_path / "p.json")), spark.createDataFrame([("B2", "1")], "building string, floor string"))
    assert [(r.sheet, r.traced) for r in cat.collect()] == [("B2-Floor1", True), ("B10-Floor1", False)]


def test_write_and_read_back(spark, tmp_path):
    root = str(tmp_path)
    f = spark.createDataFrame([(0, "node", "a", None, None, "B1", 1.5, 2.5), (1, "path", None, "a", "b", None, None, None)], "ord int, type string, nid string, a string, b string, building string, lng double, lat double")
    assert sinks.write_network(f, root, 3, ["ord"]).first().rows == 2
    lines = R.parse_features(R.read_feature_lines(spark, f"{root}/lines/version=3").withColumn("version", F.lit(3)))
    assert rows(R.network_nodes(lines), "nid", "building", "lng", "lat") == [("a", "B1", 1.5, 2.5)]
    assert rows(R.network_links(lines), "a", "b") == [("a", "b")]
    assert sinks.read_version(spark, f"{root}/table").count() == 2 and sinks.versions(spark, f"{root}/table") == [3]
    big = spark.range(100)
    assert sinks.promote(big, f"{root}/live") and not sinks.promote(big.limit(89), f"{root}/live") and sinks.promote(big.limit(90), f"{root}/live")
    sheets = spark.createDataFrame([("B1", "1", "100"), ("B1", "2", "200")], "building string, floor string, room string")
    sinks.write_sheets(sheets, f"{root}/sheets")
    assert rows(R.read_sheet_table(spark, f"{root}/sheets", "B1", "2"), "room") == [("200",)]
    assert R.read_sheet_table(spark, f"{root}/sheets", "B9", "2").count() == 0
    place = lambda w, s: spark.createDataFrame([("B1-1", w, s)], "sheet string, width double, seq int")
    sinks.upsert_placements(spark, place(10.0, 1), f"{root}/place")
    assert sinks.versions(spark, f"{root}/place") == [1]


# -- streams ------------------------------------------------------------------

def _batches(spark, df, path, order, n=3):
    """The rows as n files, oldest first, read as a stream one file at a time."""
    data = df.orderBy(order).toPandas()
    size = -(-len(data) // n)
    for i in range(n):
        spark.createDataFrame(data[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/d")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/d")


def _collect(spark, stream, path, mode):
    name = f"t{abs(hash(path)) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _activity(spark):
    a = D.view(spark, SF, "activity").withColumn("user_id", F.concat(F.lit("u"), F.col("event_id") % 4))
    return a.withColumn("ts", F.col("ts").cast("timestamp"))


def test_favourites_stream_equals_batch(spark, tmp_path):
    a, root = _activity(spark), str(tmp_path / "t")
    S.keep_favourites(_batches(spark, a, str(tmp_path), "event_id"), root, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(S.current_favourites(spark, root)) == rows(activity.favourite_state(a))


def test_recents_and_throttle_streams_equal_batch(spark, tmp_path):
    a = _activity(spark)
    got = _collect(spark, S.recents(_batches(spark, a, str(tmp_path / "r"), "event_id")), str(tmp_path / "r"), "update")
    last = got.withColumn("i", F.monotonically_increasing_id()).groupBy("user_id", "rank").agg(F.max_by(F.struct("building", "floor", "room"), "event_id").alias("m"), F.max("event_id").alias("e"))
    want = {(r.user_id, r.building, r.room): r.floor for r in activity.recents(a).collect()}
    newest = {}
    for r in got.orderBy("event_id").collect():
        newest[(r.user_id, r.building, r.room)] = r.floor
    assert last.count() > 0 and {k: newest[k] for k in want} == want
    t = a.select("user_id", clock.micros("ts").alias("t"))
    gap = 3 * 3600 * 1_000_000
    end = spark.sql("SELECT 'zz' AS user_id, unix_micros(TIMESTAMP'2040-01-01 00:00:00') + id AS t FROM range(0, 5000000000000, 1000000000000)")
    passed = _collect(spark, S.throttled_touches(_batches(spark, t.unionByName(end), str(tmp_path / "k"), "t"), gap), str(tmp_path / "k"), "append")
    assert rows(passed.where("user_id <> 'zz'"), "user_id", "t") == rows(activity.throttle(t, gap), "user_id", "t")


def test_session_and_status_streams_equal_batch(spark, tmp_path):
    a = _activity(spark).withColumn("status", F.lit(200) + (F.col("event_id") % 3) * 100).select("user_id", "ts", "event_id", "status")
    end = spark.sql("SELECT 'zz' AS user_id, TIMESTAMP'2030-01-01 00:00:00' AS ts, 99999999L AS event_id, 200L AS status")
    both = a.unionByName(end)
    got = _collect(spark, S.sessions(_batches(spark, both, str(tmp_path / "s"), "ts", 4), "12 hours", "1 hour"), str(tmp_path / "s"), "append")
    want = activity.sessions(a.select("user_id", clock.micros("ts").alias("t")), 12 * 3600 * 1_000_000)
    assert rows(got.select("user_id", clock.micros("start").alias("s"), "events").where("user_id <> 'zz'")) == rows(want, "user_id", "start", "events")
    win = _collect(spark, S.status_windows(_batches(spark, both, str(tmp_path / "w"), "ts", 4), "1 day"), str(tmp_path / "w"), "append")
    assert win.where("start < '2029-01-01'").agg(F.sum("requests")).first()[0] == a.count()
    dup = _collect(spark, S.distinct_changes(_batches(spark, a.unionByName(a), str(tmp_path / "d"), "ts"), ["event_id"]), str(tmp_path / "d"), "append")
    assert dup.count() == a.count()


def test_change_stream_applies_rejects_and_repeats_nothing(spark, tmp_path):
    root, cols = str(tmp_path / "net"), ["type", "nid", "a", "b", "lng", "lat"]
    schema = "ord bigint, type string, nid string, a string, b string, lng double, lat double"
    sinks.write_version(spark.createDataFrame([(0, "node", "a", None, None, 1.0, 1.0), (1, "node", "b", None, None, 2.0, 1.0), (2, "path", None, "a", "b", None, None)], schema), f"{root}/table", 1)
    dschema = "op string, seq int, key string, type string, nid string, a string, b string, lng double, lat double, base_version int"
    d = spark.createDataFrame([("add", 0, None, "node", "c", None, None, 3.0, 1.0, 1), ("add", 1, None, "node", "d", None, None, None, 1.0, 1), ("remove", 2, "n:b", None, None, None, None, None, None, 2),
                               ("update", 3, None, "node", "a", None, None, 7.0, 1.0, 2), ("update", 4, None, "node", "a", None, None, 8.0, 1.0, 1)], dschema)
    src = str(tmp_path / "in")
    for ids in ((0, 1), (2,), (3, 4)):
        d.where(F.col("seq").isin(*ids)).coalesce(1).write.mode("append").parquet(src)
    stream = lambda c: S.ingest_changes(spark.readStream.schema(dschema).option("maxFilesPerTrigger", 1).parquet(src), root, cols, c).trigger(availableNow=True).start().awaitTermination(120)
    stream(str(tmp_path / "c1"))
    final = sinks.read_version(spark, f"{root}/table")
    assert {r.nid: r.lng for r in final.collect()} == {None: None, "a": 7.0, "b": 2.0, "c": 3.0}
    why = {r.seq: r.reason for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert why == {1: "NODE_WITHOUT_POINT", 2: "would break the network", 4: "version moved on"}
    before = sinks.versions(spark, f"{root}/table")
    stream(str(tmp_path / "c1"))  # nothing new
    assert sinks.versions(spark, f"{root}/table") == before
    stream(str(tmp_path / "c2"))  # a stream begun anew: every change was made against an older version
    assert sinks.versions(spark, f"{root}/table") == before and rows(sinks.read_version(spark, f"{root}/table")) == rows(final)


def test_change_stream_on_published_versions_and_after_a_cut(spark, tmp_path):
    root, cols = str(tmp_path / "net"), ["type", "nid", "a", "b", "lng", "lat"]
    schema = "ord bigint, type string, nid string, a string, b string, lng double, lat double"
    for v in (1, 2, 3):
        sinks.write_version(spark.createDataFrame([(0, "node", "p", None, None, float(v), 1.0)], schema), f"{root}/table", v)
    dschema = "op string, seq int, key string, type string, nid string, a string, b string, lng double, lat double, base_version int"
    change = lambda seq, base, lng: ("update", seq, None, "node", "p", None, None, lng, 1.0, base)
    src = str(tmp_path / "in")
    for c in (change(0, 1, 50.0), change(1, 3, 60.0)):
        spark.createDataFrame([c], dschema).coalesce(1).write.mode("append").parquet(src)
    sinks.write_version(spark.createDataFrame([(0, "node", "p", None, None, 99.0, 1.0)], schema), f"{root}/other", 1)
    stream = lambda c: S.ingest_changes(spark.readStream.schema(dschema).option("maxFilesPerTrigger", 1).parquet(src), root, cols, c).trigger(availableNow=True).start().awaitTermination(120)
    stream(str(tmp_path / "c1"))
    lng = lambda v=None: sinks.read_version(spark, f"{root}/table", v).first().lng
    assert lng() == 60.0 and [lng(v) for v in (1, 2, 3)] == [1.0, 2.0, 3.0]
    top = sinks.current_version(spark, f"{root}/table")
    # A run cut after writing a version: readers stay where they are and its number is not used again.
    sinks.write_version(spark.createDataFrame([(0, "node", "p", None, None, 77.0, 1.0)], schema), f"{root}/table", top + 1)
    assert lng() == 60.0
    spark.createDataFrame([change(2, top, 70.0)], dschema).coalesce(1).write.mode("append").parquet(src)
    stream(str(tmp_path / "c1"))
    assert lng() == 70.0 and sinks.current_version(spark, f"{root}/table") == top + 2 and lng(top + 1) == 77.0


def test_late_and_silent_touches_equal_batch(spark, tmp_path):
    hour = 3_600_000_000
    rows_ = [("u", t * hour) for t in (10, 14, 11, 13, 40, 41, 2000, 2001, 2004)] + [("v", 12 * hour), ("v", 12 * hour)]
    files = [[0, 9], [1, 2], [3, 10], [4], [5], [6, 7, 8]]
    src = str(tmp_path / "in")
    for f in files:
        spark.createDataFrame([rows_[i] for i in f], "user_id string, t bigint").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", 9000 * hour)], "user_id string, t bigint").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", 9100 * hour)], "user_id string, t bigint").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("user_id string, t bigint").option("maxFilesPerTrigger", 1).parquet(src)
    got = _collect(spark, S.throttled_touches(stream, 3 * hour, "6 hours"), str(tmp_path / "k"), "append").where("user_id <> 'z'")
    want = activity.throttle(spark.createDataFrame(rows_, "user_id string, t bigint"), 3 * hour)
    assert rows(got, "user_id", "t") == rows(want, "user_id", "t")


def test_due_and_critical_streams(spark, tmp_path):
    from placegraph.catalog import lookups
    from placegraph.operators import timetable

    t, c = lookups.ticks(spark, SF), lookups.classes(spark, SF)
    S.due_classes(_batches(spark, t, str(tmp_path / "t"), "tick_id"), c, str(tmp_path / "due"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "due")), "tick_id", "due", "status") == rows(timetable.due_now(t, c), "tick_id", "due", "status")
    log = D.table(spark, SF, "documents").select("doc_id", F.col("text").alias("message"))
    S.route_critical(_batches(spark, log, str(tmp_path / "l"), "doc_id"), str(tmp_path / "log"), str(tmp_path / "lc")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log/critical")).count() == log.where(activity.is_critical(F.col("message"))).count()


# -- raster -------------------------------------------------------------------

def test_smoothing_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    wall = {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.25}
    cells = spark.createDataFrame([("R", 1, r, c, (r, c) in wall) for r in range(14) for c in range(14)], "building string, floor int, r int, c int, blocked boolean")
    free = sorted({(r, c) for r in range(14) for c in range(14)} - wall)
    paths = {}
    for q in range(6):
        at, path = rng.choice(free), []
        for _ in range(25):
            path.append(("R", 1, *at))
            at = rng.choice([p for p in ((at[0] + 1, at[1]), (at[0] - 1, at[1]), (at[0], at[1] + 1), (at[0], at[1] - 1)) if p in set(free)] or [at])
        paths[q] = path

    def sight(p, q):
        if p[:2] != q[:2]:
            return False
        (r1, c1), (r2, c2) = p[2:], q[2:]
        if abs(r1 - r2) + abs(c1 - c2) <= 1:
            return True
        dr, dc, sr, sc = abs(r2 - r1), abs(c2 - c1), 1 if r1 < r2 else -1, 1 if c1 < c2 else -1
        r, c, err = r1, c1, max(dr, dc) / 2
        for _ in range(max(dr, dc)):
            err -= min(dr, dc)
            side = err < 0
            err += max(dr, dc) if side else 0
            if dr >= dc:
                r, c = r + sr, c + (sc if side else 0)
            else:
                r, c = r + (sr if side else 0), c + sc
            if (r, c) in wall:
                return False
        return True

    def smooth(path):
        out, start = [path[0]], path[0]
        for i in range(2, len(path)):
            if not sight(start, path[i]):
                if path[i - 1] != start:
                    out.append(path[i - 1])
                start = path[i - 1]
        return out + ([path[-1]] if out[-1] != path[-1] else [])

    df = spark.createDataFrame([(q, i, *p) for q, path in paths.items() for i, p in enumerate(path)], "query_id int, step bigint, building string, floor int, r int, c int")
    got = {}
    for r in raster.smooth_paths(df, cells, window=3).orderBy("query_id", "step").collect():
        got.setdefault(r.query_id, []).append((r.building, r.floor, r.r, r.c))
    dedupe = lambda p: [x for i, x in enumerate(p) if i == 0 or x != p[i - 1]]
    assert {q: dedupe(p) for q, p in got.items()} == {q: dedupe(smooth(p)) for q, p in paths.items()}


def test_growing_tables_of_raster_walks_are_not_sent_whole(spark, monkeypatch):
    from placegraph.operators import common, walks

    plans, wrote = [], raster.materialise

    def seen(df, **metrics):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return wrote(df, **metrics)

    for m in (raster, walks, common):
        monkeypatch.setattr(m, "materialise", seen)
    monkeypatch.setattr(common, "SENT", 3)  # of more rows than this nothing is sent
    wall = {(r, c) for r in range(12) for c in range(12) if r % 4 == 1 and c != 11 * (r // 4 % 2)}
    cells = spark.createDataFrame([("R", 1, r, c, (r, c) in wall) for r in range(12) for c in range(12)], "building string, floor int, r int, c int, blocked boolean")
    cells, _ = wrote(cells)
    none = cells.where("r < 0")
    entrances = none.select("building", "floor", F.lit("x").alias("label"), "r", "c", F.lit(0).alias("ord"))
    portals = none.select("building", "floor", F.lit("x").alias("entrance"), F.col("building").alias("to_building"), F.col("floor").alias("to_floor"), F.lit("x").alias("to_entrance"))
    moves = raster.arcs(cells, none.select("building", F.lit("A").alias("name"), "floor", "r", "c"), portals, entrances)
    plans.append(moves._jdf.queryExecution().executedPlan().toString())
    want = {(f"R|1|{r}|{c}", f"R|1|{y}|{x}") for r in range(12) for c in range(12) for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1))
            if 0 <= y < 12 and 0 <= x < 12 and (y, x) not in wall}
    got = [tuple(x) for x in moves.select("a", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    assert plans and not any("Broadcast" in p for p in plans)
    plans.clear()
    ends = lambda r, c: spark.createDataFrame([(q, f"R|1|{r}|{c}") for q in range(8)], "query_id int, nid string")
    answers, path = raster.shortest_paths(moves, ends(0, 0), ends(11, 11))
    assert {x.cost for x in answers.collect()} == {2 * 11 + 11.0 + 11}
    plans.clear()
    part = F.split("cell", r"\|")
    path = path.select("query_id", "step", part[0].alias("building"), *[part[i + 1].cast("int").alias(n) for i, n in enumerate(("floor", "r", "c"))])
    kept = raster.smooth_paths(path, cells)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert kept.where("query_id = 0").count() > 2
    assert not any("Broadcast" in p for p in plans[1:])  # the first reads the names of the path's nodes


def test_labels_portals_and_pairs(spark):
    meta = spark.createDataFrame([("R", 1, 0.0, 10.0, 2.0)], "building string, floor int, min_x double, max_y double, cell_size double")
    lab = spark.createDataFrame([("R", 1, " Stairs NW ", 3.0, 9.0), ("R", 1, "EntranceEast", 0.5, 0.5), ("R", 1, "1 02", 5.0, 5.0), ("R", 1, "lobby", 1.0, 1.0)], "building string, floor int, label string, x double, y double")
    assert rows(raster.labels_to_cells(lab, meta), "kind", "name", "r", "c") == [("entrance", "entranceeast", 4, 0), ("room", "1 02", 2, 2), ("stairs", "NW", 0, 1)]
    con = spark.createDataFrame([("R", 1, [["EntranceEast", "EntranceWest"]], ["S"], ["F2"])], "building string, floor int, entrances array<array<string>>, buildings array<string>, floors array<string>")
    assert tuple(raster.portal_rows(con).first()) == ("R", 1, "entranceeast", "S", 2, "entrancewest")
    at = lambda d: spark.createDataFrame(d, "query_id int, ord int, building string, floor int, r int, c int")
    assert tuple(raster.closest_label_pair(at([(1, 0, "R", 1, 0, 0), (1, 1, "R", 2, 5, 5)]), at([(1, 0, "S", 2, 5, 5), (1, 1, "R", 2, 9, 9)])).first()) == (1, 8, 1, 1)


# -- auto-linking, labels, registration ---------------------------------------

def test_autolink_joins_every_sheet_by_the_best_pairs(spark):
    rng = random.Random(11)
    pts = [(f"n{i:02d}", i, rng.random() / 500, 49 + rng.random() / 500) for i in range(24)]
    nodes = spark.createDataFrame([("B", "1", *p) for p in pts], "building string, floor string, nid string, ord int, lng double, lat double")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(0, 20, 2)], "a string, b string")
    none = spark.createDataFrame([], "building string, floor string, type string, ring array<struct<x:double,y:double>>")

    def dist(a, b):
        (x1, y1), (x2, y2) = a[2:], b[2:]
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6378137 * math.asin(math.sqrt(h))

    comp = {p[0]: p[0] for p in pts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(0, 20, 2):
        comp[find(f"n{i + 1:02d}")] = find(f"n{i:02d}")
    want = set()
    for p in pts[20:]:
        o = min((q for q in pts if q != p), key=lambda q: dist(p, q))
        want.add(tuple(sorted((p[0], o[0]))))
    for a, b in want:
        comp[find(a)] = find(b)
    for _, a, b in sorted((dist(p, q), p[0], q[0]) for i, p in enumerate(pts) for q in pts[i + 1:]):
        if find(a) != find(b):
            comp[find(a)] = find(b)
            want.add((a, b))
    assert set(rows(autolink.autolink(nodes, edges, none), "a", "b")) == want


def test_a_clear_run_beats_a_shorter_one_through_a_wall(spark):
    ring = lambda x0, y0, x1, y1: [dict(x=x / 1e5, y=y / 1e5) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    spaces = spark.createDataFrame([("B", "1", "room", ring(0, 0, 100, 10)), ("B", "1", "room", ring(0, 15, 10, 25))], "building string, floor string, type string, ring array<struct<x:double,y:double>>")
    pts = [("a", 0, 5, 8), ("b", 1, 90, 5), ("c", 2, 5, 18)]
    nodes = spark.createDataFrame([("B", "1", n, i, x / 1e5, y / 1e5) for n, i, x, y in pts], "building string, floor string, nid string, ord int, lng double, lat double")
    got = {(r.a, r.b): r.blocked for r in autolink.autolink(nodes, nodes.limit(0).select(F.col("nid").alias("a"), F.col("nid").alias("b")), spaces).collect()}
    assert got == {("a", "b"): False, ("a", "c"): True}


def test_label_kinds_and_attachment(spark):
    reads = spark.createDataFrame([("SSIAIR 5",), ("AHAFT",), ("2475 STUDIO",), ("ZZZ",), ("ESCALATOR",)], "raw string")
    assert dict(rows(quality.classify_labels(reads))) == {"SSIAIR 5": "stairs", "AHAFT": "shaft", "2475 STUDIO": "room", "ZZZ": "room", "ESCALATOR": "stairs"}
    box = lambda x: [dict(x=float(a), y=float(b)) for a, b in ((x, 0), (x + 10, 0), (x + 10, 10), (x, 10), (x, 0))]
    regions = spark.createDataFrame([("B", "1", 1, box(0)), ("B", "1", 2, box(100))], "building string, floor string, ord int, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([("B", "1", "in", 5.0, 5.0), ("B", "1", "near", 90.0, 5.0), ("B", "1", "far", 300.0, 5.0)], "building string, floor string, label_id string, x double, y double")
    assert {r.label_id: r.region for r in quality.attach_labels(labels, regions).collect()} == {"in": 1, "near": 2, "far": None}
    glyphs = spark.createDataFrame([(1, 0, 0, 5, 9, "s"), (2, 8, 0, 13, 9, "s"), (3, 0, 14, 5, 23, "s"), (4, 200, 0, 205, 9, "s")], "ord int, x0 int, y0 int, x1 int, y1 int, sheet string")
    assert rows(quality.cluster_glyphs(glyphs, ["sheet"])) == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 4, 1)]


def test_registration_finds_a_known_placement(spark):
    plan = [(0, 0), (60, 0), (60, 20), (25, 20), (25, 45), (0, 45)]
    turn = math.radians(90)  # the starting scale compares boxes, so a quarter turn keeps it exact
    place = lambda x, y: (2 * (math.cos(turn) * x - math.sin(turn) * y) + 500, 2 * (math.sin(turn) * x + math.cos(turn) * y) - 200)
    ring = lambda pts: [dict(x=float(x), y=float(y)) for x, y in pts + pts[:1]]
    rooms = [[(2, 2), (58, 2), (58, 18), (2, 18)], [(2, 22), (23, 22), (23, 43), (2, 43)]]
    schema = "building string, floor string, ord int, ring array<struct<x:double,y:double>>"
    shapes = spark.createDataFrame([("B", f, i, ring(r)) for f in "12" for i, r in enumerate(rooms)], schema)
    drawn = spark.createDataFrame([("B", f, 0, ring(plan)) for f in "12"], schema)
    foot = spark.createDataFrame([("B", ring([place(x, y) for x, y in plan]))], "building string, ring array<struct<x:double,y:double>>")
    fit = jobs.register_plans(shapes, foot, drawn, rounds=4).where("floor = '1'").first()
    assert abs(fit.scale - 2) < 0.01 and abs(math.remainder(fit.theta - turn, 2 * math.pi)) < 0.1 and fit.inside > 0.99
    assert spark.range(1).select(registration.scale_candidates(F.lit("SCALE 1200")).alias("s")).first().s == [200]


def test_hulls_of_split_groups(spark):
    rng = random.Random(1)
    pts = [("g", rng.randint(0, 50) * 1.0, rng.randint(0, 50) * 1.0) for _ in range(400)]
    got = rows(registration.convex_hulls(spark.createDataFrame(pts, "k string, x double, y double").repartition(7), ["k"]), "x", "y")
    want = [tuple(p) for p in registration._hull(__import__("numpy").array([p[1:] for p in pts]))]
    assert got == sorted(want)


def test_rebuild_promote_and_labels(spark, tmp_path):
    from placegraph.catalog import base as B

    out = jobs.rebuild(B.nodes(spark, SF), B.links(spark, SF), B.spaces(spark, SF))
    jobs.write_rebuild(out, str(tmp_path), 1)
    assert sinks.read_version(spark, f"{tmp_path}/graph/edges").count() == out["edges"].count() > 0
    assert out["unknown_links"].count() + network.resolve_links(B.links(spark, SF), B.nodes(spark, SF)).count() <= B.links(spark, SF).count()
    foot = B.outlines(spark, SF).where("kind = 'building'").select(F.col("name").alias("building"), "ring")
    audited = jobs.promote_and_audit(B.spaces(spark, SF), str(tmp_path / "live"), B.nodes(spark, SF), B.links(spark, SF), foot)
    assert audited["overlap"].count() > 0 and audited["stairs"].columns[0] == "building"
    cleaned = jobs.clean_labels(D.view(spark, SF, "label_reads"), B.plan_spaces(spark, SF).select("building", "floor", "ord", "ring"))
    assert 0 < cleaned.count() <= D.view(spark, SF, "label_reads").count()
    assert coverage.index_rooms(B.spaces(spark, SF)).count() == out["rooms"].count()
    assert changes.dropped_unkeyed(D.view(spark, SF, "features_before")).first()[0] == 0


def test_typed_directions_equal_the_routes_of_their_references(spark):
    from placegraph.catalog import base as B
    from placegraph.catalog import lookups
    from placegraph.catalog.network import graph_inputs
    from placegraph.operators import routes
    n, e, comps = graph_inputs(spark, SF)
    centres = coverage.place_centres(B.outlines(spark, SF))
    rooms = [(r.building, r.room) for r in B.nodes(spark, SF).where("building IS NOT NULL AND room IS NOT NULL").orderBy("ord").limit(16).collect()]
    pairs = [(i, *rooms[i], *rooms[-1 - i]) for i in range(8)]
    asked = spark.createDataFrame([(i, b, f"{b}-{r}", f"{c}-{t}") for i, b, r, c, t in pairs], "query_id long, building string, start_ref string, goal_ref string")
    asks = [(i, f" {b.lower()}  {r}", f"{c}-{t}") for i, b, r, c, t in pairs] + [(-1, "b1-1000", " "), (-2, "", "99999"), (-3, None, None)]
    codes = D.view(spark, SF, "places").select(F.col("name").alias("code"), "kind")
    names = coverage.rooms_by_name(lookups.index(spark, SF))
    out = jobs.typed_directions(spark.createDataFrame(asks, "query_id long, from_text string, to_text string"), codes, names, n, e, centres)
    got = {r.query_id: (r.status, r.cost) for r in out["answers"].collect()}
    want = {r.query_id: (r.status, r.cost) for r in routes.find_routes(asked, n, e, comps, centres)[0].collect()}
    assert {q: v for q, v in got.items() if q >= 0} == want and "ok" in {s for s, _ in want.values()}
    assert got[-1][0] == "no_goal" and got[-2][0] in ("needs_building", "from_here") and got[-3][0] == "no_goal"
    assert {q for q, (s, _) in want.items() if s == "ok"} == {r.query_id for r in out["steps"].where("text LIKE 'Arrive%'").collect()}


def test_likeness_is_asked_once_a_word(spark, monkeypatch):
    import difflib

    import pandas as pd

    words = ["SSIAIR", "AHAFT", "LOBY", "X" * 5000, "WASHRN", "OFICE", "JANITR", "ELVE", "STARI", *("".join(random.Random(i).choices("QXZUWY", k=6)) for i in range(300))]
    want = [next((v for k, v in quality.KEYWORDS.items() if difflib.SequenceMatcher(None, w, k).ratio() >= 0.7), None) for w in words]
    real, asked = difflib.SequenceMatcher, []
    monkeypatch.setattr(quality.difflib, "SequenceMatcher", lambda *a: asked.append(a) or real(*a))
    assert quality._fuzzy_kind.func(pd.Series(words)).tolist() == want and len(asked) < 100
    reads = spark.range(50).selectExpr("CAST(id AS STRING) AS id", "concat('ZZZ AHAFT LOBBZ ', repeat('Y', 40)) AS raw")
    got = quality.classify_labels(reads, key="id")
    assert got.groupBy("kind").count().collect()[0].asDict() == {"kind": "shaft", "count": 50}
    # A test of the answer must not move below the distinct.
    plan = spark.range(9).selectExpr("CAST(id AS STRING) AS word").distinct().withColumn("k", quality._fuzzy_kind("word")).where("k IS NOT NULL")
    told = plan._jdf.queryExecution().optimizedPlan().toString()
    assert told.index("_fuzzy_kind") < told.index("Aggregate")
    assert told.count("_fuzzy_kind(") == 1


def test_split_tables_have_few_folders_and_give_keys_back(spark, tmp_path):
    s = spark.range(600).selectExpr("IF(id % 100 = 0, '', concat('00', id)) AS building", "CAST(id % 4 AS STRING) AS floor", "id AS ord").unionByName(
        spark.range(600, 603).selectExpr("CAST(NULL AS STRING) AS building", "'1' AS floor", "id AS ord"))
    for write in (sinks.write_sheets, sinks.write_rooms):
        path = f"{tmp_path}/{write.__name__}"
        write(s, path)
        assert len([p for p in __import__("os").listdir(path) if "=" in p]) <= sinks.PARTS
        assert rows(R.read_table(spark, path).select("building", "floor", "ord"), "ord") == rows(s, "ord")
    assert [r.ord for r in R.read_sheet_table(spark, f"{tmp_path}/write_sheets", "007", "3").collect()] == [7]


def test_short_routes_share_one_shuffle_and_long_ones_are_cut(spark, monkeypatch):
    from placegraph.operators import common, routes

    r = random.Random(5)
    pts = [(q, i, r.choice(["node", "node", "anchor"]), r.choice(["B1", "B2", None]), r.choice(["1", "2", None]), r.choice(["100", None]), r.choice(["N", None]),
            r.choice(["stairs", "hallway", "elevator", None]), r.random() / 100, r.random() / 100) for q, n in ((1, 3), (2, 40), (3, 1), (4, 6), (None, 9), (5, 30)) for i in range(n)]
    points = spark.createDataFrame(pts, "query_id int, step bigint, kind string, building string, floor string, room string, name string, space string, lng double, lat double")

    def told():
        legs = routes.legs(points)
        round3 = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()), key=repr)
        att = routes.attribute_distances(legs)
        return [round3(df.select(*sorted(df.columns))) for df in (
            legs, att, routes.directions(att), routes.path_lengths(points), routes.drawn_runs(points),
            routes.visits(points).drop("first", "last"))]

    whole = told()
    wrote = []
    monkeypatch.setattr(routes, "materialise", lambda df, **m: wrote.append(df) or common.materialise(df, **m))
    plan = routes.legs(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not wrote
    monkeypatch.setattr(common, "CHUNK", 7)
    assert [k.query_id for k in common.long_keys(points, ["query_id"]).orderBy("query_id").collect()] == [None, 2, 5]
    keyed = [[x for x in part] for part in told()]
    assert keyed == whole


def test_sql_functions_are_spread_over_tasks(spark):
    from placegraph.catalog import sqlsurface

    got = sqlsurface.sql_ring_functions(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_snapping_sends_no_side_whole_and_small_floors_share_a_block(spark, monkeypatch):
    from placegraph.operators import raster

    cells = spark.range(3000).selectExpr("concat('R', id div 100) AS building", "CAST(1 AS INT) AS floor", "CAST(id % 100 div 10 AS INT) AS r", "CAST(id % 10 AS INT) AS c", "id % 3 = 0 AS blocked")
    states = cells.where("r = 0 AND c = 0").selectExpr("building AS key", "building", "floor", "r", "c")
    plans, real = [], raster.materialise
    monkeypatch.setattr(raster, "materialise", lambda df, **m: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, **m))
    assert raster.snap_to_free(states, cells, key="key").count() == 30
    assert any("strategy=merge" in p for p in plans)
    side = cells.where("c < 9").selectExpr("concat_ws('|', building, floor, r, c) AS a", "concat_ws('|', building, floor, r, c + 1) AS b")
    blocks = raster.tile_blocks(side)
    assert blocks.count() == blocks.select("nid").distinct().count() == 3000 and blocks.select("block").distinct().count() == 2
