"""Rules on small fixtures, and operators against brute force."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placegraph import datasets as D
from placegraph.catalog import base as B
from placegraph.functions import clock, geo, text
from placegraph.operators import activity, changes, common, coverage, graph, naming, network, routes, search, timetable
from placegraph.operators import walks as walk_blocks
from placegraph.session import materialise

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- ordered helpers ----------------------------------------------------------

def test_chunked_windows_equal_plain(spark):
    rng = random.Random(5)
    data = [(k, i, rng.randint(0, 9), rng.choice([None, i])) for k in "abc" for i in range(200) if k != "c" or i < 3]
    df = spark.createDataFrame(data, "k string, i int, v int, x int")
    args = dict(sums={"s": F.col("v")}, lasts={"l": F.col("x")})
    plain = common.running(df, ["k"], "i", chunk=None, **args)
    assert rows(plain.fillna(-1)) == rows(common.running(df, ["k"], "i", chunk=7, **args).fillna(-1))
    prev = common.with_previous(df, ["k"], "i", ["v"], chunk=None).fillna(-1)
    assert rows(prev) == rows(common.with_previous(df, ["k"], "i", ["v"], chunk=7).fillna(-1))


def test_large_keys_take_the_chunked_path(spark, monkeypatch):
    from placegraph.catalog import routing

    pts = routing.stored_routes(spark, SF)
    want = rows(routes.attribute_distances(routes.legs(pts)).select("query_id", "leg", F.round("metres", 3), F.round("approach", 3)))
    steps = rows(routes.directions(routes.attribute_distances(routes.legs(pts))))
    monkeypatch.setattr(common, "CHUNK", 4)
    assert rows(routes.attribute_distances(routes.legs(pts)).select("query_id", "leg", F.round("metres", 3), F.round("approach", 3))) == want
    assert rows(routes.directions(routes.attribute_distances(routes.legs(pts)))) == steps


# -- delta --------------------------------------------------------------------

FEATURES = "ord int, type string, nid string, a string, b string, lng double"
COLS = ["type", "nid", "a", "b", "lng"]
BASE = [(0, "node", "k7", None, None, 1.0), (1, "node", "k9", None, None, 2.0), (2, "path", None, "k7", "k9", None)]


@pytest.mark.parametrize("delta, keys, counts", [
    ([("add", 0, None, "node", "k4", None, None, 3.0)], ["n:k7", "n:k9", "p:k7|k9", "n:k4"], (1, 0, 0)),
    ([("update", 0, None, "node", "k7", None, None, 9.0)], ["n:k7", "n:k9", "p:k7|k9"], (0, 1, 0)),
    ([("remove", 0, "n:k9", None, None, None, None, None)], ["n:k7", "p:k7|k9"], (0, 0, 1)),
    ([("update", 1, None, "node", "k7", None, None, 9.0), ("add", 0, None, "node", "z", None, None, 0.0)], ["n:k7", "n:k9", "p:k7|k9", "n:z"], (1, 1, 0)),
    ([("add", 0, None, "node", "k7", None, None, 5.0), ("remove", 1, "n:nope", None, None, None, None, None)], ["n:k7", "n:k9", "p:k7|k9"], (0, 1, 0)),
    ([("remove", 0, "n:k7", None, None, None, None, None), ("add", 1, None, "node", "k7", None, None, 5.0)], ["n:k9", "p:k7|k9", "n:k7"], (1, 0, 1)),
    ([("add", 0, None, "node", None, None, None, 5.0)], ["n:k7", "n:k9", "p:k7|k9"], (0, 0, 0)),
    ([("add", 0, None, "node", "k4", None, None, 3.0), ("add", 1, None, "node", "k4", None, None, 4.0)], ["n:k7", "n:k9", "p:k7|k9", "n:k4"], (1, 1, 0)),
    ([], ["n:k7", "n:k9", "p:k7|k9"], (0, 0, 0)),
])
def test_apply_delta(spark, delta, keys, counts):
    base = spark.createDataFrame(BASE, FEATURES)
    d = spark.createDataFrame(delta, "op string, seq int, key string, type string, nid string, a string, b string, lng double")
    applied = changes.apply_delta(base, d, COLS)
    assert [r.key for r in changes.merged_features(applied, COLS).collect()] == keys
    assert tuple(changes.delta_counts(applied).first())[:3] == counts


def test_guards(spark):
    n = spark.range(20).select(F.concat(F.lit("n"), "id").alias("nid"))
    assert changes.shrink_guard(n, n.limit(9)).first().refused
    assert not changes.shrink_guard(n, n.limit(10)).first().refused
    assert not changes.shrink_guard(n, n.limit(1), forced=True).first().refused
    one = changes.fingerprint(n).first()
    assert one == changes.fingerprint(n.orderBy(F.desc("nid"))).first() != changes.fingerprint(n.limit(19)).first()


def test_snapshot_diff_then_apply_gives_the_new_snapshot(spark):
    a, b = D.view(spark, SF, "features_before"), D.view(spark, SF, "features_after")
    cols = ["type", "nid", "a", "b", "building", "floor", "lng", "lat", "metres"]
    ops = changes.snapshot_diff(a, b, cols)
    new = b.withColumn("key", changes.feature_key()).join(ops.where("op <> 'remove'"), "key").select("op", F.col("ord").alias("seq"), F.lit(None).cast("string").alias("key"), *cols)
    gone = ops.where("op = 'remove'").select("op", F.lit(0).cast("bigint").alias("seq"), "key", *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in cols])
    merged = changes.merged_features(changes.apply_delta(a, new.unionByName(gone), cols), cols)
    assert changes.snapshot_diff(merged.withColumn("ord", F.lit(0)), b, cols).count() == 0


# -- timetable ----------------------------------------------------------------

def _classes(spark, data):
    return spark.createDataFrame(data, "user_id string, ord int, days array<int>, start_time string, end_time string")


# Class 1 meets Tuesday and Thursday 11:10 to 12:40, class 2 Tuesday 15:20 to 16:05.
@pytest.mark.parametrize("at, current, nxt, minutes", [
    ("2024-01-02 11:55:00", 1, 2, 3 * 60 + 25), ("2024-01-02 12:50:00", None, 2, 150), ("2024-01-02 15:20:00", 2, 1, 2 * 1440 - 250),
    ("2024-01-04 20:00:00", None, 1, 5 * 1440 - 530), ("2024-01-07 00:00:00", None, 1, 2 * 1440 + 670)])
def test_now_and_next(spark, at, current, nxt, minutes):
    c = _classes(spark, [("u", 1, [2, 4], "11:10", "12:40"), ("u", 2, [2], "15:20", "16:05")])
    t = spark.sql(f"SELECT 'u' AS user_id, 1 AS tick_id, TIMESTAMP_NTZ'{at}' AS ts")
    assert tuple(timetable.now_and_next(t, c).select("current", "next", "in_minutes").first()) == (current, nxt, minutes)


def test_a_class_starting_now_is_never_next(spark):
    c = _classes(spark, [("u", 1, [4], "17:45", "18:15")])
    t = spark.sql("SELECT 'u' AS user_id, 1 AS tick_id, TIMESTAMP_NTZ'2024-01-04 17:45:00' AS ts")
    assert tuple(timetable.now_and_next(t, c).select("current", "next").first()) == (1, None)


@pytest.mark.parametrize("at, due", [("17:21", (1, "soon", 24)), ("17:14", None), ("18:14", (1, "now", None)), ("18:15", None)])
def test_due(spark, at, due):
    c = _classes(spark, [("u", 1, [4], "17:45", "18:15")])
    t = spark.sql(f"SELECT 'u' AS user_id, 1 AS tick_id, TIMESTAMP_NTZ'2024-01-04 {at}:00' AS ts")
    got = timetable.due_now(t, c).select("due", "status", "until").first()
    assert (got and tuple(got)) == due


def test_class_checks(spark):
    c = spark.createDataFrame([("", "b", "1", [1], "09:00", "10:00"), ("t", "b", "1", [], "09:00", "10:00"), ("t", "b", "1", [1], "10:00", "09:00"), ("t", "b", "1", [9, 3, 3, 1], "09:00", "10:00")],
                              "title string, building string, room string, days array<int>, start_time string, end_time string").withColumn("floor", F.lit(""))
    assert [r.error is None for r in timetable.check_classes(c).collect()] == [False, False, False, True]
    assert timetable.clean_classes(c).collect()[3].days == [1, 3]


# -- activity -----------------------------------------------------------------

def test_favourites_and_limits(spark):
    log = spark.createDataFrame([("u", "n1", "add", 1, 1), ("u", "n1", "use", 5, 2), ("u", "n1", "add", 7, 3), ("u", "n2", "use", 8, 4), ("u", "n3", "add", 1, 5), ("u", "n3", "remove", 2, 6)],
                                "user_id string, node_id string, op string, ts int, event_id int")
    assert rows(activity.favourite_state(log)) == [("u", "n1", 7, 7)]
    many = spark.range(101).select(F.lit("u").alias("user_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.col("id").alias("last_used"))
    assert activity.top_favourites(many).count() == 100


def test_recents_rules(spark):
    v = [("u", "b1", None, str(100 + i), i, i) for i in range(9)] + [("u", "B1", "2", "108", -1, -1), ("u", "b1", "1", "B1-7", 20, 20), ("u", "b1", "1", "B1", 21, 21)]
    df = spark.createDataFrame(v, "user_id string, building string, floor string, room string, ts int, event_id int")
    got = activity.recents(df).orderBy("rank").collect()
    assert [r.room for r in got] == [str(100 + i) for i in range(8, 0, -1)]
    assert got[0].floor == "2"


def test_throttle_equals_the_sequential_rule(spark, monkeypatch):
    rng = random.Random(3)
    data = [(u, rng.randint(0, 3000)) for u in ("a", "b", "c") for _ in range(150)]
    want = []
    for u in "abc":
        last = None
        for t in sorted(t for k, t in data if k == u):
            if last is None or t - last >= 100:
                want.append((u, t))
                last = t
    df = spark.createDataFrame(data, "user_id string, t bigint")
    assert rows(activity.throttle(df, 100)) == sorted(want)
    assert rows(activity.throttle(df, 100, chunk_us=64)) == sorted(want)


# -- network and graph --------------------------------------------------------

def _graph(seed, n=40, m=55):
    rng = random.Random(seed)
    nodes = [(f"n{i:02d}", i, "B1" if i % 2 else None, "1", f"r{i % 7}" if i % 3 else None, rng.choice(["room", "hallway", "service"]), rng.random() / 100, rng.random() / 100) for i in range(n)]
    edges = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)}
    return nodes, [(f"n{a:02d}", f"n{b:02d}", float(rng.randint(1, 50))) for a, b in edges if a != b]


NODE = "nid string, ord int, building string, floor string, room string, space string, lng double, lat double"


@pytest.mark.parametrize("seed, block", [(1, 64), (2, 64), (2, 8)])
def test_components_and_walks(spark, monkeypatch, seed, block):
    nodes, edges = _graph(seed)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "a string, b string, metres double")
    adj = {x[0]: [] for x in nodes}
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    comp = {}
    for x in sorted(adj):
        stack = [x] if x not in comp else []
        while stack:
            u = stack.pop()
            if u not in comp:
                comp[u] = int(x[1:])
                stack += [v for v, _ in adj[u]]
    assert {r.nid: r.component for r in graph.components(n, e).collect()} == comp
    info = {x[0]: x for x in nodes}
    asks = [(q, f"n{q * 3 % 40:02d}", f"n{(q * 7 + 5) % 40:02d}") for q in range(8)]
    opened = {(q, info[x][4]) for q, s, g in asks for x in (s, g) if info[x][4]}
    want = {}
    for q, s, g in asks:
        dist = {s: 0.0}
        for _ in range(len(nodes)):
            for u in list(dist):
                for v, w in adj[u]:
                    d = dist[u] + w + (1000.0 if info[v][5] in ("room", "service") and (q, info[v][4]) not in opened else 0.0)
                    dist[v] = min(d, dist.get(v, math.inf))
        if g in dist:
            want[q] = dist[g]
    starts = spark.createDataFrame([(q, s) for q, s, _ in asks], "query_id int, nid string")
    goals = spark.createDataFrame([(q, g) for q, _, g in asks], "query_id int, nid string")
    monkeypatch.setattr(walk_blocks, "BLOCK", block)
    monkeypatch.setattr(walk_blocks, "SLICE", 3)
    report = []
    answers, path = walk_blocks.shortest_walks(graph.arcs_of(n, e), starts, goals, spark.createDataFrame(sorted(opened), "query_id int, room string"), report=report)
    assert {r.query_id: r.cost for r in answers.collect()} == want
    assert (len(report) == 1) == (block > 40) and all(r["written"] for r in report)
    walks = {}
    for r in path.orderBy("query_id", "step").collect():
        assert r.step == len(walks.setdefault(r.query_id, []))
        walks[r.query_id].append(r.nid)
    for q, s, g in asks:
        if q in want:
            w = walks[q]
            assert (w[0], w[-1]) == (s, g)
            assert all(any(v == y for v, _ in adj[x]) for x, y in zip(w, w[1:]))


def _sphere_m(ax, ay, bx, by, radius):
    ax, ay, bx, by = map(math.radians, (ax, ay, bx, by))
    h = math.sin((by - ay) / 2) ** 2 + math.cos(ay) * math.cos(by) * math.sin((bx - ax) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


@pytest.mark.parametrize("west, spread", [(0.0, 1 / 50), (179.99, 1 / 50), (-180.0, 360.0)])
def test_closest_pairs_by_brute_force(spark, west, spread):
    from placegraph.functions import geo

    rng = random.Random(9)
    turn = lambda x: (x + 180) % 360 - 180
    mk = lambda p: [("g", f"{p}{i}", turn(west + rng.random() * spread), 49 + rng.random() / 50) for i in range(40)]
    a, b = mk("a"), mk("b")
    want = min((_sphere_m(p[2], p[3], q[2], q[3], geo.WEIGHT_RADIUS_M), p[1], q[1]) for p in a for q in b)
    schema = "g string, nid string, lng double, lat double"
    got = network.closest_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], start_m=5.0).collect()
    assert [(r.a, r.b) for r in got] == [want[1:]] and abs(got[0].metres - want[0]) < 1e-6


def test_nearest_across_the_date_line_and_far_away(spark):
    from placegraph.functions import geo
    from placegraph.operators import spatial

    t = [("near", 0, -179.9995, 10.0), ("far", 1, 179.992, 10.0), ("pole", 2, 20.0, 89.99)]
    p = [(0, 179.9995, 10.0), (1, -170.0, 89.9), (2, 0.0, -80.0)]
    got = spatial.nearest(spark.createDataFrame(p, "pid int, lng double, lat double"), spark.createDataFrame(t, "nid string, ord int, lng double, lat double"), "pid", "nid", "ord")
    want = {i: min((_sphere_m(x, y, u, v, geo.ROUTE_RADIUS_M), n) for n, _, u, v in t)[1] for i, x, y in p}
    assert {r.pid: r.nid for r in got.collect()} == want and want[0] == "near"


def test_nearest_by_growing_cells(spark):
    from placegraph.operators import spatial

    rng = random.Random(4)
    t = [(f"t{i}", i, rng.random() / 20 - 123, 49 + rng.random() / 20) for i in range(80)]
    p = [(i, rng.random() / 10 - 123, 49 + rng.random() / 10) for i in range(40)] + [(99, 10.0, -20.0)]
    td, pd_ = spark.createDataFrame(t, "nid string, ord int, lng double, lat double"), spark.createDataFrame(p, "pid int, lng double, lat double")

    def hav(x1, y1, x2, y2):
        a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    got = {r.pid: r.nid for r in spatial.nearest(pd_, td, "pid", "nid", "ord", start_m=20.0).collect()}
    assert got == {i: min(t, key=lambda n: hav(x, y, n[2], n[3]))[0] for i, x, y in p}


# -- naming -------------------------------------------------------------------

def _greedy(nodes):
    used, out = {n["name"] for n in nodes if n["name"]}, {}
    todo = sorted((n for n in nodes if not n["name"]), key=lambda n: n["ord"])

    def names(n):
        if n["room"]:
            base = f"{n['prefix']}-{n['room'].strip()}"
            yield base
            yield from (f"{base}-{i}" for i in range(2, 100))
        mark = f"{n['floor'] or ''}H" if n["marked"] else ""
        yield from (f"{n['prefix']}-{mark}{i}" for i in itertools.count(1))

    for n in [n for n in todo if n["room"]] + [n for n in todo if not n["room"]]:
        name = next(x for x in names(n) if x not in used)
        used.add(name)
        out[n["nid"]] = name
    return out


@pytest.mark.parametrize("chunked", [False, True])
def test_names_equal_the_sequential_rule(spark, chunked, monkeypatch):
    rng = random.Random(8)
    nodes = []
    for i in range(420):
        prefix = rng.choice(["OUT", "B1", "B2"])
        nodes.append(dict(nid=f"n{i}", ord=i, name=rng.choice([None, None, None, f"{prefix}-{rng.randint(1, 30)}", f"{prefix}-10{rng.randint(0, 3)}-{rng.randint(2, 5)}", f"{prefix}-1H{rng.randint(1, 9)}"]),
                          room=rng.choice([None, "100", "101", "100-2", "5", "7"]) if i > 20 else "100", floor=rng.choice([None, "1", "2"]), prefix=prefix, marked=prefix == "B1"))
    for i in range(110):
        nodes.append(dict(nid=f"m{i}", ord=1000 + i, name=None, room="300", floor="3", prefix="B2", marked=False))
    if chunked:
        monkeypatch.setattr(common, "CHUNK", 16)
    df = spark.createDataFrame([tuple(n.values()) for n in nodes], "nid string, ord int, name string, room string, floor string, prefix string, marked boolean")
    assert {r.nid: r.new_name for r in naming.assign_names(df).collect()} == _greedy(nodes)


def test_names_on_the_tables_equal_the_sequential_rule(spark):
    n, s = B.nodes(spark, SF), B.spaces(spark, SF)
    ready, _ = materialise(naming.name_prefixes(naming.match_rooms(n, s).drop("matched"), s))
    want = _greedy([r.asDict() for r in ready.collect()])
    assert {r.nid: r.new_name for r in naming.assign_names(ready).collect()} == want


# -- routes -------------------------------------------------------------------

def _fold(points):
    """Legs of one route by a plain scan."""
    def hav(a, b):
        h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lng - a.lng) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    legs, prev = [], None
    for p in points:
        gap = hav(prev, p) if prev else 0.0
        off = prev is not None and prev.kind == "anchor"
        key, last = (p.room or None, p.building or None, p.kind), legs[-1] if legs else None
        if last and last["key"] == key and (last["floor"] == p.floor or not last["floor"] or not p.floor):
            last["m"] += gap
            last["floor"] = last["floor"] or p.floor
        else:
            hop = off or p.kind == "anchor"
            legs.append(dict(key=key, floor=p.floor, m=0.0 if hop else gap, a=gap if hop else 0.0, type=p.space or ("anchor" if p.kind == "anchor" else "node"), name=p.name))
        prev = p
    vertical = lambda g: g["type"] in ("stairs", "elevator")
    for i, g in enumerate(legs[:-1]):
        if i > 0 and vertical(g):
            legs[i + 1]["m"] += g["m"]
            g["m"] = 0.0
    for g in reversed(legs[:-1]):
        if not vertical(g):
            g["m"] += legs[-1]["m"]
            legs[-1]["m"] = 0.0
            break
    return legs


def _words(legs):
    def named(g, arriving=False):
        room, building, kind = g["key"]
        if room:
            return f"{room} ({g['name']})" if g["name"] else room
        if g["name"]:
            return g["name"]
        if kind == "anchor":
            return "where you are"
        if g["type"] in ("stairs", "elevator"):
            return {"stairs": "the stairs", "elevator": "the lift"}[g["type"]]
        if not building:
            return "the path outside"
        return building if not g["floor"] or arriving else "the hallway"

    rnd = lambda v: math.floor(v + 0.5)
    out, zone, last_b = [], None, None
    for i, g in enumerate(legs):
        building, end, app = g["key"][1], i == len(legs) - 1, rnd(g["a"])
        if app >= 1 and i > 0 and g["key"][2] != "anchor":
            out.append(f"Head {app} m to the mapped paths")
        z = "Outside" if not building else f"{building} · Floor {g['floor']}" if g["floor"] else zone if building == last_b else building
        if z != zone:
            out.append(z)
            zone = z
        last_b = building or last_b
        far = rnd(g["m"])
        if i == 0:
            out.append(f"Start at {named(g)}")
            if app >= 1:
                out.append(f"Head {app} m to the mapped paths")
            if far >= 1 and not end:
                out.append(f"Follow {named(g)} for {far} m")
        elif end:
            if app >= 1 and g["key"][2] == "anchor":
                out.append(f"Head {app} m to {named(g, True)}")
            out.append(f"Arrive at {named(g, True)}")
        elif g["type"] in ("stairs", "elevator"):
            out.append(f"Take {g['name'] or named(g)}")
        else:
            out.append(f"Follow {named(g)} for {far} m" if far >= 1 else f"Through {named(g)}")
    return out


def test_legs_and_words_equal_a_plain_scan(spark):
    from placegraph.catalog import routing

    pts = routing.stored_routes(spark, SF)
    by = {}
    for r in pts.orderBy("query_id", "step").collect():
        by.setdefault(r.query_id, []).append(r)
    legs = routes.attribute_distances(routes.legs(pts))
    got = {}
    for r in legs.orderBy("query_id", "leg").collect():
        got.setdefault(r.query_id, []).append((r.space, r.building, r.floor, r.type, round(r.metres, 4), round(r.approach, 4)))
    want = {q: [(g["key"][0], g["key"][1], g["floor"], g["type"], round(g["m"], 4), round(g["a"], 4)) for g in _fold(p)] for q, p in by.items()}
    assert got == want
    said = {}
    for r in routes.directions(legs).orderBy("query_id", "leg", "pos").collect():
        said.setdefault(r.query_id, []).append(r.text)
    assert said == {q: _words(_fold(p)) for q, p in by.items()}


def test_route_request_rules(spark):
    nodes = [("a", 0, "B1", "1", "100", "hallway", -123.0, 49.0), ("b", 1, "B1", "1", None, "hallway", -123.0, 49.0005), ("c", 2, "B2", "1", "200", "hallway", -123.0, 49.001), ("x", 3, "B3", "1", "300", "hallway", -122.9, 49.0)]
    n = spark.createDataFrame(nodes, NODE).withColumn("name", F.lit(None).cast("string"))
    e = spark.createDataFrame([("a", "b", 55.0), ("b", "c", 56.0)], "a string, b string, metres double")
    centres = spark.createDataFrame([("YARD K", "Yard K", -123.0, 48.999)], "label string, name string, lng double, lat double")
    asks = [(1, "b1", "100", "B2-200"), (2, "B1", "100", "999"), (3, "B1", "Yard K", "B2-200"), (4, "B1", "100", "B1"), (5, "", "100", "200"), (6, "B1", "100", ""), (7, "B1", "100", "B3-300"), (8, "B1", "999", "998"), (9, "B1", "100", "100")]
    q = spark.createDataFrame(asks, "query_id int, building string, start_ref string, goal_ref string")
    comps = graph.components(n, e)
    answers, points = routes.find_routes(q, n, e, comps, centres)
    got = {r.query_id: (r.status, r.cost) for r in answers.collect()}
    assert got == {1: ("ok", 111.0), 2: ("no_goal_node", None), 3: ("ok", 111.0), 4: ("already_there", None), 5: ("no_building", None), 6: ("no_goal_node", None), 7: ("not_linked", None), 8: ("no_node", None), 9: ("ok", 0.0)}
    kinds = [(r.kind, r.name) for r in points.where("query_id = 3").orderBy("step").collect()]
    assert kinds[0] == ("anchor", "Yard K") and [k for k, _ in kinds[1:]] == ["node"] * 3


def test_a_walk_inside_one_block_is_searched_once(spark, monkeypatch):
    def again(packs, asked):
        raise AssertionError("searched again")

    monkeypatch.setattr(walk_blocks, "_stretches", again)
    arcs = spark.createDataFrame([(f"n{i}", f"n{j}", 1.0, 0.0, None) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "a string, b string, w double, entry double, b_room string")
    ends = lambda *rows: spark.createDataFrame(rows, "query_id int, nid string")
    _, path = walk_blocks.shortest_walks(arcs, ends((1, "n0"), (2, "n5")), ends((1, "n4"), (2, "n3")))
    assert [(r.query_id, r.nid) for r in path.orderBy("query_id", "step").collect()] == [(1, f"n{i}") for i in range(5)] + [(2, "n5"), (2, "n4"), (2, "n3")]


def _one_block(arcs, nodes):
    """A block of places 0 to ``nodes``; arcs (a, b, w, entry, room), b from ``nodes`` on being elsewhere."""
    rows = [(0, 0, nodes, *arc) for arc in arcs]
    return walk_blocks._Block(walk_blocks._packs(pd.DataFrame(rows, columns=["block", "base", "nodes", "a", "b", "w", "entry", "room"])))


def test_a_walk_to_a_goal_behind_a_closed_room_looks_at_few_nodes():
    line = [(i, j, 0.1, 0.0, -1) for i in range(3000) for j in (i - 1, i + 1) if 0 <= j < 3000]
    block = _one_block([*line, (3, 3000, 1.0, 1000.0, 5), (3000, 3001, 1.0, 0.0, -1), (2999, 3002, 1.0, 0.0, -1), (3000, -1, 5.0, 1000.0, 5)], 3002)
    done, prev, source, goal, bound = block.search([(0, 0.0)], math.inf, {3001}, set())
    assert (goal, round(bound, 6), block.path(prev, goal)) == (3001, 1002.3, [0, 1, 2, 3, 3000, 3001]) and len(done) < 100
    assert block.tail({3001}, set()) == 1006.0 and block.tail({3001}, {5}) == 6.0
    # A way out of the block is followed as long as the way back may still be cheaper.
    assert len(block.search([(0, 0.0)], math.inf, {3001}, set(), tail=1006.0)[0]) < 100
    far, _, _, goal, _ = block.search([(0, 0.0)], math.inf, {3001}, set(), tail=6.0)
    assert goal == 3001 and len(far) == 3002


@pytest.mark.parametrize("tail", [0.0, 9.0, math.inf])
@pytest.mark.parametrize("seed", range(20))
def test_a_search_from_both_ends_walks_as_a_search_from_the_start(seed, tail):
    rng = random.Random(seed)
    arcs = {(rng.randrange(60), rng.randrange(60)): (float(rng.randint(0, 4)), rng.choice([0.0, 0.0, 10.0]), rng.randrange(4)) for _ in range(200)}
    block = _one_block([(a, b, *rest) for (a, b), rest in arcs.items() if a != b], 60)
    for _ in range(10):
        entries, goals, free = [(rng.randrange(60), float(rng.randint(0, 3))) for _ in range(2)], set(rng.sample(range(60), 2)), {rng.randrange(4)}
        limit = rng.choice([8.0, 30.0, math.inf])
        dist, prev, source, settled, bound, goal = {}, {}, {}, set(), limit, None
        for i, d in entries:
            if d < dist.get(i, math.inf):
                dist[i], prev[i], source[i] = d, None, i
        while goal is None and set(dist) - settled:
            d, i = min((dist[i], i) for i in set(dist) - settled)
            if d >= bound:
                break
            settled.add(i)
            if i in goals:
                bound, goal = d, i
                continue
            for (a, b), (w, e, r) in arcs.items():
                far = d + w + (e if r not in free else 0.0)
                if a == i and b != i and far < bound and far < dist.get(b, math.inf):
                    dist[b], prev[b], source[b] = far, i, source[i]
        done, got_prev, got_source, got_goal, got_bound = block.search(entries, limit, goals, free, tail)
        assert (got_goal, got_bound) == (goal, bound)
        if goal is not None:
            assert (block.path(got_prev, goal), got_source[goal]) == (block.path(prev, goal), source[goal])
        # Whatever a way out of the block can still start from is settled, at the same distance, by the same way.
        need = {i for i in settled if dist[i] + tail <= bound}
        assert need <= set(done) <= settled and all((done[i], got_source[i]) == (dist[i], source[i]) for i in need)


def test_least_lengths_of_pairs_look_up_their_ends_once(spark):
    nodes = spark.createDataFrame([("a", 0.0, 49.0), ("b", 0.001, 49.0), ("c", 0.0, 49.002)], "nid string, lng double, lat double")
    links = spark.createDataFrame(
        [("a", "b", 90.0), ("b", "a", None), ("a", "b", 50.0), ("c", "a", 0.0), ("a", "c", -1.0), ("b", "c", 7.0), ("a", "a", 1.0), ("a", "x", 1.0), (None, "b", 1.0)],
        "a string, b string, metres double")
    got = rows(network.weighted_edges(links, nodes), "a", "b", "metres")
    assert got == rows(network.least_edges(network.resolve_links(links, nodes)), "a", "b", "metres") and len(got) == 3


def test_only_pieces_of_requests_are_dealt_to_blocks(spark, monkeypatch):
    nodes = [(f"n{i}", i, f"B{i // 3}", "1", str(100 + i), "hallway", -123.0 + i / 1e3, 49.0) for i in range(9)]
    n = spark.createDataFrame(nodes, NODE).withColumn("name", F.lit(None).cast("string"))
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 10.0) for i in range(8) if i % 3 < 2], "a string, b string, metres double")
    centres = spark.createDataFrame([], "label string, name string, lng double, lat double")
    q = spark.createDataFrame([(1, "B1", "103", "105"), (2, "B1", "103", "B2-106")], "query_id int, building string, start_ref string, goal_ref string")
    dealt, deal = [], walk_blocks.position_blocks
    monkeypatch.setattr(walk_blocks, "position_blocks", lambda nodes: dealt.append({r.nid for r in nodes.collect()}) or deal(nodes))
    answers, _ = routes.find_routes(q, n, e, graph.components(n, e), centres)
    assert {r.query_id: (r.status, r.cost) for r in answers.collect()} == {1: ("ok", 20.0), 2: ("not_linked", None)}
    assert dealt == [{"n3", "n4", "n5"}]


# -- text and geometry --------------------------------------------------------

def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(text.place_name(F.lit("  yard   k "))) == "YARD K"
    assert tuple(get(text.parse_ref(F.lit("qe7 2208"), F.lit("B1")))) == ("QE7", "2208")
    assert tuple(get(text.parse_ref(F.lit("2208"), F.lit("b1")))) == ("B1", "2208")
    assert get(text.room_label(F.lit("B1"), F.lit(""), F.lit("B1-100"))) == "B1 · 100"
    assert get(text.where_is(F.lit(None), F.lit(None), F.lit(None))) == "outdoors"
    assert get(text.digits_read(F.lit("1O9"))) == "109"
    assert get(text.stairs_tag(F.lit("5100"), F.lit("stairs"))) == "S100"
    assert get(text.quoted(F.lit("x" * 90))) == "x" * 57 + "..."
    assert get(text.lines(F.lit("a; b,\nc"))) == ["a", "b", "c"]
    assert get(text.favourite_id(F.lit("b1"), F.lit("2"), F.lit("x"))) == "ROOM:B1-2-X"
    assert get(clock.twelve_hour(F.lit("13:05"))) == "1:05pm" and get(clock.minutes_of(F.lit("09:30"))) == 570
    order = spark.createDataFrame([("B10",), ("B2",), ("B1",)], "x string").orderBy(text.natural_key("x"))
    assert [r.x for r in order.collect()] == ["B1", "B2", "B10"]


def test_parse_and_directions_form(spark):
    codes = spark.createDataFrame([("QE7", "building"), ("YARD K", "parking")], "code string, kind string")
    names = spark.createDataFrame([("TEA ROOM", 3, None, None), ("POOL", 1, "QE7", "12")], "name string, rooms bigint, building string, room string")
    asks = spark.createDataFrame([(1, "2420", "QE7-2431"), (2, "yard k", "2377"), (3, "pool", "yard k"), (4, "x", "Tea  room"), (5, "", "QE7"), (6, "a", " ")], "query_id int, from_text string, to_text string")
    got = {r.query_id: (r.start_ref, r.goal_ref, r.status) for r in search.direction_ends(asks, codes, names).collect()}
    assert got[1] == ("QE7-2420", "QE7-2431", "ok") and got[2][2] == "needs_building" and got[3] == ("QE7-12", "YARD K", "ok")
    assert got[4][2] == "ambiguous" and got[5][1:] == ("QE7", "from_here") and got[6][2] == "no_goal"


def test_common_area_of_any_simple_polygons(spark):
    rng = random.Random(2)

    def star(cx, cy):
        n = rng.randint(3, 9)
        ang = sorted(rng.random() * 2 * math.pi for _ in range(n))
        return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in ang for r in [rng.uniform(0.3, 1.0)]]

    def inside(poly, x, y):
        c = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
                c = not c
        return c

    pairs = [(i, star(0, 0), star(rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5))) for i in range(12)]
    df = spark.createDataFrame([(i, [dict(x=x, y=y) for x, y in a], [dict(x=x, y=y) for x, y in b]) for i, a, b in pairs],
                               "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.i: r.v for r in df.select("i", geo.intersection_area("a", "b").alias("v")).collect()}
    for i, a, b in pairs:
        n = 220
        est = sum(inside(a, -1 + 2 * (x + 0.5) / n, -1 + 2 * (y + 0.5) / n) and inside(b, -1 + 2 * (x + 0.5) / n, -1 + 2 * (y + 0.5) / n) for x in range(n) for y in range(n)) * (2 / n) ** 2
        assert abs(got[i] - est) < 0.02


def test_plan_and_world_are_inverse(spark):
    df = spark.createDataFrame([(0.2, 0.7)], "u double, v double")
    w = df.select("u", "v", geo.plan_to_world("u", "v", F.lit(-123.0), F.lit(49.0), F.lit(80.0), F.lit(33.0), F.lit(0.6)).alias("p"))
    r = w.select(geo.world_to_plan("p.x", "p.y", F.lit(-123.0), F.lit(49.0), F.lit(80.0), F.lit(33.0), F.lit(0.6)).alias("q")).first().q
    assert abs(r.u - 0.2) < 1e-9 and abs(r.v - 0.7) < 1e-9


def test_markers_and_rollups(spark):
    s = spark.createDataFrame([("B1", "1", "s", "100", "room", "Gym", 0), ("B1", "1", "s", "100", "room", "Gym 2", 1), ("B1", "1", "s", "H1", "hallway", None, 2)],
                              "building string, floor string, sheet string, room string, type string, name string, ord int")
    idx = coverage.index_rooms(s)
    assert rows(idx, "label", "query") == [("B1-100", "B1-100 Gym")]
    assert tuple(coverage.coverage(idx).first()) == (1, 1, 1)
