"""Cheapest walks for whole tables of queries, block by block.

The network is dealt into blocks of near nodes, each small enough for a task. A round
takes the places where queries newly enter a block, walks inside each block as far as
the query's best goal allows, and writes only what leaves it: goals met, ways into
other blocks, and distances of nodes that other blocks lead to. Ways in that beat what
is known are the next round's entries, so rounds follow the blocks a walk crosses, not
its nodes. Queries at one block are dealt to slices, so that a block that many start
from is many tasks.

Inside a block a walk is searched from both ends; then it goes on from the start through what a
cheapest walk can still use. A block is left only where the way back into a block with goals
(its least is the query's tail) can still be cheap enough.

Walks are put together afterwards: ways in lead back to the start. The last stretch comes
with the goal; each one before it is walked once more inside its block.

Nodes go by numbers in the order of block and name, so a block is a range of numbers. Its
arcs are packed once, as flat arrays, since every slice of its queries is sent all of them.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.operators.common import apart, number_ranges, running
from placegraph.operators.graph import walk_back
from placegraph.session import materialise

#: Nodes of a block: as many as a task holds with ease (some 40 bytes an arc), since few crossings mean few rounds.
BLOCK = 524_288
#: Queries that meet a block in one task, and arcs sent for each of them: a large block meets more at a time.
SLICE, LOAD = 32, 4_000
#: Nodes whose arcs are packed into one row.
PACK = 8_192
#: Tables of known distances that are looked up before they are merged into one.
PARTS = 6
#: Nodes looked at for a tail; where none was found by then, the distance reached is a bound as good.
LOOK = 16_384
#: Sums from the two ends of a walk differ in their last digits: what is as good as the best up to this part of it is kept.
SLACK = 1e-9


def _spread(v: Column) -> Column:
    """The low 31 bits of a number, one place apart."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def position_blocks(nodes: DataFrame, x: str = "lng", y: str = "lat", size: int | None = None) -> DataFrame:
    """``nid, block``: runs of ``size`` nodes along a Z curve over the globe."""
    whole = lambda v, low, wide: F.greatest(F.least(((F.col(v) - low) / wide * F.lit(float(1 << 31))).cast("bigint"), F.lit((1 << 31) - 1)), F.lit(0))
    z = _spread(whole(x, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(whole(y, -90.0, 180.0)), 1))
    return _runs(nodes.select("nid", z.alias("z")), ["z", "nid"], size)


def _runs(nodes: DataFrame, order: list[str], size: int | None) -> DataFrame:
    return number_ranges(nodes, order, "_n").select("nid", F.floor(F.col("_n") / (size or BLOCK)).cast("bigint").alias("block"))


#: Columns of packed arcs: node entered from, by its place in the block; node entered (-1: the first is entered from other blocks); metres, toll and room of the node entered.
_PACKED = {"a": np.int32, "b": np.int64, "w": np.float64, "entry": np.float64, "room": np.int32}
_ARCS = "block {b}, base bigint, nodes bigint, arcs bigint, a binary, b binary, w binary, entry binary, room binary"


def _packs(arcs: pd.DataFrame) -> pd.DataFrame:
    """Arcs of one part of a block as one row."""
    one = arcs.iloc[0]
    flat = [arcs[c].to_numpy().astype(t).tobytes() for c, t in _PACKED.items()]
    return pd.DataFrame([(one["block"], one["base"], one["nodes"], len(arcs), *flat)], columns=["block", "base", "nodes", "arcs", *_PACKED])


def _flat(code: str, values: np.ndarray) -> array:
    out = array(code)
    out.frombytes(np.ascontiguousarray(values).tobytes())
    return out


class _Block:
    """Arcs of one block, by the places of its nodes in the order of their names."""

    def __init__(self, packs: pd.DataFrame):
        a, b, w, entry, room = (np.concatenate([np.frombuffer(p, t) for p in packs[c]]) for c, t in _PACKED.items())
        self.base, size = int(packs["base"].iloc[0]), int(packs["nodes"].iloc[0])
        mark, to = b < 0, b - self.base
        inside = ~mark & (to >= 0) & (to < size)
        here = np.zeros(size, np.int8)
        here[a] = 1
        here[to[inside]] = 1
        self.here = bytearray(here.tobytes())
        self.border: dict = {}
        for i, *arc in zip(*(c[mark].tolist() for c in (a, w, entry, room))):
            self.border.setdefault(i, []).append(arc)
        self.outside: dict = {}
        out = ~mark & ~inside
        for i, *arc in zip(*(c[out].tolist() for c in (a, b, w, entry, room))):
            self.outside.setdefault(i, []).append(arc)
        a, to, w, entry, room = (c[inside] for c in (a, to, w, entry, room))

        def arcs(near, far):
            at = np.lexsort((far, near))
            first = _flat("q", np.concatenate([[0], np.cumsum(np.bincount(near, minlength=size))]).astype(np.int64))
            return first, _flat("i", far[at].astype(np.int32)), _flat("d", w[at]), _flat("d", entry[at]), _flat("i", room[at])

        self.ahead, self.back = arcs(a, to), arcs(to, a)

    def places(self, nodes) -> list[int]:
        """Places of those nodes that have arcs here."""
        return [n - self.base for n in nodes if self.here[n - self.base]]

    def search(self, entries: list[tuple[int, float]], bound: float, goals: set[int], free: set[int], tail: float = float("inf")):
        """Distances, previous nodes and first entries of what is nearer than ``bound`` and the nearest goal, and that goal.

        Told are all nodes that a cheapest walk may use, in the block or on a way out of it; a walk
        that leaves the block costs at least ``tail`` from there.
        """
        none = float("inf")
        dist, prev, source, done, heap, goal = {}, {}, {}, {}, [], None
        first, to, ws, entry, room = self.ahead
        best = bound
        for i, d in entries:
            if d < dist.get(i, none):
                dist[i], prev[i], source[i] = d, None, i
                heapq.heappush(heap, (d, i))
                if i in goals:
                    best = min(best, d)
        left, left_done, left_heap = dict.fromkeys(goals, 0.0), {}, [(0.0, i) for i in sorted(goals)]
        back_first, back_to, back_ws, back_entry, back_room = self.back
        most = best if best == none else best * (1 + SLACK)
        both = True
        while heap:
            if both and (not left_heap or heap[0][0] + left_heap[0][0] > most):
                both = False  # whatever a cheapest walk still needs is settled from the goals
            if both and len(left_heap) <= len(heap):
                d, i = heapq.heappop(left_heap)
                if i in left_done:
                    continue
                left_done[i] = d
                p, q = back_first[i], back_first[i + 1]
                for j, w, e, r in zip(back_to[p:q], back_ws[p:q], back_entry[p:q], back_room[p:q]):
                    far = d + w
                    if e and r not in free:
                        far += e
                    if far <= most and far < left.get(j, none):
                        left[j] = far
                        heapq.heappush(left_heap, (far, j))
                        if j in dist and far + dist[j] < best:
                            best = far + dist[j]
                            most = best * (1 + SLACK)
                continue
            d, i = heapq.heappop(heap)
            if i in done or d > dist[i]:
                continue
            if d >= bound:
                break
            if not both and d + tail > most and d + left_done.get(i, none) > most:
                continue
            done[i] = d
            if i in goals:
                bound, goal = d, i
                break
            p, q, src = first[i], first[i + 1], source[i]
            for j, w, e, r in zip(to[p:q], ws[p:q], entry[p:q], room[p:q]):
                far = d + w
                if e and r not in free:
                    far += e
                if far < bound and far <= most and far < dist.get(j, none):
                    dist[j], prev[j], source[j] = far, i, src
                    heapq.heappush(heap, (far, j))
                    if j in left and far + left[j] < best:
                        best = far + left[j]
                        most = best * (1 + SLACK)
        return done, prev, source, goal, bound

    def tail(self, goals: set[int], free: set[int]) -> float:
        """At least what it costs to come to a goal from outside the block, the arc into the block included."""
        none = float("inf")
        first, to, ws, entry, room = self.back
        left, done, heap, best = dict.fromkeys(goals, 0.0), set(), [(0.0, i) for i in sorted(goals)], none
        while heap:
            d, i = heapq.heappop(heap)
            if d >= best or len(done) >= LOOK:
                return min(d, best)
            if i in done:
                continue
            done.add(i)
            for w, e, r in self.border.get(i, ()):
                best = min(best, d + w + (0.0 if r in free else e))
            p, q = first[i], first[i + 1]
            for j, w, e, r in zip(to[p:q], ws[p:q], entry[p:q], room[p:q]):
                far = d + w
                if e and r not in free:
                    far += e
                if far < best and far < left.get(j, none):
                    left[j] = far
                    heapq.heappush(heap, (far, j))
        return best

    def path(self, prev: dict, i: int) -> list[int]:
        """Nodes from an entry to a place."""
        path = []
        while i is not None:
            path.append(i + self.base)
            i = prev[i]
        return path[::-1]


_FOUND = "query_id {q}, kind string, node bigint, dist double, via bigint, source bigint, path array<bigint>"
_TAILS = "query_id {q}, tail double"
_STEPS = "query_id {q}, leg bigint, i bigint, node bigint"


def _set(values) -> set[int]:
    return set() if values is None else set(values)


def _walked(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """One round in one block: goals met, ways out and border distances of each query."""
    rows = []
    if len(asked) and len(packs):
        block = _Block(packs)
        base = block.base
        for q, entries, bound, goals, free, tail in asked[["query_id", "entries", "bound", "goals", "free", "tail"]].itertuples(index=False):
            free, tail = _set(free), float("inf") if pd.isna(tail) else tail
            entries = [(e["node"] - base, e["dist"]) for e in entries if block.here[e["node"] - base]]
            done, prev, source, goal, bound = block.search(entries, float("inf") if pd.isna(bound) else bound, set(block.places(_set(goals))), free, tail)
            if goal is not None:
                rows.append((q, "goal", goal + base, done[goal], None, source[goal] + base, block.path(prev, goal)))
            if not block.border and not block.outside:
                continue
            best: dict = {}
            for i, d in done.items():
                if i in block.border and i != goal:
                    rows.append((q, "border", i + base, d, None, None, None))
                for b, w, entry, room in block.outside.get(i, ()) if i != goal else ():
                    far = d + w + (0.0 if room in free else entry)
                    if far < bound and d + tail <= bound * (1 + SLACK) and (b not in best or (far, i) < best[b][:2]):
                        best[b] = (far, i, source[i])
            rows += [(q, "way", b, d, via + base, src + base, None) for b, (d, via, src) in best.items()]
    return pd.DataFrame(rows, columns=["query_id", "kind", "node", "dist", "via", "source", "path"], dtype=object)


def _tails(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """What it costs at least to come to the goals of each query in one block from outside."""
    rows = []
    if len(asked) and len(packs):
        block = _Block(packs)
        rows = [(q, block.tail(set(block.places(_set(goals))), _set(free))) for q, goals, free in asked[["query_id", "goals", "free"]].itertuples(index=False)]
    return pd.DataFrame(rows, columns=["query_id", "tail"])


def _stretches(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The nodes between two ends inside one block."""
    rows = []
    if len(asked):
        block = _Block(packs) if len(packs) else None
        for q, leg, first, last, free in asked[["query_id", "leg", "first", "last", "free"]].itertuples(index=False):
            path = [last]
            if first != last:
                _, prev, _, goal, _ = block.search([(first - block.base, 0.0)], float("inf"), {last - block.base}, _set(free))
                path = block.path(prev, goal)
            rows += [(q, leg, i, n) for i, n in enumerate(path)]
    return pd.DataFrame(rows, columns=["query_id", "leg", "i", "node"])


class _Search:
    def __init__(self, arcs: DataFrame, open_rooms: DataFrame | None, blocks: DataFrame):
        self.own, size = materialise(number_ranges(blocks.select("nid", "block"), ["block", "nid"], "node"))
        self.block = self.own.schema["block"].dataType.simpleString()
        spans, self.spans = materialise(self.own.groupBy("block").agg(F.min("node").alias("base"), F.count(F.lit(1)).alias("nodes")))
        at = lambda n, b: apart(self.own.select(F.col("nid").alias(n), F.col("node").alias(f"_{n}"), F.col("block").alias(b)), size["rows"])
        known = arcs.join(at("a", "block"), "a").join(at("b", "to_block"), "b")
        self.open_rooms, room = None, F.lit(-1)
        if open_rooms is not None:
            rooms, _ = materialise(number_ranges(open_rooms.select("room").distinct(), ["room"], "room_no"))
            self.open_rooms, _ = materialise(open_rooms.join(rooms, "room").groupBy("query_id").agg(F.collect_set("room_no").alias("free")))
            known, room = known.join(rooms.withColumnRenamed("room", "b_room"), "b_room", "left"), F.coalesce("room_no", F.lit(-1))
        known, _ = materialise(known.select("block", F.col("_a").alias("a"), F.col("_b").alias("b"), "to_block", "w", "entry", room.cast("int").alias("room")))
        marks = known.where("block <> to_block").groupBy(F.col("to_block").alias("block"), F.col("b").alias("a"), "entry", "room").agg(F.min("w").alias("w")).select(
            "block", "a", F.lit(-1).cast("bigint").alias("b"), "w", "entry", "room")
        rows = known.drop("to_block").unionByName(marks).join(spans, "block").withColumn("a", (F.col("a") - F.col("base")).cast("int"))
        packs = rows.withColumn("part", F.floor(F.col("a") / PACK)).groupBy("block", "part").applyInPandas(_packs, _ARCS.format(b=self.block))
        self.packs, _ = materialise(packs)
        self.load, _ = materialise(self.packs.groupBy("block").agg(F.sum("arcs").alias("load")))

    def types(self, schema: str, queries: DataFrame) -> str:
        return schema.format(q=queries.schema["query_id"].dataType.simpleString())

    def names(self, df: DataFrame, column: str, name: str, rows: int) -> DataFrame:
        """``df`` (up to ``rows`` rows) with the name of a numbered node instead of its number."""
        return df.join(apart(self.own.select(F.col("node").alias(column), F.col("nid").alias("_nid")), rows), column).drop(column).withColumnRenamed("_nid", name)

    def meet(self, asked: DataFrame, walk, schema: str) -> DataFrame:
        """``asked`` (``query_id, block, ...``) with the rooms it enters free of charge, beside the arcs of its blocks."""
        if self.open_rooms is not None:
            asked = asked.join(self.open_rooms, "query_id", "left")
        else:
            asked = asked.withColumn("free", F.lit(None).cast("array<bigint>"))
        counts = asked.groupBy("block").agg(F.count(F.lit(1)).alias("asked")).join(self.load, "block", "left")
        at_once = F.greatest(F.lit(SLICE), F.floor(F.coalesce("load", F.lit(0)) / LOAD))
        slices, _ = materialise(counts.select("block", F.ceil(F.col("asked") / at_once).cast("int").alias("slices")))
        asked = asked.join(slices, "block").withColumn("slice", F.pmod(F.hash("query_id"), F.col("slices"))).drop("slices")
        packs = self.packs.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        return packs.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInPandas(walk, self.types(schema, asked))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortest_walks(arcs: DataFrame, starts: DataFrame, goals: DataFrame, open_rooms: DataFrame | None = None, blocks: DataFrame | None = None,
                   report: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cheapest walk from any start to any goal, for a whole table of queries.

    ``arcs``: ``a, b, w, entry, b_room``, no weight negative; ``starts`` and
    ``goals``: ``query_id, nid``; ``open_rooms``: ``query_id, room`` entered free of
    charge; ``blocks``: ``nid, block``, by default runs of nodes in the order of their
    names. Returns the answers ``query_id, goal, cost`` and the walks ``query_id,
    step, nid``. ``report`` is told the rows read and written in each round.
    """
    if blocks is None:
        names = arcs.select(F.col("a").alias("nid")).unionByName(arcs.select(F.col("b").alias("nid"))).unionByName(starts.select("nid")).distinct()
        blocks = _runs(names, ["nid"], None)
    search = _Search(arcs, open_rooms, blocks)
    targets, asked_for = materialise(goals.select("query_id", "nid").distinct().join(search.own, "nid").groupBy("query_id", "block").agg(F.collect_list("node").alias("goals")))
    asked_for, tails = asked_for["rows"], None
    if search.spans["rows"] > 1:
        tails, _ = materialise(search.meet(targets, _tails, _TAILS).groupBy("query_id").agg(F.min("tail").alias("tail")))
    unknown = lambda: F.lit(None).cast("bigint")
    entries, seen = materialise(starts.select("query_id", "nid").distinct().join(search.own, "nid").select(
        "query_id", "node", "block", F.lit(0.0).alias("dist"), unknown().alias("via"), unknown().alias("source")))
    ways, found, known, told = [entries], [], [entries.select("query_id", "node", "dist")], seen["rows"]
    while seen["rows"]:
        grouped = entries.groupBy("query_id", "block").agg(F.collect_list(F.struct("node", "dist")).alias("entries"))
        asked = grouped.join(apart(targets, asked_for), ["query_id", "block"], "left")
        best = _union(found).where("kind = 'goal'").groupBy("query_id").agg(F.min("dist").alias("bound")) if found else None
        asked = asked.join(apart(best, asked_for), "query_id", "left") if found else asked.withColumn("bound", F.lit(None).cast("double"))
        asked = asked.join(apart(tails, asked_for), "query_id", "left") if tails is not None else asked.withColumn("tail", F.lit(None).cast("double"))
        out, wrote = materialise(search.meet(asked, _walked, _FOUND), rows=F.count(F.lit(1)), ways=F.count_if(F.col("kind") == "way"))
        found.append(out)
        if report is not None:
            report.append({"entries": seen["rows"], "written": wrote["rows"]})
        if not wrote["ways"]:
            break
        fresh = out.where("kind = 'way'").groupBy("query_id", "node").agg(F.min(F.struct("dist", "via", "source")).alias("m")).join(apart(search.own.select("node", "block"), wrote["ways"]), "node")
        known.append(out.where("kind = 'border'").select("query_id", "node", "dist"))
        least, told = _union(known).groupBy("query_id", "node").agg(F.min("dist").alias("dist")), told + wrote["rows"]
        if len(known) > PARTS:
            least, _ = materialise(least)
            known = [least]
        best = _union(found).where("kind = 'goal'").groupBy("query_id").agg(F.min("dist").alias("bound"))
        better = fresh.join(apart(least.withColumnRenamed("dist", "known"), told), ["query_id", "node"], "left").join(apart(best, asked_for), "query_id", "left").where(
            (F.col("known").isNull() | (F.col("m.dist") < F.col("known"))) & (F.col("bound").isNull() | (F.col("m.dist") < F.col("bound"))))
        entries, seen = materialise(better.select("query_id", "node", "block", "m.dist", "m.via", "m.source"))
        ways.append(entries)
        known.append(entries.select("query_id", "node", "dist"))
    if not found:
        none = search.names(entries, "node", "nid", 0)
        return none.select("query_id", F.col("nid").alias("goal"), F.col("dist").alias("cost")), none.select("query_id", F.lit(0).cast("bigint").alias("step"), "nid")
    met = _union(found).where("kind = 'goal'").groupBy("query_id").agg(F.min(F.struct("dist", "node", "source", "path")).alias("m"))
    met = search.names(met.select("query_id", F.col("m.node").alias("_goal"), F.col("m.dist").alias("cost"), F.col("m.source").alias("entry"), F.col("m.path").alias("path")), "_goal", "goal", asked_for)
    met, _ = materialise(met)
    return met.select("query_id", "goal", "cost"), _walks(search, met, _union(ways))


def _walks(search: _Search, met: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes of every walk in order, from the ways into blocks that led to its goal."""
    led = ways.join(met.select("query_id"), "query_id", "left_semi").groupBy("query_id", "node", "block").agg(F.min(F.struct("dist", "via", "source")).alias("m"))
    led, _ = materialise(led.select("query_id", "node", "block", "m.dist", "m.via", F.col("m.source").alias("prev")))
    chain, _ = materialise(walk_back(met.select("query_id", F.col("entry").alias("goal"), "cost"), led.select("query_id", "node", "dist", "prev")))
    legs = chain.select("query_id", F.col("step").alias("leg"), F.col("nid").alias("node")).join(led.select("query_id", "node", "block", "via"), ["query_id", "node"])
    ends = legs.select("query_id", (F.col("leg") - 1).alias("leg"), F.col("via").alias("last"))
    legs, _ = materialise(legs.join(ends, ["query_id", "leg"], "left"))
    steps = legs.where("last IS NULL").join(met.select("query_id", "path"), "query_id").select("query_id", "leg", F.posexplode("path").alias("i", "node"))
    steps = steps.withColumn("i", F.col("i").cast("bigint"))
    asked, more = materialise(legs.where("last IS NOT NULL").select("query_id", "leg", "block", F.col("node").alias("first"), "last"))
    if more["rows"]:
        steps = steps.unionByName(search.meet(asked, _stretches, _STEPS))
    steps, n = materialise(steps)
    sizes = steps.groupBy("query_id", "leg").agg(F.count(F.lit(1)).alias("n"))
    before = running(sizes, ["query_id"], "leg", sums={"upto": F.col("n")}).select("query_id", "leg", (F.col("upto") - F.col("n")).alias("base"))
    out = steps.join(apart(before, n["rows"]), ["query_id", "leg"]).select("query_id", (F.col("base") + F.col("i")).alias("step"), "node")
    return search.names(out, "node", "nid", n["rows"]).select("query_id", "step", "nid")
