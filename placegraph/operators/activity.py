"""Favourites, recents, sessions, throttled touches and request counts.

All fold their events per key with plain aggregates first; no step reads one
user's raw events in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegraph.functions import text
from placegraph.operators.common import running, top_k
from placegraph.session import discard, materialise


def favourite_state(log: DataFrame) -> DataFrame:
    """Favourites left after an ordered log of add, use and remove.

    A favourite is there when its last add follows its last remove; adding again
    resets ``added_at``; a use of something absent changes nothing. ``log``:
    ``user_id, node_id, op, ts, event_id``.
    """
    at = F.struct("ts", "event_id")
    last = lambda op: F.max(F.when(F.col("op") == op, at))
    s = log.where(F.col("op").isin("add", "use", "remove")).groupBy("user_id", "node_id").agg(
        last("add").alias("a"), last("use").alias("u"), last("remove").alias("r"))
    here = F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("a") > F.col("r")))
    return s.where(here).select("user_id", "node_id", F.col("a.ts").alias("added_at"), F.greatest("a", "u")["ts"].alias("last_used"))


def top_favourites(favourites: DataFrame, k: int = 100) -> DataFrame:
    """Each user's favourites by last use, newest first; rows never used are left out."""
    return top_k(favourites.where(F.col("last_used").isNotNull()), ["user_id"], [F.col("last_used").desc(), F.col("node_id")], k)


def favourite_markers(favourites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map markers: room favourites carry their own position, others take their node's, if it exists.

    ``favourites``: ``user_id, node_id, label, added_at, node_meta`` (a string map).
    """
    meta = lambda k: F.col("node_meta").getItem(k)
    label = F.coalesce(F.nullif("label", F.lit("")), F.date_format("added_at", "yyyy-MM-dd"))
    kind = F.coalesce(meta("kind"), F.lit(""))
    rooms = favourites.where(kind == "room").select(
        "user_id", "node_id", meta("lng").try_cast("double").alias("lng"), meta("lat").try_cast("double").alias("lat"),
        F.coalesce(label, F.concat_ws("-", meta("building"), meta("room"))).alias("label")).where("lng IS NOT NULL AND lat IS NOT NULL")
    old = favourites.where(kind != "room").select("user_id", "node_id", label.alias("label")).join(
        nodes.select(F.col("nid").alias("node_id"), "lng", "lat"), "node_id").select("user_id", "node_id", "lng", "lat", "label")
    return rooms.unionByName(old)


def well_formed_visit(building: Column, room: Column) -> Column:
    """A room number never holds its own building code."""
    b, r = F.upper(building), F.upper(room)
    return text.filled(building) & text.filled(room) & ~F.startswith(r, F.concat(b, F.lit("-"))) & (r != b)


def recents(visits: DataFrame, codes: DataFrame | None = None, k: int = 8) -> DataFrame:
    """Each user's last k rooms, newest first, one entry per room, the last known floor kept.

    ``codes`` (``code``) drops rooms that are a place's name split in two, or another place's code.
    """
    v = visits.where(well_formed_visit(F.col("building"), F.col("room"))).select(
        "user_id", F.upper("building").alias("building"), "room", F.nullif("floor", F.lit("")).alias("floor"), "ts", "event_id")
    at = F.struct("ts", "event_id")
    one = v.groupBy("user_id", "building", "room").agg(F.max(at).alias("at"), F.max_by("floor", F.when(F.col("floor").isNotNull(), at)).alias("floor"))
    if codes is not None:
        c = codes.select(F.upper("code").alias("_c")).distinct()
        one = one.join(c, F.concat_ws(" ", "building", F.upper("room")) == F.col("_c"), "left_anti").join(c, F.upper("room") == F.col("_c"), "left_anti")
    return top_k(one, ["user_id"], [F.col("at").desc()], k).select("user_id", "rank", "building", "floor", "room", F.col("at.ts").alias("ts"))


def sessions(events: DataFrame, gap_us: int, key: str = "user_id", t: str = "t") -> DataFrame:
    """Sessions closed by a silence of at least ``gap_us``; ``t`` is in microseconds.

    Events of one gap-wide slot are always in one session, so each (key, slot)
    becomes one row before sessions are formed: a key's rows are bounded by time
    span over gap, not by its events.
    """
    slots = events.groupBy(key, F.floor(F.col(t) / F.lit(gap_us)).alias("slot")).agg(
        F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("slot")
    prev = F.lag("hi").over(w)
    starts = slots.withColumn("new", F.when(prev.isNull() | (F.col("lo") - prev >= gap_us), 1).otherwise(0))
    ids = starts.withColumn("sid", F.sum("new").over(w))
    return ids.groupBy(key, "sid").agg(F.min("lo").alias("start"), F.max("hi").alias("last"), F.sum("n").alias("events")).drop("sid")


def throttle(events: DataFrame, gap_us: int, key: str = "user_id", t: str = "t", chunk_us: int | None = None) -> DataFrame:
    """Touches let through when at most one passes per ``gap_us`` and key: ``key, t``.

    An event a full gap after the one before it always passes. From there the
    next to pass is the first event a gap later: that pointer is found for every
    event with one running pass, and chains are followed by doubling, so long
    chains of one key are spread over tasks and take log2(length) rounds.
    """
    e, _ = materialise(events.select(key, t).distinct())
    chunk = chunk_us or gap_us * 16
    # Walking backwards in time, the last event seen is the first one after.
    back = e.select(key, (-F.col(t)).alias("p"), F.lit(0).alias("kind"), F.col(t).alias("v"), F.lit(None).cast("bigint").alias("src"))
    asks = e.select(key, (-(F.col(t) + gap_us)).alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("v"), F.col(t).alias("src"))
    nxt = running(back.unionByName(asks), [key], "p", lasts={"nxt": F.col("v")}, tie=["kind"], chunk=chunk).where("kind = 1").select(
        key, F.col("src").alias(t), "nxt")
    crowded = _crowded(e, key, t, gap_us, chunk)
    jump, n = materialise(nxt.join(crowded, [key, t], "left").select(key, t, "nxt", F.coalesce("crowded", F.lit(False)).alias("crowded")))
    passed, _ = materialise(jump.where(~F.col("crowded")).select(key, t))
    # A pointer that lands on an anchor needs no following.
    hop = jump.where("nxt IS NOT NULL").select(key, t, F.col("nxt").alias("to")).join(
        passed.select(key, F.col(t).alias("to")), [key, "to"], "left_anti")
    hop, n = materialise(hop)
    while n["rows"]:
        more = passed.join(hop, [key, t]).select(key, F.col("to").alias(t))
        longer, got = materialise(passed.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1))).groupBy(key, t).agg(F.min("_n").alias("_n")), new=F.sum("_n"))
        passed = longer.drop("_n")
        if not got["new"]:
            break
        after, n = materialise(hop.join(hop.select(key, F.col(t).alias("to"), F.col("to").alias("far")), [key, "to"]).select(key, t, F.col("far").alias("to")))
        discard(hop)
        hop = after
    return passed


def _crowded(e: DataFrame, key: str, t: str, gap_us: int, chunk: int | None) -> DataFrame:
    """Events with another event of the key less than a gap before them."""
    shifted = e.select(key, (F.col(t) + 1).alias("p"), F.lit(0).alias("kind"), F.col(t).alias("v"))
    asks = e.select(key, F.col(t).alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("v"))
    seen = running(shifted.unionByName(asks), [key], "p", lasts={"prev": F.col("v")}, tie=["kind"], chunk=chunk).where("kind = 1")
    return seen.select(key, F.col("p").alias(t), (F.coalesce(F.col("p") - F.col("prev") < gap_us, F.lit(False))).alias("crowded"))


def expired(sessions_table: DataFrame, now: Column, column: str = "expires") -> DataFrame:
    return sessions_table.where(F.col(column) < now)


def status_counts(log: DataFrame, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    """Requests per status class: 2xx, 3xx, 4xx, 5xx, and per the columns ``by``."""
    return log.groupBy(*by, F.concat(F.floor(F.col(status) / 100).cast("string"), F.lit("xx")).alias("class")).agg(F.count(F.lit(1)).alias("requests"))


def is_critical(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("firebase|auth"), F.lit(False))


def look_up(asks: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored row of every asked key, all NULL where there is none; ``found`` tells which."""
    return asks.join(stored.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def merge_profiles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Profiles inserted when absent, filled fields merged over the old ones otherwise."""
    inc = incoming.groupBy("user_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias("_" + c) for c in current.columns if c != "user_id"])
    j = current.join(inc, "user_id", "full_outer")
    return j.select("user_id", *[F.coalesce("_" + c, c).alias(c) for c in current.columns if c != "user_id"])


def ensure_profiles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-if-absent: profiles already there are left alone."""
    first = incoming.groupBy("user_id").agg(*[F.min_by(c, "seq").alias(c) for c in current.columns if c != "user_id"])
    return current.unionByName(first.join(current.select("user_id"), "user_id", "left_anti"))
