"""The library's long-lived behaviour as Structured Streaming jobs.

Every job uses the operators of the batch side, or a state whose result is the
same, so a stream run to its end equals the batch query on all its rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placegraph.functions import clock
from placegraph.operators import activity, changes, naming, timetable
from placegraph.sources import sinks

def ingest_changes(stream: DataFrame, root: str, columns: list[str], checkpoint: str, outlines: DataFrame | None = None) -> DataStreamWriter:
    """Deltas applied to a versioned network, one version per batch that holds any.

    A change made against another version than the one its batch starts from, a
    change that fails the feature checks and one that leaves a link hanging go to
    ``rejects`` and are never applied. A batch writes its version, then its log, and
    last commits; numbers are never used twice, so readers and later batches see
    committed versions only. With ``outlines``, nodes that name no building are given
    the place they stand in before they are stored. Logs are kept by checkpoint and batch: a batch run twice
    is applied once, and a stream begun anew is judged by its base versions alone.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    table = f"{root}/table"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = f"{root}/log/run={run}/batch={batch_id}"
        if batch.isEmpty():
            return
        if sinks.exists(spark, f"{log}/_SUCCESS"):  # cut between log and commit, or run again
            sinks.commit(spark, table, spark.read.parquet(log).first().version)
            return
        if outlines is not None:
            batch = naming.fill_blank_building(batch, outlines).drop("filled")
        version = sinks.current_version(spark, table)
        sinks.commit(spark, table, version)  # what this batch leaves unfinished is not taken for current
        current = sinks.read_version(spark, table, version)
        guarded = changes.check_features(changes.version_guard(batch, version))
        put = F.col("op").isin("add", "update")
        bad = F.when(~F.col("accepted"), "version moved on").when(put & F.col("error").isNotNull(), F.col("error")).when(put & changes.feature_key().isNull(), "no id")
        guarded = guarded.withColumn("reason", bad).persist()
        good = guarded.where("reason IS NULL")
        applied = changes.apply_delta(current, good, columns)
        merged = changes.merged_features(applied, columns)
        ids = merged.where("type = 'node'").select("nid")
        loose = merged.where("type = 'path'").select("key", F.explode(F.array("a", "b")).alias("nid")).join(ids, "nid", "left_anti")
        refused = not loose.isEmpty() or changes.shrink_guard(current.where("type = 'node'"), merged.where("type = 'node'")).first().refused
        rejects = guarded.where("reason IS NOT NULL") if not refused else guarded.withColumn("reason", F.coalesce("reason", F.lit("would break the network")))
        rejects.select("op", "seq", changes.feature_key().alias("key"), "base_version", "reason").write.mode("overwrite").parquet(f"{root}/rejects/run={run}/batch={batch_id}")
        after = version
        if not refused and not good.isEmpty():
            after = sinks.next_version(spark, table)
            numbered = applied.where("kept").select(*columns, (F.col("section") * (1 << 50) + F.coalesce(F.col("pos.o"), F.lit(0)) * (1 << 48) + F.col("pos.seq")).alias("ord"))
            sinks.write_version(numbered, table, after)
        changes.delta_counts(applied).withColumn("version", F.lit(after)).write.mode("overwrite").parquet(log)
        sinks.commit(spark, table, after)
        guarded.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def keep_favourites(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Favourite adds, uses and removes folded into a table of each key's last of each.

    Last-of-each merges by maximum, so a batch run twice changes nothing. The
    current favourites are :func:`current_favourites` of the table.
    """

    def fold(log: DataFrame) -> DataFrame:
        at = F.struct("ts", "event_id")
        last = lambda op: F.max(F.when(F.col("op") == op, at)).alias(op)
        return log.where(F.col("op").isin("add", "use", "remove")).groupBy("user_id", "node_id").agg(last("add"), last("use"), last("remove"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = fold(batch)
        if sinks.current_version(spark, root) is not None:
            both = sinks.read_version(spark, root).unionByName(new)
            new = both.groupBy("user_id", "node_id").agg(*[F.max(c).alias(c) for c in ("add", "use", "remove")])
        version = sinks.next_version(spark, root)
        sinks.write_version(new, root, version)
        sinks.commit(spark, root, version)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_favourites(spark: SparkSession, root: str) -> DataFrame:
    s = sinks.read_version(spark, root)
    here = F.col("add").isNotNull() & (F.col("remove").isNull() | (F.col("add") > F.col("remove")))
    return s.where(here).select("user_id", "node_id", F.col("add.ts").alias("added_at"), F.greatest("add", "use")["ts"].alias("last_used"))


def recents(stream: DataFrame, k: int = 8, late: str = "1 day") -> DataFrame:
    """Each user's last k rooms after every batch (update mode): ``user_id, rank, building, floor, room, event_id``.

    Rooms go by ``(ts, event_id)`` as in the batch query. The state is a user's rooms,
    one entry each however often seen; it is kept, as the batch query forgets nobody.
    """
    v = stream.withWatermark("ts", late).where(activity.well_formed_visit(F.col("building"), F.col("room"))).select(
        "user_id", F.upper("building").alias("building"), "room", F.nullif("floor", F.lit("")).alias("floor"), "ts", clock.micros("ts").alias("us"), "event_id")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # By room: its last visit and its last visit with a floor, both by (time, id).
        seen = json.loads(state.get[0]) if state.exists else {}
        for f in frames:
            for r in f.itertuples(index=False):
                name, at = f"{r.building}\t{r.room}", [int(r.us), int(r.event_id)]
                last, known, floor = seen.get(name, [[-1, -1], [-1, -1], None])
                if isinstance(r.floor, str) and at > known:
                    known, floor = at, r.floor
                seen[name] = [max(at, last), known, floor]
        state.update((json.dumps(seen),))
        top = sorted(seen.items(), key=lambda kv: kv[1][0], reverse=True)[:k]
        yield pd.DataFrame([(key[0], i + 1, n.split("\t")[0], e[2], n.split("\t")[1], e[0][1]) for i, (n, e) in enumerate(top)],
                           columns=["user_id", "rank", "building", "floor", "room", "event_id"])

    return v.groupBy("user_id").applyInPandasWithState(
        step, "user_id string, rank int, building string, floor string, room string, event_id bigint", "seen string", "update", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, gap: str = "5 days", late: str = "1 day") -> DataFrame:
    """Rolling sessions closed by a silence of ``gap``; ``ts`` is a timestamp with time zone."""
    w = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "events")


def throttled_touches(stream: DataFrame, gap_us: int, late: str = "1 day") -> DataFrame:
    """Touches let through, at most one per ``gap_us`` and user (append mode): ``user_id, t``.

    A touch is decided once the watermark has passed it, so rows may come in any
    order within ``late`` and the result is the batch query's. Until then it waits
    in the user's state; the state goes when nothing waits and the last touch that
    passed is a whole gap behind the watermark.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
        waiting = sorted(waiting + [int(t) for f in frames for t in f["t"]])
        mark = state.getCurrentWatermarkMs() * 1000
        passed, ripe = [], 0
        while ripe < len(waiting) and waiting[ripe] <= mark:
            if last is None or waiting[ripe] - last >= gap_us:
                last = waiting[ripe]
                passed.append(last)
            ripe += 1
        waiting = waiting[ripe:]
        if waiting or last is not None and last + gap_us > mark:
            state.update((last, json.dumps(waiting)))
            state.setTimeoutTimestamp(max((waiting[0] if waiting else last + gap_us) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(passed), "t": passed})

    timed = stream.select("user_id", "t", F.timestamp_micros("t").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id string, t bigint", "last bigint, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def expiry_sweep(stream: DataFrame, ttl: str = "5 days", late: str = "1 hour") -> DataFrame:
    """Keys whose last touch is a full ttl behind the stream (append mode): ``user_id, expired``."""
    w = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.count(F.lit(1)).alias("touches"))
    return w.select("user_id", F.col("w.end").alias("expired"))


def status_windows(stream: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests per status class and window; late rows within the watermark still count."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    kind = F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))
    g = stream.withWatermark("ts", late).groupBy(win.alias("w"), kind.alias("class")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "class", "requests")


def route_critical(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Requests appended to one table, critical ones also to a side table; a batch run twice rewrites itself."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{root}/requests/batch={batch_id}")
        batch.where(activity.is_critical(F.col("message"))).write.mode("overwrite").parquet(f"{root}/critical/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def due_classes(ticks: DataFrame, classes: DataFrame, root: str, checkpoint: str, soon: int = 30) -> DataStreamWriter:
    """Each moment joined with the timetable of its user: the class to show then."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        timetable.due_now(batch, classes, soon).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)


def distinct_changes(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A change sent twice within the watermark is passed on once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
