"""Weekly timetables: what is on, what is next, what is due.

A week has 10 080 minutes. Class starts and asked-for moments are reduced to one
row per (user, minute) before they meet, so no user brings more rows to a task
than two weeks have minutes, however many classes or questions they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegraph.functions import clock, text


def check_classes(classes: DataFrame) -> DataFrame:
    """``error`` says why a class row is refused; NULL when it is fine."""
    need = lambda c: ~text.filled(c)
    error = (F.when(need("title"), "NO_TITLE").when(need("building") | need("room"), "NO_PLACE")
             .when(F.coalesce(F.size("days"), F.lit(0)) <= 0, "NO_DAY")
             .when(need("start_time") | need("end_time"), "NO_HOURS")
             .when(F.col("end_time") <= F.col("start_time"), "HOURS_REVERSED"))
    return classes.withColumn("error", error)


def clean_classes(classes: DataFrame) -> DataFrame:
    days = F.array_sort(F.array_distinct(F.filter("days", lambda d: d.between(0, 6))))
    return classes.withColumn("building", F.upper("building")).withColumn("room", F.col("room").cast("string")).withColumn(
        "floor", text.blank_to_null(F.col("floor").cast("string"))).withColumn("days", days)


def timetable_order(classes: DataFrame) -> DataFrame:
    """By earliest day (none last), then start time as text."""
    return classes.orderBy("user_id", F.coalesce(F.array_min("days"), F.lit(7)), "start_time", "ord")


def week_view(classes: DataFrame) -> DataFrame:
    """One row per class and day, Monday first, by start."""
    d = classes.withColumn("day", F.explode("days")).withColumn("col", F.pmod(F.col("day") + 6, F.lit(7))).withColumn(
        "start_min", clock.minutes_of("start_time"))
    return d.withColumn("starts", clock.twelve_hour("start_time")).withColumn("ends", clock.twelve_hour("end_time")).orderBy(
        "user_id", "col", "start_min", "ord")


def _meetings(classes: DataFrame) -> DataFrame:
    d = classes.select("user_id", "ord", F.explode("days").alias("day"), clock.minutes_of("start_time").alias("s"), clock.minutes_of("end_time").alias("e"))
    return d.groupBy("user_id", "day", "s", "e").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def _running_class(slots: DataFrame, meetings: DataFrame) -> DataFrame:
    """First and last class of the user's order that is on at each (user, slot)."""
    hours = meetings.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / 60), F.floor((F.greatest(F.col("e"), F.col("s") + 1) - 1) / 60))))
    at = slots.withColumn("day", F.floor(F.col("slot") / clock.DAY).cast("int")).withColumn("m", F.col("slot") % clock.DAY).withColumn("hour", F.floor(F.col("m") / 60))
    on = at.join(hours, ["user_id", "day", "hour"]).where((F.col("m") >= F.col("s")) & (F.col("m") < F.col("e")))
    return on.groupBy("user_id", "slot").agg(F.min("first").alias("on_first"), F.max("last").alias("on_last"))


def _next_start(slots: DataFrame, meetings: DataFrame) -> DataFrame:
    """The nearest later start of each (user, slot), around the week; one starting at that very minute never counts."""
    starts = meetings.groupBy("user_id", (F.col("day") * clock.DAY + F.col("s")).cast("int").alias("slot")).agg(F.min("first").alias("c"))
    both = starts.select("user_id", "slot", F.struct("slot", "c").alias("st"), F.lit(False).alias("ask")).unionByName(
        slots.select("user_id", "slot", F.lit(None).cast(starts.select(F.struct("slot", "c").alias("x")).schema["x"].dataType).alias("st"), F.lit(True).alias("ask")))
    w = Window.partitionBy("user_id").orderBy("slot")
    after = F.first("st", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))
    first = F.min("st").over(Window.partitionBy("user_id"))
    around = F.when(first["slot"] < F.col("slot"), first)
    got = both.withColumn("n", F.coalesce(after, around)).where("ask")
    return got.select("user_id", "slot", F.col("n.c").alias("next"), F.pmod(F.col("n.slot") - F.col("slot"), F.lit(clock.WEEK)).alias("in_minutes"))


def now_and_next(ticks: DataFrame, classes: DataFrame) -> DataFrame:
    """``tick_id, current, next, in_minutes`` for every (user, moment) asked."""
    t = ticks.withColumn("slot", clock.week_slot("ts"))
    slots = t.select("user_id", "slot").distinct()
    m = _meetings(classes)
    answer = _next_start(slots, m).join(_running_class(slots, m), ["user_id", "slot"], "left")
    return t.join(answer, ["user_id", "slot"], "left").select("tick_id", F.col("on_last").alias("current"), "next", "in_minutes")


def due_now(ticks: DataFrame, classes: DataFrame, soon: int = 30) -> DataFrame:
    """The class to show now: one that is on (first in order), else the soonest of today within ``soon`` minutes."""
    t = ticks.withColumn("slot", clock.week_slot("ts"))
    slots = t.select("user_id", "slot").distinct()
    m = _meetings(classes)
    later = _next_start(slots, m)
    today = (F.floor((F.col("slot") + F.col("in_minutes")) / clock.DAY) == F.floor(F.col("slot") / clock.DAY)) & (F.col("in_minutes") <= soon)
    later = later.where(today)
    answer = slots.join(later, ["user_id", "slot"], "left").join(_running_class(slots, m), ["user_id", "slot"], "left")
    answer = answer.select("user_id", "slot", F.coalesce("on_first", "next").alias("due"),
                           F.when(F.col("on_first").isNotNull(), "now").otherwise("soon").alias("status"),
                           F.when(F.col("on_first").isNull(), F.col("in_minutes")).alias("until")).where("due IS NOT NULL")
    return t.join(answer, ["user_id", "slot"]).select("tick_id", "due", "status", "until")
