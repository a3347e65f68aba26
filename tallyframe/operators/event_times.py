"""Times of events told by sources of different authority, some relative to other events, and how two events relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.operators.temporal import interval_relation
from tallyframe.plans.session import stored

#: The reason of each relation.
REASONS = {"before": "a_ends_before_b_starts", "after": "a_starts_after_b_ends", "during": "a_within_b", "conflicting": "conflicting_timestamps"}

#: Rounds whose events are put together in one write.
TOGETHER = 8


def _minutes_later(local: Column, minutes: Column) -> Column:
    """Minutes of the wall clock: to be taken before a zone is applied."""
    return F.timestamp_micros(F.unix_micros(local) + minutes.cast("long") * 60_000_000)


def _interval(local: Column, minutes: Column, zone: Column) -> Column:
    """Half-open interval in UTC of a local time and its duration by the wall clock; null if the time or zone is."""
    known = local.isNotNull() & zone.isNotNull()
    start = F.to_utc_timestamp(local, zone)
    return F.when(known, F.struct(start.alias("start"), F.to_utc_timestamp(_minutes_later(local, F.coalesce(minutes, F.lit(0))), zone).alias("end")))


def _told(s: DataFrame) -> DataFrame:
    """Sources met with their anchors: `waits` (the anchor isn't decided yet) or an interval, null if it can't be known."""
    day = F.date_add(F.to_date(F.from_utc_timestamp("anchor_start", F.col("zone"))), F.col("offset_days").cast("int"))
    relative = F.when(F.col("anchor_state") == "known", _interval(F.to_timestamp(F.concat(day.cast("string"), F.lit(" "), "at")), F.col("minutes"), F.col("zone")))
    whole_day = F.date_trunc("day", "when")
    absolute = F.when(F.coalesce("date_only", F.lit(False)), _interval(whole_day, F.lit(1440), F.col("zone"))).otherwise(_interval(F.col("when"), F.col("minutes"), F.col("zone")))
    own = F.when(F.col("anchor").isNull(), absolute).otherwise(relative)
    return s.select("world", "event", (F.col("anchor").isNotNull() & F.col("anchor_state").isNull()).alias("waits"), own.alias("interval"))


def event_intervals(sources: DataFrame) -> DataFrame:
    """world, event, state, start, end (UTC, half-open) of every event that is told of.

    sources: world, event, authority (null: 1), zone; either `when` (a local time) with date_only (the whole day) or
    minutes (null: 0), or anchor (an event of the world), offset_days, at (HH:MM) and minutes: so many days after the
    anchor's start, both by the source's own calendar. Only an event's sources of the highest authority count. States:

    known; unknown: one of these sources tells no time, or its anchor's time isn't known; conflict: they tell different
    times; cyclic: events wait for each other. An anchor that no source tells of is unknown. Equal sources are one.

    Anchors are resolved in rounds, each written: as many as the longest chain of anchors is long. A world of any size
    is spread over tasks: nothing is gathered by world.
    """
    columns = ["world", "event", "authority", "zone", "when", "date_only", "minutes", "anchor", "offset_days", "at"]
    given = sources.select(*columns).withColumn("authority", F.coalesce("authority", F.lit(1)))
    highest = given.groupBy("world", "event").agg(F.max("authority").alias("highest"))
    left = stored(join_null_safe(given, highest, ["world", "event"]).where("authority = highest").drop("authority", "highest").distinct())
    nobody = left.where("anchor IS NOT NULL").select("world", F.col("anchor").alias("event")).distinct()
    nothing = F.lit(None).cast("timestamp")
    nobody = join_null_safe(nobody, left.select("world", "event").distinct(), ["world", "event"], "left_anti")
    decided = stored(nobody.select("world", "event", F.lit("unknown").alias("state"), nothing.alias("start"), nothing.alias("end"), F.lit(False).alias("told")))
    rounds = 0
    while True:
        anchors = decided.select("world", F.col("event").alias("anchor"), F.col("state").alias("anchor_state"), F.col("start").alias("anchor_start"))
        told = _told(join_null_safe(left, anchors, ["world", "anchor"], "left"))
        events = told.groupBy("world", "event").agg(
            F.sum(F.col("waits").cast("int")).alias("waiting"), F.bool_or(~F.col("waits") & F.col("interval").isNull()).alias("dark"), F.min("interval").alias("least"), F.max("interval").alias("most"),
        )
        ready = events.where("dark OR waiting = 0")
        state = F.when(F.col("dark"), "unknown").when(F.col("least") != F.col("most"), "conflict").otherwise("known")
        time = lambda name: F.when(F.col("state") == "known", F.col(f"least.{name}")).alias(name)
        fresh = stored(ready.withColumn("state", state).select("world", "event", "state", time("start"), time("end"), F.lit(True).alias("told")))
        if fresh.isEmpty():
            break
        # What is written stays where it is; only now and then is it put together, so that no plan grows with the chain.
        rounds += 1
        decided = decided.unionByName(fresh) if rounds % TOGETHER else stored(decided.unionByName(fresh))
        left = stored(join_null_safe(left, fresh.select("world", "event"), ["world", "event"], "left_anti"))
    cyclic = left.select("world", "event").distinct().select("world", "event", F.lit("cyclic").alias("state"), nothing.alias("start"), nothing.alias("end"))
    return decided.where("told").drop("told").unionByName(cyclic)


def relations(questions: DataFrame, intervals: DataFrame) -> DataFrame:
    """questions (world, a, b) with relation and reason of event a to event b.

    conflicting, before, after, during or unknown; an event that is unknown, cyclic or not told of at all is a missing time.
    """
    side = lambda x: intervals.select("world", F.col("event").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("state", "start", "end")])
    met = join_null_safe(join_null_safe(questions, side("a"), ["world", "a"], "left"), side("b"), ["world", "b"], "left")
    conflict = F.coalesce(F.col("a_state") == "conflict", F.lit(False)) | F.coalesce(F.col("b_state") == "conflict", F.lit(False))
    relation = interval_relation(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"), conflict)
    missing = F.col("a_start").isNull() | F.col("b_start").isNull()
    named = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    reason = F.coalesce(F.try_element_at(named, F.col("relation")), F.when(missing, "missing_or_underspecified_time").otherwise("partial_overlap_or_underspecified"))
    return met.withColumn("relation", relation).withColumn("reason", reason).select(*questions.columns, "relation", "reason")
