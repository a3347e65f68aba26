"""Effective dating, trailing sums, interval relations and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions_with_end(revisions: DataFrame, key: str, effective: str) -> DataFrame:
    """revisions with effective_to: the next revision's start, null for the last."""
    return revisions.withColumn("effective_to", F.lead(effective).over(Window.partitionBy(key).orderBy(effective)))


def as_of(facts: DataFrame, revisions: DataFrame, key: str, at: str, effective: str, value: str) -> DataFrame:
    """facts with `value` of the latest revision of the key that is effective at or before `at`; null if there is none.

    A key's revisions are gathered into one row's array (few for a key), so the join is an equi-join whatever the
    number of revisions, and facts are not multiplied. Arrays are dealt by key: Spark takes them for as small as the
    revisions' source and would send them all through the driver.
    """
    arrays = revisions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(effective).alias("e"), F.col(value).alias("v")))).alias("__r"))
    found = F.aggregate("__r", F.lit(None).cast(revisions.schema[value].dataType), lambda acc, r: F.when(r["e"] <= F.col(at), r["v"]).otherwise(acc))
    return facts.join(arrays.hint("shuffle_hash"), key, "left").withColumn(value, found).drop("__r")


def trailing_sum(rows: DataFrame, key: str, day: Column, amount: str, days: int) -> DataFrame:
    """rows with `linked`: the key's amounts of the days before, 0 < gap <= days; the same day doesn't count.

    Rows are added up by key and day first, so a window holds a key's days rather than its rows.
    """
    daily = rows.groupBy(key, day.alias("__day")).agg(F.sum(amount).alias("__a"))
    sums = daily.withColumn("__linked", F.sum("__a").over(Window.partitionBy(key).orderBy("__day").rangeBetween(-days, -1))).drop("__a")
    keyed = rows.withColumn("__day", day)
    return keyed.join(sums, [key, "__day"]).withColumn("linked", F.round(F.coalesce("__linked", F.lit(0.0)), 2)).drop("__day", "__linked")


def interval_relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column, conflict: Column | None = None) -> Column:
    """conflicting, unknown, before, after or during of half-open intervals; the order of the tests matters.

    conflict: the sources of a time contradict each other. A missing time and a partial overlap are unknown; what starts
    at the very moment that is all of b isn't after it.
    """
    missing = a_start.isNull() | a_end.isNull() | b_start.isNull() | b_end.isNull()
    at_moment = (a_start == b_start) & (b_end == b_start)
    return (
        F.when(F.lit(False) if conflict is None else conflict, "conflicting").when(missing, "unknown").when(a_end <= b_start, "before")
        .when((a_start >= b_end) & ~at_moment, "after").when((a_start >= b_start) & (a_end <= b_end), "during").otherwise("unknown")
    )


def add_business_days(day: Column, n: int, holidays: list[str] | None = None) -> Column:
    """The n-th weekday after the day that is no holiday: picked from a short sequence, without a calendar join."""
    span = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 7 + 7 * len(holidays or [])))
    off = F.array(*[F.to_date(F.lit(h)) for h in holidays]) if holidays else F.array().cast("array<date>")
    return F.element_at(F.filter(span, lambda d: (F.weekday(d) < 5) & ~F.array_contains(off, d)), n)


def add_months_rolled(day: Column, months: int) -> Column:
    """add_months, but a day that the month lacks rolls to the first of the next instead of clamping."""
    clamped = F.add_months(day, months)
    return F.when(F.dayofmonth(clamped) < F.dayofmonth(day), F.date_add(F.last_day(clamped), 1)).otherwise(clamped)


def to_utc(local: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(local, zone)


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """key, session, start, end, n: runs of a key's events with gaps of at most gap_seconds."""
    by = Window.partitionBy(key).orderBy(at, "event_id")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    fresh = (micros - F.lag(micros).over(by) > gap_seconds * 1_000_000).cast("int")
    numbered = events.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(by))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def period_end(kind: Column, anchor: Column, n: int, roll: Column, exclusive: Column, count_anchor: Column, holidays: list[str] | None = None) -> Column:
    """The last day in time of a period of n months, days, weeks or bdays from the anchor.

    roll: a day that the month lacks rolls to the first of the next. exclusive: the anniversary itself is too late.
    count_anchor: the anchor is the first day. A null flag doesn't hold.
    """
    less = lambda flag: F.coalesce(flag, F.lit(False)).cast("int")
    months = F.when(F.coalesce(roll, F.lit(False)), add_months_rolled(anchor, n)).otherwise(F.add_months(anchor, n))
    return (
        F.when(kind == "months", F.date_sub(months, less(exclusive))).when(kind == "days", F.date_sub(F.date_add(anchor, n), less(count_anchor)))
        .when(kind == "weeks", F.date_sub(F.date_add(anchor, 7 * n), less(count_anchor))).otherwise(add_business_days(anchor, n, holidays))
    )
