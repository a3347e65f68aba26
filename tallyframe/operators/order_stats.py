"""Exact ranks, order statistics and batches in order, without a task that holds a group or all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.plans.session import stored

#: Parts into which a pass cuts the values that a statistic may still have.
PARTS = 64


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 in the ascending order of the columns given, over all rows.

    Rows are dealt by ranges of the whole order, whose bounds Spark samples, so that equal first keys are split too;
    partitions are counted, and ranks within a partition are moved by what stands before it. The last order should
    tell all rows apart: ranks of rows that it doesn't are any of theirs.
    """
    keys = {f"__o{k}": c for k, c in enumerate(order)}
    dealt = stored(rows.withColumns(keys).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # A row a partition.
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.withColumn("__within", within).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__within")).select(*rows.columns, name)


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, n and for each name of places the value that stands there, from 0, when a group's values are sorted.

    places: expressions of n, the group's rows with a value. Nulls in value don't count; a place outside the group is
    null. A null group is a group.

    Radix selection: each pass cuts what a statistic may still be into PARTS by a mergeable sketch, counts the parts
    exactly, and goes on with the one that holds the place, until that is a single value. What is held is a row a
    group and statistic; equal values, however many, are one part.
    """
    have = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    n = F.col("n")
    whole = have.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()])
    state = stored(whole.select(*by, "n", F.inline(asked), "lo", "hi").select(*by, "n", "name", "place", "lo", "hi", F.col("place").alias("left")).where((F.col("place") >= 0) & (F.col("place") < n)))
    shares = F.array(*[F.lit((k + 1) / PARTS) for k in range(PARTS - 1)])
    done = None
    while True:
        found = state.where("lo = hi").select(*by, "name", F.col("lo").alias("v"))
        done = found if done is None else done.unionByName(found)
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        inside = join_null_safe(have, open_, by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))) if by else have.crossJoin(F.broadcast(open_)).where("v BETWEEN lo AND hi")
        cuts = stored(inside.groupBy(*by, "name", "lo", "hi", "left").agg(F.percentile_approx("v", shares, F.lit(1000)).alias("cuts"), F.count(F.lit(1)).alias("m")))
        # A sketch may give the highest value only: then the lowest is cut off, and each pass gets on.
        cut = cuts.withColumn("cuts", F.when(F.element_at("cuts", 1) >= F.col("hi"), F.array("lo")).otherwise(F.array_distinct("cuts")))
        met = join_null_safe(have, cut, by) if by else have.crossJoin(F.broadcast(cut))
        met = met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        counted = met.groupBy(*by, "name", "left", part.alias("part")).agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy(*by, "name").orderBy("part"))  # PARTS rows a statistic
        chosen = counted.withColumn("before", upto - F.col("k")).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("k")))
        state = stored(chosen.select(*by, "name", "lo", "hi", (F.col("left") - F.col("before")).alias("left")))
    wide = done.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    total = whole.select(*by, "n")
    return join_null_safe(total, wide, by, "left") if by else total.crossJoin(F.broadcast(wide))


def median_places() -> dict[str, Column]:
    """The two places whose mean is the median."""
    return {"__low": F.floor((F.col("n") - 1) / 2), "__high": F.floor(F.col("n") / 2)}


def latency(rows: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, p50 (median), p95 (the value at index int(0.95 (n - 1))), mean."""
    found = order_statistics(rows, [by], value, median_places() | {"p95": F.floor(F.lit(0.95) * (F.col("n") - 1))})
    mean = rows.groupBy(by).agg(F.avg(value).alias("mean"))
    return join_null_safe(found, mean, [by]).select(by, "n", F.round((F.col("__low") + F.col("__high")) / 2, 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("mean", 6).alias("mean"))


def auroc(rows: DataFrame, order: list[Column]) -> DataFrame:
    """positives, negatives, auroc of an order (the last tells rows apart) for correctness, by the rank-sum formula with ordinal ranks."""
    n1, n0 = F.sum("correct"), F.sum(1 - F.col("correct"))
    area = F.try_divide(F.sum(F.col("rank") * F.col("correct")) - n1 * (n1 + 1) / 2, n1 * n0)
    return ranked(rows, order).agg(n1.alias("positives"), n0.alias("negatives"), F.round(F.coalesce(area, F.lit(0.0)), 6).alias("auroc"))


def selective_accuracy(rows: DataFrame, order: list[Column], coverages: list[float]) -> DataFrame:
    """coverage, kept, accuracy of the first int(coverage * n) rows in the order given, one at least. No rows: nothing."""
    told = stored(ranked(rows, order).select("rank", F.col("correct").cast("long").alias("correct")))
    n = told.count()
    if not n:
        return told.sparkSession.createDataFrame([], "coverage double, kept long, accuracy double")
    kept = {c: max(1, int(c * n)) for c in coverages}
    sums = told.agg(*[F.sum(F.when(F.col("rank") <= k, F.col("correct"))).alias(f"s{i}") for i, k in enumerate(kept.values())])
    each = F.array(*[F.struct(F.lit(c).alias("coverage"), F.lit(k).cast("long").alias("kept"), F.round(F.col(f"s{i}") / k, 6).alias("accuracy")) for i, (c, k) in enumerate(kept.items())])
    return sums.select(F.inline(each))


def batch_plan(counts: dict[int, int], budget: int) -> dict[int, tuple[int, int, int]]:
    """For each length the batch that is open when its first row comes, the rows it still takes, and the rows of later ones.

    A batch is closed before a row with which (rows in it) * length would exceed the budget; it has one row at least.
    """
    plan, batch, size = {}, 0, 0
    for length in sorted(counts):
        most = max(1, budget // length) if length else 2**62  # rows of no length never close a batch
        room = max(0, most - size) if size else most
        plan[length] = (batch, room, most)
        over = counts[length] - room
        if over > 0:
            batch += (over + most - 1) // most
            size = over - (over - 1) // most * most
        else:
            size += counts[length]
    return plan


def token_batches(rows: DataFrame, length: str, key: str, budget: int) -> DataFrame:
    """rows with batch and place (both from 0): batches of the rows by (length, key) under a budget of padded tokens.

    A batch is closed when its rows times its longest would exceed the budget, so the batches are those of a loop over
    all rows in order. Rows of one length are alike to that loop: it runs over counts by length on the driver, of
    which there are no more than the budget (longer rows are a batch each, one class). Null lengths count as 0.
    """
    size = F.least(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(budget + 1))
    sized = ranked(rows.withColumn("__size", size), [F.coalesce(F.col(length), F.lit(0)), F.col(key)], "__rank")
    counts = {r["__size"]: r["count"] for r in sized.groupBy("__size").count().collect()}
    before, upto = {}, 0
    for s in sorted(counts):
        before[s] = upto
        upto += counts[s]
    plan = [(s, before[s], *p) for s, p in batch_plan(counts, budget).items()]
    known = rows.sparkSession.createDataFrame(plan, "__size long, __before long, __batch long, __room long, __most long")
    met = sized.join(F.broadcast(known), "__size")
    at = F.col("__rank") - 1 - F.col("__before")
    later = at - F.col("__room")
    batch = F.when(later < 0, F.col("__batch")).otherwise(F.col("__batch") + 1 + F.floor(later / F.col("__most")))
    placed = stored(met.withColumn("batch", batch.cast("long")).select(*rows.columns, "__rank", "batch"))
    first = placed.groupBy("batch").agg(F.min("__rank").alias("__first"))
    return placed.join(first, "batch").withColumn("place", F.col("__rank") - F.col("__first")).select(*rows.columns, "batch", "place")
