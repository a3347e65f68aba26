"""Sampling in order under two caps that act on each other, with what they turn away as a reserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.operators.assembly import first_in_order
from tallyframe.plans.session import stored


def balanced_sample(rows: DataFrame, split: str, label: str, easy: Column, fact: Column, order: Column, key: str, wanted: DataFrame, labels: int, slack: float = 1.6, easy_share: float = 0.4, oversample: int | None = None) -> DataFrame:
    """split, key, why (kept or filled): what a pass over each split's rows in order takes until it has enough.

    Rows come by (order, key); of rows with the same fact in a split the first counts. A row is kept unless its label
    has its cap, ceil(n / labels * slack), or it is easy and ceil(n * easy_share) easy rows are kept (n, if n is below
    20). The pass ends with n kept rows; if it ends before, the first of those turned away fill up. wanted: split, n.
    Only the first oversample * n rows of a split are looked at, if given. A null easy isn't easy; null splits and labels
    are groups of their own; splits that aren't wanted give nothing.

    The two caps act on each other only through one moment: up to the last easy row that is kept, the caps of labels
    alone decide; after it the same caps, less what is taken, decide about the rows that aren't easy. So a pass is four
    choices of the first rows of a group, and no group is held by a task.
    """
    n = F.col("n")
    asked = stored(
        wanted.select(
            split, n, F.ceil(n / F.lit(labels) * F.lit(slack) - 1e-9).alias("cap"), F.when(n < 20, n).otherwise(F.ceil(n * F.lit(easy_share) - 1e-9)).alias("easy_cap"), (n * (oversample or 1)).alias("looked_at"),
        )
    )
    thin = rows.select(split, label, F.coalesce(easy, F.lit(False)).alias("easy"), fact.alias("fact"), order.alias("at"), key)
    if oversample:
        thin = first_in_order(thin, [split], F.col("at"), key, asked, "looked_at")
    unique = thin.groupBy(split, "fact").agg(F.min(F.struct("at", key, label, "easy")).alias("r")).select(split, "r.*")
    unique = stored(join_null_safe(unique, asked.select(split), [split], "left_semi"))

    cells = stored(join_null_safe(unique.select(split, label).distinct(), asked, [split]))
    under = stored(first_in_order(unique, [split, label], F.col("at"), key, cells, "cap"))
    easy_kept = first_in_order(under.where("easy"), [split], F.col("at"), key, asked, "easy_cap")
    moment = easy_kept.groupBy(split).agg(F.count(F.lit(1)).alias("taken"), F.max(F.struct("at", key)).alias("moment"))
    moment = join_null_safe(asked, moment, [split], "left").select(split, F.when(F.coalesce("taken", F.lit(0)) >= F.col("easy_cap"), F.col("moment")).alias("moment"), (F.col("easy_cap") <= 0).alias("none"))
    moment = stored(moment)
    place = F.struct("at", key)
    # Without a moment the easy cap never acts; with a cap of nothing it acts from the start.
    until = F.when(F.col("none"), F.lit(False)).otherwise(F.coalesce(place <= F.col("moment"), F.lit(True)))
    first = stored(join_null_safe(under, moment, [split]).where(until).select(*under.columns))
    after = join_null_safe(unique.where("NOT easy"), moment, [split]).where(~until).select(*unique.columns)
    taken = first.groupBy(split, label).agg(F.count(F.lit(1)).alias("taken"))
    rest = join_null_safe(cells, taken, [split, label], "left").select(split, label, (F.col("cap") - F.coalesce("taken", F.lit(0))).alias("left"))
    second = first_in_order(after, [split, label], F.col("at"), key, rest, "left")
    kept = stored(first_in_order(first.unionByName(second), [split], F.col("at"), key, asked, "n"))

    have = kept.groupBy(split).agg(F.count(F.lit(1)).alias("have"))
    short = join_null_safe(asked, have, [split], "left").select(split, (n - F.coalesce("have", F.lit(0))).alias("short")).where("short > 0")
    turned = join_null_safe(join_null_safe(unique, short, [split], "left_semi"), kept.select(split, key), [split, key], "left_anti")
    filled = first_in_order(turned, [split], F.col("at"), key, short, "short")
    return kept.select(split, key, F.lit("kept").alias("why")).unionByName(filled.select(split, key, F.lit("filled").alias("why")))
