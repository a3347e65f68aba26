"""Predictions read from every layer of a model: accuracy by depth, ensembles of the last layers, late disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import probability as P

#: How many last layers are averaged, how many of them are asked whether they agree, buckets of disagreement.
LASTS, LATE, BUCKETS = (1, 2, 3, 4, 6, 8), 8, ((0, 0), (1, 1), (2, 3), (4, 99))


def _best(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def _point(kind: str, k: Column, p: Column, gold: Column, extra: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), k.cast("int").alias("k"), F.array_max(p).alias("conf"), F.coalesce((_best(p) == gold).cast("int"), F.lit(0)).alias("correct"), extra.cast("double").alias("extra"),
    )


def layer_probe(rows: DataFrame, layers: str, gold: str) -> DataFrame:
    """kind, k, n, accuracy, mean_conf, ece, extra: three tables of one pass over the rows.

    layers: an array of distributions, from the embedding to the last layer. kind `layer`: k is the layer, extra the share
    of rows whose choice is the last layer's. kind `last`: the mean of the last k layers (all, if there are fewer);
    no extra. kind `flips`: rows by how many other choices than one the last LATE layers make, k the lower end of
    the bucket; the scores are the last layer's, extra the mean distance (total variation) of the others of these to it.

    Ties go to the first option. Rows without a layer count nowhere; a null gold is never right. Rows fan out to a point a
    layer inside the row and are added up by bin before any shuffle.
    """
    at, n, truth = F.col(layers), F.size(layers), F.col(gold)
    final = F.element_at(at, -1)
    own = F.transform(at, lambda p, i: _point("layer", i, p, truth, (_best(p) == _best(final)).cast("int")))

    def mean(tail: Column) -> Column:
        return F.transform(final, lambda _, j: F.aggregate(tail, F.lit(0.0), lambda a, p: a + F.get(p, j)) / F.size(tail))

    last = [_point("last", F.lit(k), mean(F.slice(at, F.greatest(n - k + 1, F.lit(1)), F.lit(k))), truth, F.lit(None)) for k in LASTS]
    late = F.slice(at, F.greatest(n - LATE + 1, F.lit(1)), F.lit(LATE))
    flips = F.size(F.array_distinct(F.transform(late, _best))) - 1
    low = F.coalesce(*[F.when(flips.between(lo, hi), lo) for lo, hi in BUCKETS], F.lit(BUCKETS[-1][0]))
    apart = F.aggregate(F.slice(late, F.lit(1), F.greatest(F.size(late) - 1, F.lit(0))), F.lit(0.0), lambda a, p: a + P.tvd(p, final)) / F.greatest(F.size(late) - 1, F.lit(1))
    points = F.concat(own, F.array(*last, _point("flips", low, final, truth, apart)))
    long = rows.where(n > 0).select(F.explode(points).alias("x")).select("x.*")
    bins = long.groupBy("kind", "k", P.bin_floor(F.col("conf")).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.sum("conf").alias("c"), F.sum("correct").alias("r"), F.sum("extra").alias("e"))
    total = F.sum("m")
    return bins.groupBy("kind", "k").agg(
        total.alias("n"), F.round(F.sum("r") / total, 6).alias("accuracy"), F.round(F.sum("c") / total, 6).alias("mean_conf"), F.round(F.sum(F.abs(F.col("c") - F.col("r"))) / total, 6).alias("ece"), F.round(F.sum("e") / total, 6).alias("extra"),
    )


def saturation(probe: DataFrame, close: float = 0.005) -> DataFrame:
    """layer, final_accuracy, prunable: the first layer as accurate as the last but for `close`, and the layers after it."""
    by = probe.where("kind = 'layer'")
    last = by.agg(F.max_by("accuracy", "k").alias("final_accuracy"), F.max("k").alias("last"))
    first = by.crossJoin(F.broadcast(last)).where(F.col("accuracy") >= F.col("final_accuracy") - close - 1e-12)  # a row a layer meets one row
    return first.groupBy("final_accuracy", "last").agg(F.min("k").alias("layer")).select("layer", "final_accuracy", (F.col("last") - F.col("layer")).alias("prunable"))
