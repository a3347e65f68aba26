"""Thresholds and temperatures fitted in one pass over a small grid, and reports over several key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import probability as P


def exit_threshold(early: DataFrame, final: DataFrame, steps: int = 101) -> DataFrame:
    """threshold, accuracy, exits: the loosest threshold in 1.0 .. 0.5 up to which no step loses accuracy against never
    leaving early (all rounded to four digits); 1.0 if the first step loses.

    Rows are counted by the first step that lets them leave, so the grid's running sums are over `steps` rows.
    """
    both = early.select("id", "gold", F.col("pred").alias("p1"), F.col("conf").alias("c1")).join(final.select("id", F.col("pred").alias("p2")), "id")
    grid = F.array(*[F.lit(1.0 - i * 0.5 / (steps - 1)) for i in range(steps)])
    first, second = (F.col("p1") == F.col("gold")).cast("long"), (F.col("p2") == F.col("gold")).cast("long")
    by = both.groupBy(F.size(F.filter(grid, lambda t: t > F.col("c1"))).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(first - second).alias("gain"), F.sum(second).alias("late"))
    all_steps = F.broadcast(both.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step")))
    every, upto = Window.partitionBy(), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = all_steps.join(by, "step", "left").withColumns({"total": F.sum("n").over(every), "base": F.sum("late").over(every), "exits": F.coalesce(F.sum("n").over(upto), F.lit(0)), "won": F.coalesce(F.sum("gain").over(upto), F.lit(0))})
    accuracy, full = F.round((F.col("base") + F.col("won")) / F.col("total"), 4), F.round(F.col("base") / F.col("total"), 4)
    held = run.where(F.col("step") < steps).withColumn("accuracy", accuracy).withColumn("ok", F.bool_and(accuracy >= full).over(upto)).where((F.col("step") == 0) | F.col("ok"))
    best = held.agg(F.max_by(F.struct("step", "accuracy", "exits", "total"), "step").alias("b")).select("b.*")
    return best.select(F.round(F.element_at(grid, F.col("step") + 1), 6).alias("threshold"), "accuracy", F.round(F.col("exits") / F.col("total"), 4).alias("exits"))


def cascade_thresholds(small: DataFrame, big: DataFrame, calibration: Column, firsts: list[float], seconds: list[float], least: float = 0.9) -> DataFrame:
    """t1, t2, auto, accuracy: for each t1 the t2 of the highest share of automatic answers (three digits) whose accuracy on
    calibration rows is at least `least` (else the last of 0.9), reported on the other rows. Ties go to the smaller t2.

    The grid stands in the aggregation's columns: rows aren't multiplied.
    """
    both = small.withColumn("cal", calibration).select("id", "gold", "cal", F.col("pred").alias("p1"), F.col("conf").alias("c1")).join(big.select("id", F.col("pred").alias("p2"), F.col("conf").alias("c2")), "id")
    cells = []
    for a in firsts:
        for b in seconds:
            answer = F.when(F.col("c1") >= a, F.col("p1")).when(F.col("c2") >= b, F.col("p2"))
            cells.append(F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.count(answer).alias("auto"), F.count_if(answer == F.col("gold")).alias("right"), F.count(F.lit(1)).alias("n")))
    table = both.groupBy("cal").agg(F.array(*cells).alias("x")).select("cal", F.inline("x"))
    fit = table.where("cal AND auto > 0").where(F.round(F.col("right") / F.col("auto"), 3) >= least)
    best = fit.groupBy("t1").agg(F.max_by("t2", F.struct(F.round(F.col("auto") / F.col("n"), 3).alias("a"), (-F.col("t2")).alias("b"))).alias("best"))
    chosen = table.where("NOT cal").join(F.broadcast(best), "t1", "left").where(F.col("t2") == F.coalesce("best", F.lit(0.9)))  # a row for each t1
    return chosen.select("t1", "t2", F.round(F.col("auto") / F.col("n"), 3).alias("auto"), F.round(F.col("right") / F.col("auto"), 3).alias("accuracy"))


def brier_temperature(rows: DataFrame, grid: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)) -> DataFrame:
    """temperature, brier: the grid's temperature of the least mean Brier score; the first on ties."""
    cells = [F.struct(F.avg(P.brier(P.softmax(F.col("z"), t), P.one_hot(F.col("gold"), 5))).alias("brier"), F.lit(i).alias("i"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)]
    return rows.agg(F.array_min(F.array(*cells)).alias("b")).select("b.temperature", F.round("b.brier", 6).alias("brier"))


def benchmark_report(rows: DataFrame, keys: list[str], injected: Column) -> DataFrame:
    """part, n, accuracy, brier, nll, ece, n_injected for each combination of the keys (joined by /) and `overall`.

    Rows are summed by combination and calibration bin once; the overall row is made of these sums.
    """
    hit = F.col("correct")
    cells = rows.withColumn("bin", P.bin_right_closed(F.col("conf"))).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"s_{c}") for c in ("brier", "nll", "conf")], F.sum(hit).alias("s_correct"), F.count_if(injected).alias("inj")
    )
    part = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    bins = cells.withColumn("part", F.explode(F.array(part, F.lit("overall")))).groupBy("part", "bin").agg(*[F.sum(c).alias(c) for c in ("k", "s_brier", "s_nll", "s_conf", "s_correct", "inj")])
    n = F.sum("k")
    return bins.groupBy("part").agg(
        n.alias("n"), F.round(F.sum("s_correct") / n, 6).alias("accuracy"), F.round(F.sum("s_brier") / n, 6).alias("brier"), F.round(F.sum("s_nll") / n, 6).alias("nll"),
        F.round(F.sum(F.abs(F.col("s_conf") - F.col("s_correct"))) / n, 6).alias("ece"), F.sum("inj").alias("n_injected"),
    )


def flip_rate(rows: DataFrame, by: str, injected: Column, posterior: str) -> DataFrame:
    """by, n, flips: among injected rows with a posterior, the share whose choice isn't the posterior's."""
    asked = rows.where(injected & F.col(posterior).isNotNull())
    return asked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((P.argmax(F.col("p")) != P.argmax(F.col(posterior))).cast("int")), 6).alias("flips"))


def pack_summary(rows: DataFrame, pack: str, accepted: Column, label: Column, tags: Column, chars: Column) -> DataFrame:
    """pack, candidates, accepted, acceptance_rate (4 digits), avg_chars (1 digit), labels, tags: of accepted rows the
    labels and tags as `name:count`, in alphabetical order. Names are counted before they are gathered."""
    ok = F.coalesce(accepted, F.lit(False))
    base = rows.groupBy(pack).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(ok).alias("accepted"), F.coalesce(F.round(F.sum(F.when(ok, chars)) / F.count_if(ok), 1), F.lit(0.0)).alias("avg_chars"))
    out = base.withColumn("acceptance_rate", F.round(F.col("accepted") / F.col("candidates"), 4))
    for name, values in (("labels", F.array(label)), ("tags", tags)):
        counts = rows.where(ok).select(F.col(pack).alias("__pack"), F.explode(values).alias("v")).groupBy("__pack", "v").agg(F.count(F.lit(1)).alias("n"))
        text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "v", F.col("n").cast("string")))), ",").alias(name)
        out = out.join(counts.groupBy("__pack").agg(text), F.col(pack).eqNullSafe(F.col("__pack")), "left").drop("__pack").withColumn(name, F.coalesce(name, F.lit("")))
    return out
