"""Reports: graded records against their distributions by domain, and cases of several questions with their latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.operators import order_stats


def aligned(labels: Column, graded: Column) -> Column:
    """A grade's probabilities in the order of the labels, normalised over these; uniform if it has none of them."""
    raw = F.transform(labels, lambda k: F.coalesce(F.try_element_at(graded, k), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(labels)))


def _first(p: Column) -> Column:
    return F.array_position(p, F.array_max(p))


def teacher_scores(records: DataFrame, grades: DataFrame) -> DataFrame:
    """domain, n, soft_brier, agreement, coverage: by domain, and overall (domain null, with coverage: the share graded).

    records: id, domain, labels, target (a probability for each label, or null). grades: id (one row each), probs (null:
    the teacher failed). Only graded records with a target count. A domain that is null is named `none`. Ties go to the
    first label.
    """
    graded = grades.where("probs IS NOT NULL").select(F.col("id").alias("__id"), "probs")
    met = records.join(graded, F.col("id") == F.col("__id"), "left")
    counts = F.col("probs").isNotNull() & F.col("target").isNotNull()
    p = aligned(F.col("labels"), F.col("probs"))
    t = F.transform("labels", lambda k: F.coalesce(F.try_element_at("target", k), F.lit(0.0)))
    brier = F.aggregate(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    rows = met.select(F.coalesce("domain", F.lit("none")).alias("domain"), F.when(counts, brier).alias("b"), F.when(counts, (_first(p) == _first(t)).cast("int")).alias("hit"))
    sums = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("all"), F.count("b").alias("n"), F.sum("b").alias("b"), F.sum("hit").alias("hit"))
    total = sums.groupingSets([["domain"], []], "domain").agg(F.sum("all").alias("all"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("hit").alias("hit"))
    score = lambda c: F.round(F.try_divide(F.col(c), F.col("n")), 6)
    shown = total.where("n > 0 OR domain IS NULL")
    return shown.select("domain", "n", score("b").alias("soft_brier"), score("hit").alias("agreement"), F.when(F.col("domain").isNull(), F.round(F.coalesce(F.try_divide("n", "all"), F.lit(0.0)), 6)).alias("coverage"))


def case_scores(answers: DataFrame, latencies: DataFrame) -> DataFrame:
    """case, questions, correct, accuracy, nll_mean, brier_mean, p50, max, per_decision: one row a case and one overall (case null).

    answers: case, oracle, selected, probs (map): a row a question. latencies: case, ms: a row a request. Means to four
    digits; the overall ones weigh the cases' by their questions. p50 is the median of a case's requests, per_decision
    that over its questions; cases without requests have none. A null case is named `none`.
    """
    p = F.greatest(F.coalesce(F.try_element_at("probs", F.col("oracle")), F.lit(0.0)), F.lit(1e-12))
    brier = F.aggregate(F.map_entries("probs"), F.lit(0.0), lambda a, e: a + F.pow(e["value"] - (e["key"] == F.col("oracle")).cast("double"), 2))
    named = F.coalesce("case", F.lit("none")).alias("case")
    by = answers.select(named, F.coalesce((F.col("selected") == F.col("oracle")).cast("int"), F.lit(0)).alias("hit"), (-F.log(p)).alias("nll"), brier.alias("brier")).groupBy("case").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("hit").alias("correct"), F.round(F.avg("nll"), 4).alias("nll_mean"), F.round(F.avg("brier"), 4).alias("brier_mean"),
    )
    times = order_stats.order_statistics(latencies.select(named, "ms"), ["case"], "ms", order_stats.median_places() | {"most": F.col("n") - 1})
    timed = join_null_safe(by, times.select("case", ((F.col("__low") + F.col("__high")) / 2).alias("p50"), "most"), ["case"], "left")
    cases = timed.select(
        "case", "questions", "correct", F.round(F.col("correct") / F.col("questions"), 6).alias("accuracy"), "nll_mean", "brier_mean", F.round("p50", 1).alias("p50"), F.round("most", 1).alias("max"), F.round(F.col("p50") / F.col("questions"), 1).alias("per_decision"),
    )
    weighed = lambda c: F.round(F.sum(F.col(c) * F.col("questions")) / F.sum("questions"), 4).alias(c)
    none = F.lit(None).cast("double")
    overall = by.agg(F.sum("questions").alias("questions"), F.sum("correct").alias("correct"), weighed("nll_mean"), weighed("brier_mean")).where("questions > 0")
    return cases.unionByName(overall.select(F.lit(None).cast("string").alias("case"), "questions", "correct", F.round(F.col("correct") / F.col("questions"), 6).alias("accuracy"), "nll_mean", "brier_mean", none.alias("p50"), none.alias("max"), none.alias("per_decision")))
