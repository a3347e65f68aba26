"""Exact probabilities, posteriors and rule closure."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.plans.session import stored


def binomial_table(n: int) -> Column:
    """Pascal's triangle up to n as one literal: C(a, b) is element a (n + 1) + b. Exact for n up to 60."""
    return F.array(*[F.lit(comb(a, b)).cast("long") for a in range(n + 1) for b in range(n + 1)])


def hypergeometric_tail(lot: Column, bad: Column, drawn: Column, least: Column, biggest: int) -> Column:
    """Probability of `least` bad ones or more among `drawn` from a lot without replacement; integers until one division."""
    table = binomial_table(biggest)
    c = lambda a, b: F.element_at(table, (a * (biggest + 1) + b + 1).cast("int"))
    hi = F.least(bad, drawn)
    ways = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(biggest).cast("long")), F.lit(0).cast("decimal(38,0)"), lambda s, j: F.when(
        (j >= least) & (j <= hi) & (drawn - j <= lot - bad), (s + c(bad, j).cast("decimal(18,0)") * c(lot - bad, F.greatest(drawn - j, F.lit(0))).cast("decimal(18,0)")).cast("decimal(38,0)")).otherwise(s))
    return ways.cast("double") / c(lot, drawn)


def weighted_choice(scores: dict[str, Column], weights: dict[str, float], lower_is_better: set[str]) -> Column:
    """Weighted total of scores of 1 to 10; where less is better a score s counts as 11 - s."""
    total = F.lit(0.0)
    for name, s in scores.items():
        total = total + F.lit(weights[name]) * ((F.lit(11) - s) if name in lower_is_better else s)
    return total


def uniform_within(options: DataFrame, group: str, total: str, delta: float) -> DataFrame:
    """options with p: uniform over those of the group within delta of its best total. Bests are joined, not windowed."""
    best = options.groupBy(group).agg(F.max(total).alias("__best"))
    near = F.col("__best") - F.col(total) <= delta + 1e-9
    marked = join_null_safe(options, best, [group]).withColumn("__near", near.cast("int"))
    n = marked.groupBy(group).agg(F.sum("__near").alias("__n"))
    return join_null_safe(marked, n, [group]).withColumn("p", F.round(F.col("__near") / F.col("__n"), 6)).drop("__best", "__near", "__n")


def routing_weights(issues: DataFrame, case: str, queue: str, weight: Column) -> DataFrame:
    """case, queue, p: the weights of a case's issues by queue, normalised."""
    by = issues.groupBy(case, queue).agg(F.sum(weight).cast("double").alias("w"))
    total = by.groupBy(case).agg(F.sum("w").alias("t"))
    return join_null_safe(by, total, [case]).select(case, queue, F.round(F.col("w") / F.col("t"), 6).alias("p"))


def naive_bayes(rows: DataFrame, key: str, label: str, features: list[str], smoothing: float = 1.0) -> DataFrame:
    """key, label, p: posterior of every label given the features, with likelihoods counted from the rows themselves.

    Likelihoods are a long table of (feature, value, label). Rows that agree in all features share one posterior, so
    the table meets distinct feature combinations only.
    """
    long = rows.select(label, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])))
    labels = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    cells = long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))
    values = cells.groupBy("feature").agg(F.count_distinct("value").alias("v"))
    names = labels.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n_label")).alias("labels"), F.sum("n_label").alias("total")).withColumn("__k", F.lit(1))
    combos = rows.select(*features).distinct().withColumn("combo", F.xxhash64(*features)).withColumn("__k", F.lit(1))
    asked = combos.join(names, "__k").select("combo", "total", *features, F.explode("labels").alias("x")).select("combo", "total", F.col("x.l").alias(label), "x.n_label", *features)
    asked = asked.select("combo", "total", label, "n_label", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])))
    met = asked.join(cells, ["feature", "value", label], "left").join(values, "feature")
    like = F.log((F.coalesce("n", F.lit(0)) + smoothing) / (F.col("n_label") + smoothing * F.col("v")))
    logs = met.groupBy("combo", label, "n_label", "total").agg(F.sum(like).alias("s")).withColumn("s", F.col("s") + F.log(F.col("n_label") / F.col("total")))
    by = Window.partitionBy("combo")
    e = logs.withColumn("e", F.exp(F.col("s") - F.max("s").over(by)))
    posterior = e.select("combo", label, F.round(F.col("e") / F.sum("e").over(by), 6).alias("p"))
    return rows.select(key, F.xxhash64(*features).alias("combo")).join(posterior, "combo").select(key, F.col(label).alias("label"), "p")


def abstain_shift(p: Column, least: float = 0.5) -> Column:
    """p with an abstain mass at the end: half of all where the largest is below `least`."""
    low = F.array_max(p) < least
    return F.concat(F.transform(p, lambda x: F.when(low, x / 2).otherwise(x)), F.array(F.when(low, 0.5).otherwise(0.0)))


def closure(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """node, fact, authority: forward chaining to the fixed point; a fact's authority is the best over its derivations
    of the weakest part of each (max-min).

    facts: entity, pred, authority. rules: body (a predicate), head, authority. Each round joins what changed with the
    rules and is written. Rules that bind several parts or have exceptions are for forward_chain.
    """
    known = stored(facts.groupBy("entity", "pred").agg(F.max("authority").alias("authority")))
    fresh = known
    while fresh.limit(1).count():
        made = fresh.join(rules.withColumnRenamed("authority", "rule_authority"), F.col("pred") == F.col("body"))
        made = made.select("entity", F.col("head").alias("pred"), F.least("authority", "rule_authority").alias("authority"))
        made = made.groupBy("entity", "pred").agg(F.max("authority").alias("authority"))
        better = made.join(known.withColumnRenamed("authority", "old"), ["entity", "pred"], "left").where(F.col("old").isNull() | (F.col("old") < F.col("authority"))).drop("old")
        fresh = stored(better)
        known = stored(known.unionByName(fresh).groupBy("entity", "pred").agg(F.max("authority").alias("authority")))
    return known


#: A literal is a predicate and whether it is asserted or denied.
Literal = tuple[str, bool]


def literal(x: Literal) -> Column:
    return F.struct(F.lit(x[0]).alias("pred"), F.lit(x[1]).alias("pos"))


def forward_chain(facts: DataFrame, rules: list[dict], known: str = "known") -> DataFrame:
    """entity, known: for every entity the authority of each literal that follows, as a map of struct(pred, pos).

    facts: entity, pred, pos, authority. rules: body (literals that must all be known), head, unless (predicates that
    must not be), quant; rules whose quant isn't all, no or None license nothing about one entity. A conclusion has the
    least authority of its body; of several derivations the greatest counts. Rules without exceptions are saturated
    first, then all rules in their order.

    Literals of one entity never meet another's: one group-by, then the fixed point inside the row. An optimal derivation
    passes each head once, so as many passes as there are heads (and one) reach it, cycles included.
    """
    live = [r for r in rules if r.get("quant") in ("all", "no", None)]
    names = sorted({x for r in live for x in [*r["body"], r["head"], *((u, True) for u in r.get("unless", []))]})
    at = {x: i for i, x in enumerate(names)}
    own = F.struct(F.col("pred"), F.coalesce("pos", F.lit(True)).alias("pos"))
    best = facts.groupBy("entity", own.alias("literal")).agg(F.max(F.coalesce("authority", F.lit(1)).cast("int")).alias("authority"))
    rows = best.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("literal", "authority"))).alias("given"))
    if not live:
        return rows.withColumnRenamed("given", known)
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    coded = lambda rs: [F.struct(ints([at[b] for b in r["body"]]).alias("body"), F.lit(at[r["head"]]).alias("head"), ints([at[(u, True)] for u in r.get("unless", [])]).alias("unless")) for r in rs]
    passes = len({r["head"] for r in live}) + 1
    strict = [r for r in live if not r.get("unless")]
    order = F.concat(*[F.flatten(F.array_repeat(F.array(*coded(rs)), passes)) for rs in (strict, live) if rs])

    def fire(state: Column, r: Column) -> Column:
        parts = F.transform(r["body"], lambda b: F.element_at(state, b + 1))
        allowed = ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(r["unless"], lambda u: F.element_at(state, u + 1).isNotNull())
        return F.when(allowed, F.transform(state, lambda x, i: F.when(i == r["head"], F.greatest(x, F.array_min(parts))).otherwise(x))).otherwise(state)

    named = F.array(*[literal(x) for x in names])
    start = F.array(*[F.try_element_at("given", literal(x)) for x in names])
    derived = F.map_filter(F.map_from_arrays(named, F.aggregate(order, start, fire)), lambda _, v: v.isNotNull())
    other = F.map_filter("given", lambda k, _: ~F.array_contains(named, k))
    return rows.select("entity", F.map_concat(other, derived).alias(known))


def verdict(known: Column, pred: str, pos: bool = True) -> Column:
    """entailed, contradicted or unknown for a claim: of claim and denial the one of more authority counts, equal ones cancel."""
    yes, no = (F.coalesce(F.try_element_at(known, literal((pred, side))), F.lit(-1)) for side in (pos, not pos))
    return F.when(yes > no, "entailed").when(no > yes, "contradicted").otherwise("unknown")
