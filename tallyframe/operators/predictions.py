"""Scores of predicted distributions. A prediction row has id, slice, gold (index from 0), z (logits) and p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.functions.joins import join_null_safe


def from_events(events: DataFrame, perm: int = 0) -> DataFrame:
    """Predictions derived from events by integer arithmetic: five logits a row, gold the event type's rank by name."""
    types = events.select("event_type").distinct()
    named = types.agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    # One row of five names: small by construction, joined by a constant key.
    with_names = events.withColumn("__k", F.lit(1)).join(named.withColumn("__k", F.lit(1)), "__k").drop("__k")
    z = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: ((F.col("event_id") * (31 + perm) + j * 17 + F.length("event_type") * 7) % 97) / F.lit(20.0))
    rows = with_names.select(
        F.col("event_id").alias("id"), F.pmod("user_id", F.lit(4)).cast("int").alias("slice"), "event_type", "value",
        (F.array_position("names", F.col("event_type")) - 1).cast("int").alias("gold"), z.alias("z"),
    )
    return scored(rows.withColumn("p", P.softmax(F.col("z"))))


def scored(rows: DataFrame) -> DataFrame:
    """rows with pred, conf, correct, p_gold, brier, nll."""
    target = P.one_hot(F.col("gold"), 5)
    p_gold = F.element_at("p", F.col("gold") + 1)
    return rows.withColumns({
        "pred": P.argmax(F.col("z")), "conf": F.array_max("p"), "p_gold": p_gold, "correct": (P.argmax(F.col("z")) == F.col("gold")).cast("int"),
        "brier": P.brier(F.col("p"), target), "nll": P.nll(p_gold),
    })


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, macro_accuracy (over gold classes), brier, nll, confidence of each group."""
    per_class = rows.groupBy(*by, "gold").agg(F.avg("correct").alias("a"), F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in ("correct", "brier", "nll", "conf")])
    n = F.sum("k")
    return per_class.groupBy(*by).agg(
        n.alias("n"), _r(F.sum("correct") / n).alias("accuracy"), _r(F.avg("a")).alias("macro_accuracy"),
        _r(F.sum("brier") / n).alias("brier"), _r(F.sum("nll") / n).alias("nll"), _r(F.sum("conf") / n).alias("confidence"),
    )


def reliability(rows: DataFrame, binned: Column, value: Column, hit: Column) -> DataFrame:
    """bin, n, mean_value, hit_rate of each bin that has rows."""
    return rows.groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(value)).alias("mean_value"), _r(F.avg(hit)).alias("hit_rate"))


def calibration_error(rows: DataFrame, binned: Column, value: Column, hit: Column, *by: str) -> DataFrame:
    """ece of each group: the bins' gaps weighed by their rows."""
    bins = rows.groupBy(*by, binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(value) - F.avg(hit)).alias("gap"))
    return bins.groupBy(*by).agg(_r(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def per_option(rows: DataFrame) -> DataFrame:
    """option, support, precision, recall, f1; 0 where undefined; options seen as gold or prediction."""
    roles = rows.select(F.inline(F.array(
        F.struct(F.col("gold").alias("option"), F.col("correct").alias("tp"), F.lit(0).alias("fp"), (1 - F.col("correct")).alias("fn"), F.lit(1).alias("s")),
        F.struct(F.col("pred").alias("option"), F.lit(0).alias("tp"), (1 - F.col("correct")).alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("s")),
    )))
    t = roles.groupBy("option").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "s")])
    over = lambda a, b: _r(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return t.select(
        "option", F.col("s").alias("support"), over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), over(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def macro_f1(rows: DataFrame) -> DataFrame:
    return per_option(rows).agg(_r(F.avg("f1")).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def by_threshold(rows: DataFrame, value: Column, grid: list[float], sums: dict[str, Column]) -> DataFrame:
    """threshold, and for each sum `name_from` (over rows with that value or more) and `name_below`, for an ascending grid.

    Rows are added up by the step of the grid that they reach, not multiplied by the grid: what meets the thresholds
    is a row a step. A null value is below every threshold. No rows give no thresholds.
    """
    points = F.array(*[F.lit(float(t)) for t in grid])
    step = F.size(F.filter(points, lambda t: F.coalesce(value >= t, F.lit(False))))
    steps = rows.groupBy(step.alias("step")).agg(*[F.sum(c).cast("double").alias(k) for k, c in sums.items()])
    held = steps.agg(F.collect_list(F.struct("step", *sums)).alias("steps")).where(F.size("steps") > 0)
    at = held.select("steps", F.posexplode(points).alias("at", "threshold"))

    def total(name: str, reached: bool) -> Column:
        these = F.filter("steps", lambda s: (s["step"] > F.col("at")) if reached else (s["step"] <= F.col("at")))
        return F.aggregate(these, F.lit(0.0), lambda a, s: a + s[name])

    return at.select("threshold", *[c for k in sums for c in (total(k, True).alias(f"{k}_from"), total(k, False).alias(f"{k}_below"))])


def selective_risk(rows: DataFrame, n: int = 20) -> DataFrame:
    """threshold, coverage, risk: the error among rows with at least that confidence; 0 if none."""
    t = by_threshold(rows, F.col("conf"), [i / n for i in range(n)], {"n": F.lit(1), "wrong": 1 - F.col("correct")})
    every = F.col("n_from") + F.col("n_below")
    return t.select("threshold", _r(F.col("n_from") / every).alias("coverage"), _r(F.coalesce(F.try_divide("wrong_from", "n_from"), F.lit(0.0))).alias("risk"))


def cost_quality(rows: DataFrame, costs: list[int], fallback: int, n: int = 11) -> DataFrame:
    """threshold, cost, quality: below the threshold the action becomes `fallback`. costs: of each option."""
    cost = F.element_at(F.array(*[F.lit(c) for c in costs]), F.col("pred") + 1)
    sums = {"n": F.lit(1), "cost": cost, "hit": (F.col("pred") == F.col("gold")).cast("int"), "back": (F.lit(fallback) == F.col("gold")).cast("int")}
    t = by_threshold(rows, F.col("conf"), [i / (n - 1) for i in range(n)], sums)
    every = F.col("n_from") + F.col("n_below")
    return t.select("threshold", _r((F.col("cost_from") + costs[fallback] * F.col("n_below")) / every).alias("cost"), _r((F.col("hit_from") + F.col("back_below")) / every).alias("quality"))


def abstain_threshold(rows: DataFrame, target: float, least: int = 20) -> DataFrame:
    """threshold, kept, accuracy: the smallest confidence (to four digits) from which up at least `least` rows are kept at the target accuracy.

    Rows are first combined by confidence: the running sums are over distinct confidences.
    """
    by = rows.groupBy(F.round("conf", 4).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select("threshold", F.sum("n").over(w).alias("kept"), (F.sum("c").over(w) / F.sum("n").over(w)).alias("a"))
    good = run.where((F.col("kept") >= least) & (F.col("a") >= target))
    return good.agg(F.min("threshold").alias("threshold"), F.max("kept").alias("kept"), _r(F.min_by("a", "threshold")).alias("accuracy"))


def order_sensitivity(perms: DataFrame) -> DataFrame:
    """n, sensitive (share of ids whose selection differs between permutations), all_correct, any_correct. perms: id, perm, pred, correct."""
    by = perms.groupBy("id").agg((F.min("pred") != F.max("pred")).alias("differs"), F.min("correct").alias("every"), F.max("correct").alias("some"))
    return by.agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.col("differs").cast("int"))).alias("sensitive"), _r(F.avg("every")).alias("all_correct"), _r(F.avg("some")).alias("any_correct"))


def slot_share(rows: DataFrame) -> DataFrame:
    total = F.sum("k").over(Window.partitionBy())
    return rows.groupBy(F.col("pred").alias("slot")).agg(F.count(F.lit(1)).alias("k")).select("slot", "k", _r(F.col("k") / total).alias("share"))


def disagreement(perms: DataFrame) -> DataFrame:
    """n, mean_tvd, flips: mean total variation between an id's permutations, and how many ids' first choice moves.

    An id has few permutations: they are gathered and paired inside the row.
    """
    by = perms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("perm", "p", "pred"))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["perm"] > x["perm"]), lambda y: P.tvd(x["p"], y["p"]))))
    flip = F.exists("a", lambda x: x["pred"] != F.element_at("a", 1)["pred"])
    row = by.select((P.total(pairs) / F.size(pairs)).alias("tvd"), flip.cast("int").alias("flip"))
    return row.agg(F.count(F.lit(1)).alias("n"), _r(F.avg("tvd")).alias("mean_tvd"), F.sum("flip").alias("flips"))


def averaged(perms: DataFrame) -> DataFrame:
    """accuracy, brier, nll of the distributions averaged over an id's permutations."""
    long = perms.select("id", "gold", F.posexplode("p").alias("j", "p")).groupBy("id", "gold", "j").agg(F.avg("p").alias("p"))
    by = long.groupBy("id", "gold").agg(
        F.max_by("j", F.struct(F.round("p", 12), -F.col("j"))).alias("pred"), F.sum((F.col("p") - (F.col("j") == F.col("gold")).cast("int")) ** 2).alias("brier"),
        F.max(F.when(F.col("j") == F.col("gold"), F.col("p"))).alias("pg"),
    )
    return by.agg(F.count(F.lit(1)).alias("n"), _r(F.avg((F.col("pred") == F.col("gold")).cast("int"))).alias("accuracy"), _r(F.avg("brier")).alias("brier"), _r(F.avg(P.nll(F.col("pg")))).alias("nll"))


def confident_wrong(rows: DataFrame, family: str) -> DataFrame:
    """Per family and over all ('ALL'): n, acc, conf, brier, wrong80, wrong90, share of the wrong that is confident."""
    wrong = 1 - F.col("correct")
    at = lambda t: F.sum(F.when(F.col("conf") >= t, wrong).otherwise(0))
    parts = rows.withColumn("family", F.explode(F.array(F.col(family).cast("string"), F.lit("ALL"))))
    return parts.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("correct")).alias("acc"), _r(F.avg("conf")).alias("conf"), _r(F.avg("brier")).alias("brier"), at(0.8).alias("wrong80"), at(0.9).alias("wrong90"),
        _r(F.coalesce(F.try_divide(at(0.8), F.sum(wrong)), F.lit(0.0))).alias("confident_share"),
    )


def fidelity(a: DataFrame, b: DataFrame, family: str) -> DataFrame:
    """Of two distributions of the same ids by family: n, tvd, soft_brier, agreement."""
    both = a.select("id", family, F.col("p").alias("p"), "pred").join(b.select("id", F.col("p").alias("q"), F.col("pred").alias("pred_b")), "id")
    return both.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg(P.tvd(F.col("p"), F.col("q")))).alias("tvd"), _r(F.avg(P.brier(F.col("p"), F.col("q")))).alias("soft_brier"),
        _r(F.avg((F.col("pred") == F.col("pred_b")).cast("int"))).alias("agreement"),
    )


def ensemble(models: list[DataFrame]) -> DataFrame:
    """n, accuracy, brier of the mean of several models' distributions."""
    perms = models[0].select("id", "gold", "p")
    for m in models[1:]:
        perms = perms.unionByName(m.select("id", "gold", "p"))
    return averaged(perms).select("n", "accuracy", "brier")


def cascade(small: DataFrame, big: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """t1, t2, auto, accuracy, small_share: the small model answers from t1 up, else the big one from t2 up, else review."""
    both = small.select("id", "gold", F.col("pred").alias("p1"), F.col("conf").alias("c1")).join(big.select("id", F.col("pred").alias("p2"), F.col("conf").alias("c2")), "id")
    cells = both.withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a, b in grid]))).select("gold", "p1", "c1", "p2", "c2", "t.*")
    first, second = F.col("c1") >= F.col("t1"), F.col("c2") >= F.col("t2")
    answer = F.when(first, F.col("p1")).when(second, F.col("p2"))
    return cells.groupBy("t1", "t2").agg(
        _r(F.avg(answer.isNotNull().cast("int"))).alias("auto"), _r(F.coalesce(F.avg((answer == F.col("gold")).cast("int")), F.lit(0.0))).alias("accuracy"), _r(F.avg(first.cast("int"))).alias("small_share")
    )


def depth_cascade(early: DataFrame, final: DataFrame, n: int = 101, early_cost: float = 0.75) -> DataFrame:
    """threshold, accuracy, exits, compute: rows confident enough leave at the early layer."""
    both = early.select("id", "gold", F.col("pred").alias("p1"), F.col("conf").alias("c1")).join(final.select("id", F.col("pred").alias("p2")), "id")
    sums = {"n": F.lit(1), "early": (F.col("p1") == F.col("gold")).cast("int"), "late": (F.col("p2") == F.col("gold")).cast("int")}
    t = by_threshold(both, F.col("c1"), [i / (n - 1) for i in range(n)], sums)
    every = F.col("n_from") + F.col("n_below")
    return t.select(
        "threshold", _r((F.col("early_from") + F.col("late_below")) / every).alias("accuracy"), _r(F.col("n_from") / every).alias("exits"), _r((early_cost * F.col("n_from") + F.col("n_below")) / every).alias("compute"),
    )


def advantage_weights(rows: DataFrame, family: str, temperature: float = 0.2, clip: float = 5.0) -> DataFrame:
    """id, weight: exp of a row's reward (1 - brier) over its family's mean, clipped. Means are joined, not windowed."""
    base = rows.groupBy(family).agg(F.avg(1 - F.col("brier")).alias("base"))
    weight = F.least(F.exp((1 - F.col("brier") - F.col("base")) / temperature), F.lit(clip))
    return join_null_safe(rows, base, [family]).select("id", family, _r(weight).alias("weight"))


def wilson_routes(runs: DataFrame, route: str, success: Column, z: float = 1.645, need: float = 0.0) -> DataFrame:
    by = runs.groupBy(route).agg(F.count(F.lit(1)).alias("runs"), F.sum(success.cast("int")).alias("successes"))
    lower = P.wilson_lower(F.col("successes").cast("double"), F.col("runs").cast("double"), z)
    return by.select(route, "runs", "successes", _r(F.col("successes") / F.col("runs")).alias("rate"), _r(lower).alias("lower_bound"), (lower >= need).alias("accepted"))


def temperature_grid(rows: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """temperature, nll of each grid point (and group), in one aggregate over all of them."""
    loss = lambda t: F.avg(P.nll(F.element_at(P.softmax(F.col("z"), F.lit(float(t))), F.col("gold") + 1)))
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[loss(t).alias(f"t{k}") for k, t in enumerate(grid)])
    long = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), _r(F.col(f"t{k}")).alias("nll")) for k, t in enumerate(grid)])
    return wide.select(*by, F.inline(long), "n").select(*by, "temperature", "nll", "n")


def fit_temperature(rows: DataFrame, *by: str, least: int = 20, rounds: int = 4, width: int = 15) -> DataFrame:
    """temperature of each group by refined grids in log space; 1 for groups of fewer than `least` rows.

    Temperatures are looked for from 1/20 to 20. Each round is one aggregate over the rows with a grid around each group's best point so far; only groups and
    their best points are carried from round to round.
    """
    import math

    from tallyframe.plans.session import stored

    by = by or ("__all",)
    # What a loss needs, written once: the logits below the largest one and that of the truth.
    below = P.let(F.col("z"), lambda z: P.let(F.array_max(z), lambda most: F.transform(z, lambda x: x - most)))
    kept = rows.withColumn("__all", F.lit(1)).select(*by, "gold", below.alias("below"))
    rows = stored(kept.select(*by, "below", F.element_at("below", F.col("gold") + 1).alias("truth")))
    best = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("center", F.lit(0.0)))
    reach = reach_all = math.log(20.0)
    for _ in range(rounds):
        steps = [reach * (2 * k / (width - 1) - 1) for k in range(width)]
        near = rows.join(best.where(F.col("n") >= least), list(by))
        at = [F.greatest(F.lit(-reach_all), F.least(F.lit(reach_all), F.col("center") + F.lit(s))) for s in steps]
        # The grid stands in the aggregation's columns: rows aren't multiplied.
        p = lambda t: F.exp(F.col("truth") / F.exp(t)) / F.aggregate("below", F.lit(0.0), lambda a, x: a + F.exp(x / F.exp(t)))
        means = near.groupBy(*by, "n", "center").agg(*[F.avg(P.nll(p(t))).alias(f"__{k}") for k, t in enumerate(at)])
        losses = means.select(*by, "n", F.inline(F.array(*[F.struct(t.alias("t"), F.col(f"__{k}").alias("loss")) for k, t in enumerate(at)])))
        found = losses.groupBy(*by, "n").agg(F.min_by("t", "loss").alias("center"))
        best = stored(found.unionByName(best.where(F.col("n") < least)))
        reach = reach * 2 / (width - 1)
    return best.select(*[c for c in by if c != "__all"], "n", F.round(F.when(F.col("n") >= least, F.exp("center")).otherwise(1.0), 4).alias("temperature"))


def length_temperature_grid(rows: DataFrame, length: str, a_grid: list[float], b_grid: list[float], penalty: float = 3.0) -> DataFrame:
    """a, b, loss for T = exp(a + b ln(max(n, 64) / 512)): NLL plus a penalty on confident wrong rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in a_grid for b in b_grid])
    t = F.exp(F.col("a") + F.col("b") * F.log(F.greatest(F.col(length), F.lit(64)) / 512.0))
    grid = rows.withColumn("cell", F.explode(cells)).select("gold", "z", "pred", length, "cell.*").withColumn("q", P.softmax(F.col("z"), t))
    over = F.greatest(F.array_max("q") - 0.7, F.lit(0.0))
    wrong = F.when(F.col("pred") != F.col("gold"), over * over).otherwise(0.0)
    return grid.groupBy("a", "b").agg(_r(F.avg(P.nll(F.element_at("q", F.col("gold") + 1))) + penalty * F.avg(wrong)).alias("loss"))


def tau_scan(rows: DataFrame, grid: list[float]) -> DataFrame:
    """tau, brier of distributions raised to 1/tau."""
    points = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return points.groupBy("tau").agg(_r(F.avg(P.brier(P.sharpened(F.col("p"), F.col("tau")), P.one_hot(F.col("gold"), 5)))).alias("brier"))


def confidence_features(rows: DataFrame) -> DataFrame:
    """id, correct and the features of a confidence head: confidence, margin, entropy, log number of options, top less mean."""
    k = F.size("p")
    return rows.select("id", "correct", F.array(F.col("conf"), P.margin(F.col("p")), P.entropy(F.col("p")), F.log(k.cast("double")), F.col("conf") - F.lit(1.0) / k).alias("features"))


def confidence_head(rows: DataFrame) -> DataFrame:
    """id, correct, head: logistic regression of correctness on the features, standardised, L2 with C = 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = confidence_features(rows).withColumn("raw", array_to_vector("features"))
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(data)
    data = scaler.transform(data)
    model = LogisticRegression(featuresCol="x", labelCol="correct", regParam=1.0 / max(1, data.count()), standardization=False).fit(data)
    return model.transform(data).select("id", "correct", F.round(vector_to_array("probability")[1], 4).alias("head"))
