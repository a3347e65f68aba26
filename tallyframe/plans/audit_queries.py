"""Further audits, splits and rules over the given tables, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.functions import text as T
from tallyframe.operators import sampling, similarity, temporal
from tallyframe.plans.metric_queries import V, rows_of, view
from tallyframe.plans.session import table
from tallyframe.plans.text_queries import NORM

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""
WITH d AS (SELECT doc_id, list_distinct(string_split({NORM}, ' ')) AS t FROM documents WHERE {NORM} <> ''), b AS (SELECT item_id, list_distinct(string_split({NORM}, ' ')) AS t FROM benchmark WHERE {NORM} <> '')
SELECT doc_id, item_id, round(len(list_intersect(d.t, b.t)) / (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))), 6) AS jaccard FROM d JOIN b ON len(d.t) <= len(b.t) / 0.05 AND len(list_intersect(d.t, b.t)) >= 0.05 * (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))) AND len(list_intersect(d.t, b.t)) / (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))) >= 0.3
""")
def token_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.token_set_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.3).withColumn("jaccard", F.round("jaccard", 6))


@query(V + ", e AS (SELECT id // 3 AS eval_id, slice, min(correct) AS ok FROM pr GROUP BY ALL) SELECT slice, CAST(count(*) AS BIGINT) AS evals, round(avg(ok), 6) AS pass_rate FROM e GROUP BY slice")
def eval_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation of several questions passes only if all match."""
    by = rows_of(spark, sf_dir).groupBy(F.floor(F.col("id") / 3).alias("eval_id"), "slice").agg(F.min("correct").alias("ok"))
    return by.groupBy("slice").agg(F.count(F.lit(1)).alias("evals"), F.round(F.avg("ok"), 6).alias("pass_rate"))


@query(V + """, g AS (SELECT unnest([0.3, 0.4, 0.5, 0.9]::DOUBLE[]) AS threshold), a AS (SELECT threshold, conf >= threshold AND pred = 0 AS auto, gold <> 0 AS bad, value > 80 AS floored FROM pr, g)
SELECT threshold, CAST(count(*) FILTER (WHERE auto) AS BIGINT) AS allowed, CAST(count(*) FILTER (WHERE auto AND bad) AS BIGINT) AS false_allowed, CAST(count(*) FILTER (WHERE auto AND bad AND NOT floored) AS BIGINT) AS false_with_floor FROM a GROUP BY threshold""")
def false_auto_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option 0 stands for allow; a floor holds back rows of high value."""
    grid = rows_of(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.3, 0.4, 0.5, 0.9)])))
    auto, bad = (F.col("conf") >= F.col("threshold")) & (F.col("pred") == 0), F.col("gold") != 0
    return grid.groupBy("threshold").agg(F.count_if(auto).alias("allowed"), F.count_if(auto & bad).alias("false_allowed"), F.count_if(auto & bad & (F.col("value") <= 80)).alias("false_with_floor"))


@query(V + """ SELECT CASE WHEN grouping(slice) = 0 THEN 'slice' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'all' END AS dimension, coalesce(CAST(slice AS VARCHAR), event_type, 'ALL') AS value, CAST(count(*) AS BIGINT) AS n, round(avg(correct), 6) AS accuracy, round(avg(1 / 5.0::DOUBLE), 6) AS chance
FROM pr GROUP BY GROUPING SETS ((slice), (event_type), ())""")
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and chance by several key sets in one pass."""
    rows = rows_of(spark, sf_dir)
    sets = rows.groupingSets([[F.col("slice")], [F.col("event_type")], []], "slice", "event_type").agg(
        F.when(F.grouping("slice") == 0, "slice").when(F.grouping("event_type") == 0, "event_type").otherwise("all").alias("dimension"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg(F.lit(1.0) / F.size("p")), 6).alias("chance"),
    )
    return sets.select("dimension", F.coalesce(F.col("slice").cast("string"), "event_type", F.lit("ALL")).alias("value"), "n", "accuracy", "chance")


@query("WITH " + view() + "," + view(1, "b") + """, x AS (SELECT 'a' AS model, correct, brier, nll FROM pr UNION ALL SELECT 'b', correct, brier, nll FROM prb), sm AS (SELECT model, round(avg(correct), 6) AS accuracy, round(-avg(brier), 6) AS brier, round(-avg(nll), 6) AS nll FROM x GROUP BY 1),
l AS (SELECT model, 'accuracy' AS measure, accuracy AS v FROM sm UNION ALL SELECT model, 'brier', brier FROM sm UNION ALL SELECT model, 'nll', nll FROM sm)
SELECT measure, max(v) FILTER (WHERE model = 'a') AS a, max(v) FILTER (WHERE model = 'b') AS b, CASE WHEN max(v) FILTER (WHERE model = 'b') > max(v) FILTER (WHERE model = 'a') THEN 'b' ELSE 'a' END AS winner FROM l GROUP BY measure""")
def release_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures (larger is better) as rows, models as columns, and the winner."""
    parts = [rows_of(spark, sf_dir, k).select(F.lit(m).alias("model"), "correct", "brier", "nll") for k, m in enumerate("ab")]
    means = reduce(DataFrame.unionByName, parts).groupBy("model").agg(F.round(F.avg("correct"), 6).alias("accuracy"), F.round(-F.avg("brier"), 6).alias("brier"), F.round(-F.avg("nll"), 6).alias("nll"))
    long = means.unpivot("model", ["accuracy", "brier", "nll"], "measure", "v")
    wide = long.groupBy("measure").pivot("model", ["a", "b"]).agg(F.max("v"))
    return wide.withColumn("winner", F.when(F.col("b") > F.col("a"), "b").otherwise("a"))


@query("WITH " + view() + "," + view(1, "b") + """, j AS (SELECT pr.id, pr.slice, CAST(pr.pred <> prb.pred AS INT) AS flip, abs(pr.p_gold - prb.p_gold) AS shift FROM pr JOIN prb ON prb.id = pr.id)
SELECT slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(flip) AS BIGINT) AS flips, round(avg(shift), 6) AS mean_shift FROM j GROUP BY slice""")
def length_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips and mean probability shift of the same items against a baseline."""
    base, other = rows_of(spark, sf_dir), rows_of(spark, sf_dir, 1)
    both = base.select("id", "slice", "pred", "p_gold").join(other.select("id", F.col("pred").alias("pred_b"), F.col("p_gold").alias("p_b")), "id")
    return both.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") != F.col("pred_b")).cast("int")).alias("flips"), F.round(F.avg(F.abs(F.col("p_gold") - F.col("p_b"))), 6).alias("mean_shift"))


@query(V + " SELECT slice, round(avg(1 - brier), 6) AS brier_reward, round(avg(greatest(ln(p_gold + 1e-12), -5.0)), 6) AS log_reward, round(avg(CASE WHEN conf < 0.5 THEN 0.1 WHEN correct = 1 THEN 1.0 ELSE -1.0 END::DOUBLE), 6) AS abstain_reward FROM pr GROUP BY slice")
def reward_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    log = F.greatest(F.log(F.col("p_gold") + 1e-12), F.lit(-5.0))
    abstain = F.when(F.col("conf") < 0.5, 0.1).when(F.col("correct") == 1, 1.0).otherwise(-1.0)
    return rows.groupBy("slice").agg(F.round(F.avg(1 - F.col("brier")), 6).alias("brier_reward"), F.round(F.avg(log), 6).alias("log_reward"), F.round(F.avg(abstain), 6).alias("abstain_reward"))


@query("WITH " + view() + "," + view(1, "b") + """, j AS (SELECT a.id, a.j AS x, b.j AS y, a.p * b.p AS p FROM pl a JOIN plb b ON b.id = a.id), mx AS (SELECT id, x, sum(p) AS px FROM j GROUP BY ALL) SELECT x AS option, round(avg(px), 6) AS marginal FROM mx GROUP BY x""")
def joint_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer product of two distributions as one array, and the first one's marginals taken back out of it."""
    both = rows_of(spark, sf_dir).select("id", "p").join(rows_of(spark, sf_dir, 1).select("id", F.col("p").alias("q")), "id")
    joint = F.flatten(F.transform("p", lambda a: F.transform("q", lambda b: a * b)))
    marginal = T.let(joint, lambda j: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: P.total(F.slice(j, x * 5 + 1, F.lit(5)))))
    return both.select(F.posexplode(marginal).alias("option", "m")).groupBy(F.col("option").cast("long").alias("option")).agg(F.round(F.avg("m"), 6).alias("marginal"))


_DIGIT = "strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1"


@query(f"""
WITH t AS (SELECT p_partkey, sha1(list_aggregate(list_sort(string_split(p_type, ' ')), 'string_agg', ',')) AS h FROM part), d AS (SELECT p_partkey, sum(CASE WHEN i = 40 THEN 1 ELSE 6 END * ({_DIGIT})) % 10 AS m FROM t, (SELECT unnest(range(1, 41)) AS i) g GROUP BY 1)
SELECT p_partkey, m = 0 AS is_eval FROM d
""")
def toolset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of ten by the last decimal digit of a 160-bit hash: 16 to any power ends in 6, so hex digits weigh 6 and the last 1."""
    names = F.array_join(F.array_sort(F.split("p_type", " ")), ",")
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.when(i == 40, 1).otherwise(6) * (F.conv(F.substring(F.col("h"), i, F.lit(1)), 16, 10).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.sha1(F.encode(names, "UTF-8")).alias("h"))
    return rows.select("p_partkey", (F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0).alias("is_eval"))


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'exclusion' WHEN o_orderstatus = 'P' THEN 'exclusion' WHEN o_orderpriority = '1-URGENT' THEN 'grant' WHEN o_orderkey % 3 = 0 THEN 'grant' ELSE 'default' END AS kind,
 CASE WHEN o_totalprice > 200000 THEN 4 WHEN o_orderstatus = 'P' THEN 5 WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 9 END AS clause,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_totalprice > 200000 THEN 4 WHEN o_orderstatus = 'P' THEN 5 ELSE 9 END AS in_order FROM orders)
SELECT o_orderkey, kind, CAST(clause AS INT) AS clause, CAST(in_order AS INT) AS in_order FROM c
""")
def policy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deciding clause of a policy: exclusions first and then by number, and by number alone."""
    clauses = [(1, "grant", F.col("o_orderpriority") == "1-URGENT"), (2, "grant", F.col("o_orderkey") % 3 == 0), (4, "exclusion", F.col("o_totalprice") > 200_000), (5, "exclusion", F.col("o_orderstatus") == "P")]
    holding = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(int(kind != "exclusion")).alias("late"), F.lit(n).alias("n"), F.lit(kind).alias("kind"))) for n, kind, c in clauses]))
    first, least = F.try_element_at(F.array_sort(holding), F.lit(1)), F.array_min(F.transform(holding, lambda x: x["n"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(first["kind"], F.lit("default")).alias("kind"), F.coalesce(first["n"], F.lit(9)).alias("clause"), F.coalesce(least, F.lit(9)).alias("in_order"))


@query("""
WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS eff, max(o_totalprice) AS price FROM orders GROUP BY ALL) SELECT o_custkey, eff, lead(eff) OVER (PARTITION BY o_custkey ORDER BY eff) AS effective_to FROM r
""")
def revision_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("eff")).distinct()
    return temporal.revisions_with_end(revisions, "o_custkey", "eff")


@query("""
WITH l AS (SELECT event_type, CASE event_type WHEN 'purchase' THEN 'billing' WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' ELSE 'general' END AS queue FROM events) SELECT queue, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY queue
""")
def ticket_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table-driven rule: kinds meet their queue in a join, others go to the general one."""
    queues = spark.createDataFrame([("purchase", "billing"), ("click", "web"), ("view", "web")], "event_type string, queue string")
    return table(spark, sf_dir, "events").join(queues, "event_type", "left").groupBy(F.coalesce("queue", F.lit("general")).alias("queue")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ."''') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN lower(t) = 'yes' THEN 'yes' WHEN lower(t) = 'no' THEN 'no' WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])maybe([^a-z0-9]|$)') THEN 'maybe' WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])the([^a-z0-9]|$)') THEN 'the' WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])yes([^a-z0-9]|$)') THEN 'yes' WHEN regexp_matches(t, '(?i)(^|[^a-z0-9])no([^a-z0-9]|$)') THEN 'no' END AS answer FROM a
""")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that is an option once quotes and points are gone, else the longest option that stands in it as a word."""
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(" .\"'"))
    options = ["maybe", "the", "yes", "no"]
    exact = [F.when(F.lower(trimmed) == o, o) for o in ("yes", "no", "maybe", "the")]
    within = [F.when(trimmed.rlike(f"(?i)(^|[^a-z0-9]){o}([^a-z0-9]|$)"), o) for o in options]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(*exact, *within).alias("answer"))


@query()
def hardest_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hardest_and_random(rows_of(spark, sf_dir).select("id", "correct", "conf"), "id", 200, "hard")


@query(V + ", b AS (SELECT slice, max(p_gold) AS top FROM pr GROUP BY 1) SELECT pr.slice, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE correct = 0 OR p_gold < 0.2) AS BIGINT) AS hard FROM pr GROUP BY pr.slice")
def hard_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose choice is wrong or whose gold probability is below the margin."""
    return rows_of(spark, sf_dir).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("correct") == 0) | (F.col("p_gold") < 0.2)).alias("hard"))


@query(V + " SELECT slice, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN conf < 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS abstain_mass, round(avg(conf * CASE WHEN conf < 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE), 6) AS top FROM pr GROUP BY slice")
def abstain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.operators.inference import abstain_shift as shift

    rows = rows_of(spark, sf_dir).select("slice", "p", shift(F.col("p")).alias("q"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at("q", -1)), 6).alias("abstain_mass"), F.round(F.avg(F.array_max(F.slice("q", 1, 5))), 6).alias("top"))
