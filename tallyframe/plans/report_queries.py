"""Reports over predictions as grades and cases, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import reports
from tallyframe.plans.metric_queries import rows_of, view
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query

_LABELS = tuple("abcde")


def _map(p: str):
    return F.map_from_arrays(F.array(*[F.lit(x) for x in _LABELS]), F.col(p))


@query("WITH " + view(0, "a") + "," + view(1, "b") + """, j AS (SELECT a.id, a.slice, a.j, a.p AS t, CASE WHEN a.j = 4 THEN 0.0 ELSE b.p END AS g FROM pla a JOIN plb b ON a.id = b.id AND a.j = b.j),
s AS (SELECT id, slice, sum(g) AS sg, max(t) AS mt FROM j GROUP BY ALL), n AS (SELECT j.*, j.g / sg AS p, mt FROM j JOIN s ON j.id = s.id), x AS (SELECT id, max(p) AS mp FROM n GROUP BY id),
r AS (SELECT n.id, slice, n.id % 7 > 0 AND n.id % 11 > 0 AS counts, sum((p - t) ** 2) AS b, CAST(min(j) FILTER (WHERE p = mp) = min(j) FILTER (WHERE t = mt) AS INT) AS hit FROM n JOIN x USING (id) GROUP BY n.id, slice),
d AS (SELECT CASE WHEN slice = 3 THEN 'none' ELSE 'd' || slice END AS domain, * FROM r)
SELECT domain, CAST(count(*) AS BIGINT) AS n, round(avg(b), 6) AS soft_brier, round(avg(hit), 6) AS agreement, CAST(NULL AS DOUBLE) AS coverage FROM d WHERE counts GROUP BY domain
UNION ALL SELECT NULL, CAST(count(*) FILTER (counts) AS BIGINT), round(avg(b) FILTER (counts), 6), round(avg(hit) FILTER (counts), 6), round(count(*) FILTER (counts) / count(*), 6) FROM d""")
def teacher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's predictions graded against another's: some have no grade, some no target, one label is never graded."""
    target = F.when(F.col("id") % 11 > 0, _map("p"))
    records = rows_of(spark, sf_dir).select("id", F.when(F.col("slice") < 3, F.concat(F.lit("d"), "slice")).alias("domain"), F.array(*[F.lit(x) for x in _LABELS]).alias("labels"), target.alias("target"))
    probs = F.when(F.col("id") % 7 > 0, F.map_filter(_map("p"), lambda k, _: k != "e"))
    return reports.teacher_scores(records, rows_of(spark, sf_dir, 1).select("id", probs.alias("probs")))


@query("WITH " + view() + """, c AS (SELECT 'c' || (id % 6) AS "case", count(*) AS questions, sum(correct) AS correct, round(avg(-ln(greatest(p_gold, 1e-12))), 4) AS nll_mean, round(avg(brier), 4) AS brier_mean FROM pr GROUP BY 1),
l AS (SELECT 'c' || (event_id % 5) AS "case", median(value) AS p50, max(value) AS most FROM events GROUP BY 1)
SELECT c."case", CAST(questions AS BIGINT) AS questions, CAST(correct AS BIGINT) AS correct, round(correct / questions, 6) AS accuracy, nll_mean, brier_mean, round(p50, 1) AS p50, round(most, 1) AS max, round(p50 / questions, 1) AS per_decision FROM c LEFT JOIN l ON l."case" = c."case"
UNION ALL SELECT NULL, CAST(sum(questions) AS BIGINT), CAST(sum(correct) AS BIGINT), round(sum(correct) / sum(questions), 6), round(sum(nll_mean * questions) / sum(questions), 4), round(sum(brier_mean * questions) / sum(questions), 4), NULL, NULL, NULL FROM c""")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of six cases, of which five were timed."""
    rows = rows_of(spark, sf_dir)
    letter = lambda c: F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.col(c) + 1)
    answers = rows.select(F.concat(F.lit("c"), F.col("id") % 6).alias("case"), letter("gold").alias("oracle"), letter("pred").alias("selected"), _map("p").alias("probs"))
    times = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("event_id") % 5).alias("case"), F.col("value").alias("ms"))
    return reports.case_scores(answers, times)
