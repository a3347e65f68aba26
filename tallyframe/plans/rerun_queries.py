"""Rules run again on changed facts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import reruns, rules
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query

#: Types of an order by the features that its papers have.
SIGNATURES = {"bulk": ["large", "cheap_clerk", "old"], "rush": ["urgent", "open"], "plain": ["old", "closed", "odd"]}
_WORLD = {"large": "o_totalprice > 150000", "old": "o_orderdate < DATE '1996-01-01'", "urgent": "o_orderpriority LIKE '1%'", "open": "o_orderstatus = 'O'", "closed": "o_orderstatus = 'F'", "odd": "o_orderkey % 2 = 1"}
_LOST, _MORE = "CASE o_orderkey % 7 WHEN 0 THEN 'old' WHEN 1 THEN 'odd' END", ("cheap_clerk", "urgent", "large")


def _list(spark: bool) -> tuple[str, str]:
    """The world's features and those read back, as SQL of either engine: one may be lost, one is added."""
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _WORLD.items())
    added = f"CASE o_orderkey % 5 WHEN 0 THEN '{_MORE[0]}' WHEN 1 THEN '{_MORE[1]}' WHEN 2 THEN '{_MORE[2]}' END"
    if spark:
        return f"array({items})", f"filter(array_append(array({items}), {added}), x -> NOT x <=> {_LOST})"
    return f"list_filter([{items}], lambda x: x IS NOT NULL)", f"list_filter([{items}, {added}], lambda x: x IS NOT NULL AND x IS DISTINCT FROM {_LOST})"


def _typed(features: str) -> str:
    """The type of a list of features in the twin."""
    cover = {t: f"round(len(list_intersect({features}, {own})) / {len(own)}.0::DOUBLE, 9)" for t, own in SIGNATURES.items()}
    best = f"greatest({', '.join(cover.values())})"
    return "CASE " + " ".join(f"WHEN {c} = {best} AND {c} >= 0.6 AND {' AND '.join(f'{o} < {c}' for n, o in cover.items() if n != t)} THEN '{t}'" for t, c in cover.items()) + " ELSE 'other' END"


_W, _R = _list(False)


@query(f"""WITH f AS (SELECT o_orderkey, {_W} AS w, {_R} AS r FROM orders), m AS (SELECT *, list_sort(list_filter(w, lambda x: NOT list_contains(r, x)))[1] AS lost, list_distinct(list_concat(w, r)) AS u FROM f)
SELECT o_orderkey, CASE WHEN lost IS NOT NULL THEN 'features_present:missing_' || lost WHEN {_typed("u")} <> {_typed("w")} THEN 'features_present:extra_features_change_class' ELSE 'matched' END AS verdict FROM m""")
def features_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of orders against what a reader found: some are lost, others are added and may change the type."""
    world, read = _list(True)
    verdict = reruns.features_verdict(lambda f: rules.coverage_type(f, SIGNATURES), F.col("w"), F.col("r"))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{world} AS w", f"{read} AS r").select("o_orderkey", verdict.alias("verdict"))


@query(f"""WITH f AS (SELECT o_orderkey, {_W} AS w FROM orders), x AS (SELECT *, unnest(['cheap_clerk', 'large', 'urgent']) AS x FROM f), k AS (SELECT o_orderkey, x FROM x WHERE NOT list_contains(w, x) AND {_typed("list_append(w, x)")} = {_typed("w")})
SELECT f.o_orderkey, coalesce(string_agg(x, ',' ORDER BY x), '') AS extras FROM f LEFT JOIN k ON k.o_orderkey = f.o_orderkey GROUP BY f.o_orderkey""")
def preserving_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that may be added to an order's papers without a change of its type."""
    world, _ = _list(True)
    extras = reruns.preserving_extras(lambda f: rules.coverage_type(f, SIGNATURES), F.col("w"), F.array(*[F.lit(x) for x in _MORE]))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{world} AS w").select("o_orderkey", F.array_join(extras, ",").alias("extras"))


@query(f"""WITH f AS (SELECT o_orderkey, {_W} AS w, CASE WHEN o_custkey % 10 = 0 THEN 'rush' WHEN o_custkey % 10 = 1 THEN NULL END AS changed, o_custkey % 10 < 2 AS touched FROM orders)
SELECT o_orderkey FROM f WHERE touched AND changed IS DISTINCT FROM {_typed("w")}""")
def not_reproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose recorded type, which is another in a fifth of them, does not follow from their features."""
    world, _ = _list(True)
    rule = lambda f: rules.coverage_type(reruns.feature_set(f), SIGNATURES)
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 10 AS k", f"{world} AS w")
    recorded = F.when(F.col("k") == 0, "rush").when(F.col("k") == 1, F.lit(None)).otherwise(rule(F.col("w")))
    return rows.where(reruns.reproduced(rule, (F.col("w"),), recorded).isNotNull()).select("o_orderkey")
