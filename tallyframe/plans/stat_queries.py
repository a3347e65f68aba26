"""Exact order statistics, batches in order, samples under two caps and layer tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.operators import balanced, layers, order_stats
from tallyframe.plans.metric_queries import V, rows_of, view
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS split, event_type AS label, value < 30 AS easy, event_type || floor(value * 4) AS fact FROM events),
w AS (SELECT split, CAST(count(*) // 3 AS BIGINT) AS n, ceil(count(*) // 3 / 5 * 1.2 - 1e-9) AS cap, CASE WHEN count(*) // 3 < 20 THEN count(*) // 3 ELSE ceil(count(*) // 3 * 0.25 - 1e-9) END AS easy_cap FROM e GROUP BY split),
u AS (SELECT e.*, n, cap, easy_cap FROM e JOIN w ON e.split IS NOT DISTINCT FROM w.split QUALIFY row_number() OVER (PARTITION BY e.split, fact ORDER BY event_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY event_id) AS k FROM u),
p AS (SELECT * FROM r WHERE k <= cap),
z AS (SELECT split, max(event_id) FILTER (WHERE j = easy_cap) AS moment FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY event_id) AS j FROM p WHERE easy) GROUP BY split),
m AS (SELECT r.*, z.moment FROM r LEFT JOIN z ON r.split IS NOT DISTINCT FROM z.split),
f AS (SELECT * FROM m WHERE k <= cap AND (moment IS NULL OR event_id <= moment)),
c AS (SELECT split, label, count(*) AS taken FROM f GROUP BY ALL),
s AS (SELECT m.split, m.event_id, m.n, row_number() OVER (PARTITION BY m.split, m.label ORDER BY event_id) AS j, cap - coalesce(taken, 0) AS room FROM m LEFT JOIN c ON m.split IS NOT DISTINCT FROM c.split AND m.label = c.label WHERE NOT easy AND event_id > moment),
a AS (SELECT split, event_id, n FROM f UNION ALL SELECT split, event_id, n FROM s WHERE j <= room),
kept AS (SELECT split, event_id FROM a QUALIFY row_number() OVER (PARTITION BY split ORDER BY event_id) <= n),
h AS (SELECT w.split, n - (SELECT count(*) FROM kept WHERE kept.split IS NOT DISTINCT FROM w.split) AS short FROM w),
o AS (SELECT u.split, u.event_id, row_number() OVER (PARTITION BY u.split ORDER BY u.event_id) AS j, short FROM u JOIN h ON u.split IS NOT DISTINCT FROM h.split WHERE u.event_id NOT IN (SELECT event_id FROM kept))
SELECT split, event_id, 'kept' AS why FROM kept UNION ALL SELECT split, event_id, 'filled' FROM o WHERE j <= short""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of each split's events in order, under a cap for each label and one for easy events together."""
    split = F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 3)
    rows = table(spark, sf_dir, "events").withColumn("split", split)
    wanted = rows.groupBy("split").agg(F.floor(F.count(F.lit(1)) / 3).alias("n"))
    fact = F.concat("event_type", F.floor(F.col("value") * 4).cast("string"))
    return balanced.balanced_sample(rows, "split", "event_type", F.col("value") < 30, fact, F.col("event_id"), "event_id", wanted, 5, 1.2, 0.25)


_BUDGET = 2_000


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS words, row_number() OVER (ORDER BY len(string_split(text, ' ')), doc_id) AS i FROM documents),
b AS (SELECT i, doc_id, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.doc_id, CASE WHEN (place + 2) * words > {_BUDGET} THEN batch + 1 ELSE batch END, CASE WHEN (place + 2) * words > {_BUDGET} THEN 0 ELSE place + 1 END FROM b JOIN r ON r.i = b.i + 1)
SELECT doc_id, batch, place FROM b""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length in batches of at most so many padded words; the twin is the loop, row by row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))
    return order_stats.token_batches(rows, "words", "doc_id", _BUDGET).select("doc_id", "batch", "place")


_COVER = (0.01, 0.1, 0.5, 0.9, 1.0)


@query(V + f""", r AS (SELECT correct, row_number() OVER (ORDER BY round(conf, 12) DESC, id) AS k, count(*) OVER () AS n FROM pr), c AS (SELECT unnest({list(_COVER)}) AS coverage)
SELECT CAST(coverage AS DOUBLE) AS coverage, CAST(count(*) AS BIGINT) AS kept, round(avg(correct), 6) AS accuracy FROM r, c WHERE k <= greatest(1, floor(coverage * n + 1e-9)) GROUP BY coverage""")
def selective_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_stats.selective_accuracy(rows_of(spark, sf_dir), [-F.round("conf", 12), F.col("id")], list(_COVER))


@query("""WITH r AS (SELECT lang, length(text) AS c, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CAST(max(n) AS BIGINT) AS n, CAST(max(c) FILTER (WHERE i = 0) AS BIGINT) AS least, CAST(max(c) FILTER (WHERE i = n // 2) AS BIGINT) AS upper_median, CAST(max(c) FILTER (WHERE i = floor(0.99 * (n - 1))) AS BIGINT) AS p99 FROM r GROUP BY lang""")
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact places in the sorted lengths of each language's documents; the median is the upper one."""
    rows = table(spark, sf_dir, "documents").select("lang", F.char_length("text").cast("long").alias("c"))
    n = F.col("n")
    return order_stats.order_statistics(rows, ["lang"], "c", {"least": F.lit(0), "upper_median": F.floor(n / 2), "p99": F.floor(F.lit(0.99) * (n - 1))})


_DEEP = 10
_LAYERS = "WITH " + ",".join(view(k, str(k)) for k in range(_DEEP)) + ", pp AS (" + " UNION ALL ".join(f"SELECT {k} AS layer, id, pred, conf, correct FROM pr{k}" for k in range(_DEEP)) + "), ql AS (" + " UNION ALL ".join(f"SELECT {k} AS layer, id, gold, j, p FROM pl{k}" for k in range(_DEEP)) + ")"


@query(f"""{_LAYERS}, a AS (SELECT pp.layer AS k, pp.conf, pp.correct, CAST(pp.pred = f.pred AS DOUBLE) AS extra, 'layer' AS kind FROM pp JOIN pp f ON f.id = pp.id AND f.layer = {_DEEP - 1}),
ks AS (SELECT unnest({list(layers.LASTS)}) AS k), em AS (SELECT k, id, gold, j, avg(p) AS p FROM ql, ks WHERE layer >= {_DEEP} - k GROUP BY ALL), ex AS (SELECT k, id, max(p) AS conf FROM em GROUP BY ALL),
e AS (SELECT em.k, ex.conf, CAST(min(j) FILTER (WHERE p = ex.conf) = gold AS INT) AS correct FROM em JOIN ex USING (k, id) GROUP BY em.k, em.id, gold, ex.conf),
t AS (SELECT q.id, q.layer, sum(abs(q.p - f.p)) / 2 AS tvd FROM ql q JOIN ql f ON f.id = q.id AND f.j = q.j AND f.layer = {_DEEP - 1} WHERE q.layer BETWEEN {_DEEP - layers.LATE} AND {_DEEP - 2} GROUP BY ALL),
tm AS (SELECT id, avg(tvd) AS extra FROM t GROUP BY id), fl AS (SELECT id, count(DISTINCT pred) - 1 AS flips FROM pp WHERE layer >= {_DEEP - layers.LATE} GROUP BY id),
b AS (SELECT CASE WHEN flips >= 4 THEN 4 WHEN flips >= 2 THEN 2 ELSE flips END AS k, pp.conf, pp.correct, extra FROM pp JOIN fl USING (id) JOIN tm USING (id) WHERE layer = {_DEEP - 1}),
x AS (SELECT kind, k, conf, correct, extra FROM a UNION ALL SELECT 'last', k, conf, correct, NULL FROM e UNION ALL SELECT 'flips', k, conf, correct, extra FROM b),
g AS (SELECT kind, k, least(9, CAST(floor(conf * 10) AS INT)) AS bin, count(*) AS m, sum(conf) AS c, sum(correct) AS r, sum(extra) AS e FROM x GROUP BY ALL)
SELECT kind, CAST(k AS INTEGER) AS k, CAST(sum(m) AS BIGINT) AS n, round(sum(r) / sum(m), 6) AS accuracy, round(sum(c) / sum(m), 6) AS mean_conf, round(sum(abs(c - r)) / sum(m), 6) AS ece, round(sum(e) / sum(m), 6) AS extra FROM g GROUP BY kind, k""")
def layer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten layers of each prediction: accuracy by depth, ensembles of the last layers, and late disagreement."""
    made = rows_of(spark, sf_dir)
    layer = lambda k: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: ((F.col("id") * (F.lit(31) + k) + j * 17 + F.length("event_type") * 7) % 97) / F.lit(20.0))
    deep = F.array(*[P.softmax(layer(F.lit(k))) for k in range(_DEEP)])
    return layers.layer_probe(made.select("gold", deep.alias("layers")), "layers", "gold")
