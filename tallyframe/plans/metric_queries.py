"""Queries over predicted distributions derived from events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.operators import order_stats
from tallyframe.operators import predictions as M
from tallyframe.plans.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rows_of(spark: SparkSession, sf_dir: str, perm: int = 0) -> DataFrame:
    return M.from_events(table(spark, sf_dir, "events"), perm)


def perms_of(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    out = rows_of(spark, sf_dir).withColumn("perm", F.lit(0))
    for k in range(1, n):
        out = out.unionByName(rows_of(spark, sf_dir, k).withColumn("perm", F.lit(k)))
    return out


def view(perm: int = 0, name: str = "") -> str:
    """CTEs pl{name} (a row for each option) and pr{name} (a row for each prediction)."""
    return f"""
t{name} AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS gold FROM (SELECT DISTINCT event_type FROM events)),
z{name} AS (SELECT event_id AS id, CAST(user_id % 4 AS INT) AS slice, e.event_type, value, gold, j, ((event_id * {31 + perm} + j * 17 + length(e.event_type) * 7) % 97) / 20.0::DOUBLE AS z
            FROM events e JOIN t{name} ON e.event_type = t{name}.event_type, (SELECT unnest(range(0, 5)) AS j) g),
m{name} AS (SELECT id, max(z) AS mz FROM z{name} GROUP BY id), s{name} AS (SELECT z.id, sum(exp(z - mz)) AS sz FROM z{name} z JOIN m{name} m ON m.id = z.id GROUP BY z.id),
pl{name} AS (SELECT z.*, mz, exp(z - mz) / sz AS p FROM z{name} z JOIN m{name} m ON m.id = z.id JOIN s{name} s ON s.id = z.id),
pr{name} AS (SELECT id, slice, event_type, value, gold, CAST(min(j) FILTER (WHERE z = mz) AS INT) AS pred, max(p) AS conf, max(p) FILTER (WHERE j = gold) AS p_gold,
             CAST(min(j) FILTER (WHERE z = mz) = gold AS INT) AS correct, sum((p - CASE WHEN j = gold THEN 1.0 ELSE 0.0 END) ** 2) AS brier, -ln(max(p) FILTER (WHERE j = gold) + 1e-12) AS nll
             FROM pl{name} GROUP BY id, slice, event_type, value, gold)"""


V = "WITH " + view()
_SUMMARY = """, c AS (SELECT {by} gold, avg(correct) AS a, count(*) AS k, sum(correct) AS correct, sum(brier) AS brier, sum(nll) AS nll, sum(conf) AS conf FROM pr GROUP BY ALL)
SELECT {by} CAST(sum(k) AS BIGINT) AS n, round(sum(correct) / sum(k), 6) AS accuracy, round(avg(a), 6) AS macro_accuracy, round(sum(brier) / sum(k), 6) AS brier, round(sum(nll) / sum(k), 6) AS nll, round(sum(conf) / sum(k), 6) AS confidence FROM c {group}"""


@query(V + _SUMMARY.format(by="", group=""))
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(rows_of(spark, sf_dir))


@query(V + _SUMMARY.format(by="slice,", group="GROUP BY slice"))
def metric_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(rows_of(spark, sf_dir), "slice")


_ECE = """, b AS (SELECT {bin} AS bin, count(*) AS n, abs(avg({value}) - avg({hit})) AS gap FROM {source} GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b"""
_RIGHT = "least(9, " + " + ".join(f"CAST(conf > {e!r} AS INT)" for e in P._edges(10)[1:10]) + ")"
_LEFT = " + ".join(f"CAST(p_gold >= {e!r} AS INT)" for e in P._edges(10)[1:10])


@query(V + _ECE.format(bin="least(9, CAST(floor(conf * 10) AS INT))", value="conf", hit="correct", source="pr"))
def ece_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_error(rows_of(spark, sf_dir), P.bin_floor(F.col("conf")), F.col("conf"), F.col("correct"))


@query(V + _ECE.format(bin=_RIGHT, value="conf", hit="correct", source="pr"))
def ece_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_error(rows_of(spark, sf_dir), P.bin_right_closed(F.col("conf")), F.col("conf"), F.col("correct"))


@query(V + _ECE.format(bin=_LEFT, value="p_gold", hit="correct", source="pr"))
def ece_noul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yes-no view of the same rows: the probability of the gold option against whether it was chosen."""
    return M.calibration_error(rows_of(spark, sf_dir), P.bin_left_closed(F.col("p_gold")), F.col("p_gold"), F.col("correct"))


@query(V + f", b AS (SELECT CAST({_RIGHT} AS INT) AS bin, conf, correct FROM pr) SELECT bin, CAST(count(*) AS BIGINT) AS n, round(avg(conf), 6) AS mean_value, round(avg(correct), 6) AS hit_rate FROM b GROUP BY bin")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reliability(rows_of(spark, sf_dir), P.bin_right_closed(F.col("conf")).cast("int"), F.col("conf"), F.col("correct"))


_OPTION = """, r AS (SELECT gold AS option, correct AS tp, 0 AS fp, 1 - correct AS fn, 1 AS s FROM pr UNION ALL SELECT pred, 0, 1 - correct, 0, 0 FROM pr),
o AS (SELECT option, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(s) AS s FROM r GROUP BY option),
f AS (SELECT CAST(option AS INT) AS option, CAST(s AS BIGINT) AS support, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM o)"""


@query(V + _OPTION + " SELECT * FROM f")
def per_option_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.per_option(rows_of(spark, sf_dir))


@query(V + _OPTION + " SELECT round(avg(f1), 6) AS macro_f1, CAST(count(*) AS BIGINT) AS classes FROM f")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.macro_f1(rows_of(spark, sf_dir))


@query(V + " SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll, round(avg(abs(p_gold - conf)), 6) AS mean_gap FROM pr GROUP BY event_type")
def losses_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg(F.abs(F.col("p_gold") - F.col("conf"))), 6).alias("mean_gap")
    )


@query("WITH " + view() + "," + view(1, "b") + """, d AS (SELECT a.id, sum(abs(a.p - b.p)) / 2 AS tvd, sum((a.p - b.p) ** 2) AS sb FROM pl a JOIN plb b ON a.id = b.id AND a.j = b.j GROUP BY a.id)
SELECT pr.slice, CAST(count(*) AS BIGINT) AS n, round(avg(tvd), 6) AS tvd, round(avg(sb), 6) AS soft_brier, round(avg(CAST(pr.pred = prb.pred AS INT)), 6) AS agreement FROM d JOIN pr ON pr.id = d.id JOIN prb ON prb.id = d.id GROUP BY pr.slice""")
def soft_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fidelity(rows_of(spark, sf_dir), rows_of(spark, sf_dir, 1), "slice")


@query(V + ", g AS (SELECT unnest(range(0, 20)) / 20.0::DOUBLE AS threshold) SELECT threshold, round(avg(CAST(conf >= threshold AS INT)), 6) AS coverage, round(coalesce(avg(1 - correct) FILTER (WHERE conf >= threshold), 0.0), 6) AS risk FROM pr, g GROUP BY threshold")
def selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.selective_risk(rows_of(spark, sf_dir))


@query(V + """, b AS (SELECT round(conf, 4) AS t, count(*) AS n, sum(correct) AS c FROM pr GROUP BY 1), r AS (SELECT t, sum(n) OVER w AS kept, sum(c) OVER w / sum(n) OVER w AS a FROM b WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))
SELECT min(t) AS threshold, CAST(max(kept) AS BIGINT) AS kept, round(arg_min(a, t), 6) AS accuracy FROM r WHERE kept >= 20 AND a >= 0.2""")
def abstain_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.abstain_threshold(rows_of(spark, sf_dir), 0.2)


_COSTS = [0, 1, 2, 4, 5]


@query(V + f""", g AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS threshold), a AS (SELECT threshold, gold, CASE WHEN conf >= threshold THEN pred ELSE 2 END AS action FROM pr, g)
SELECT threshold, round(avg({_COSTS}[action + 1]), 6) AS cost, round(avg(CAST(action = gold AS INT)), 6) AS quality FROM a GROUP BY threshold""")
def cost_quality_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cost_quality(rows_of(spark, sf_dir), _COSTS, 2)


_PERMS = "WITH " + ",".join(view(k, str(k)) for k in range(3)) + ", pp AS (" + " UNION ALL ".join(f"SELECT {k} AS perm, * FROM pr{k}" for k in range(3)) + ")"
_PERM_L = ", pq AS (" + " UNION ALL ".join(f"SELECT {k} AS perm, id, gold, j, p FROM pl{k}" for k in range(3)) + ")"


@query(_PERMS + ", b AS (SELECT id, min(pred) <> max(pred) AS d, min(correct) AS e, max(correct) AS s FROM pp GROUP BY id) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(d AS INT)), 6) AS sensitive, round(avg(e), 6) AS all_correct, round(avg(s), 6) AS any_correct FROM b")
def order_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.order_sensitivity(perms_of(spark, sf_dir))


@query(V + " SELECT pred AS slot, CAST(count(*) AS BIGINT) AS k, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pr GROUP BY pred")
def slot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.slot_share(rows_of(spark, sf_dir))


@query(_PERMS + _PERM_L + """, t AS (SELECT a.id, a.perm, b.perm AS perm_b, sum(abs(a.p - b.p)) / 2 AS tvd FROM pq a JOIN pq b ON a.id = b.id AND a.j = b.j AND a.perm < b.perm GROUP BY ALL),
u AS (SELECT id, avg(tvd) AS tvd FROM t GROUP BY id), f AS (SELECT id, CAST(min(pred) <> max(pred) AS INT) AS flip FROM pp GROUP BY id)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(tvd), 6) AS mean_tvd, CAST(sum(flip) AS BIGINT) AS flips FROM u JOIN f ON f.id = u.id""")
def perm_avg_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.disagreement(perms_of(spark, sf_dir))


_AVERAGED = """, a AS (SELECT id, gold, j, avg(p) AS p FROM pq GROUP BY ALL), m AS (SELECT id, gold, arg_max(j, struct_pack(p := round(p, 12), j := -j)) AS pred, sum((p - CASE WHEN j = gold THEN 1.0 ELSE 0.0 END) ** 2) AS brier, max(p) FILTER (WHERE j = gold) AS pg FROM a GROUP BY id, gold)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(pred = gold AS INT)), 6) AS accuracy, round(avg(brier), 6) AS brier{nll} FROM m"""


@query(_PERMS + _PERM_L + _AVERAGED.format(nll=", round(avg(-ln(pg + 1e-12)), 6) AS nll"))
def perm_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.averaged(perms_of(spark, sf_dir))


@query(_PERMS + _PERM_L + _AVERAGED.format(nll=""))
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ensemble([rows_of(spark, sf_dir, k) for k in range(3)])


@query(V + """, f AS (SELECT CAST(slice AS VARCHAR) AS family, * EXCLUDE (slice) FROM pr UNION ALL SELECT 'ALL', * EXCLUDE (slice) FROM pr)
SELECT family, CAST(count(*) AS BIGINT) AS n, round(avg(correct), 6) AS acc, round(avg(conf), 6) AS conf, round(avg(brier), 6) AS brier, CAST(coalesce(sum(1 - correct) FILTER (WHERE conf >= 0.8), 0) AS BIGINT) AS wrong80, CAST(coalesce(sum(1 - correct) FILTER (WHERE conf >= 0.9), 0) AS BIGINT) AS wrong90,
round(coalesce(sum(1 - correct) FILTER (WHERE conf >= 0.8) / nullif(sum(1 - correct), 0), 0.0), 6) AS confident_share FROM f GROUP BY family""")
def confident_wrong_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confident_wrong(rows_of(spark, sf_dir), "slice")


_T = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


def _tempered(grid: list[float]) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in grid)
    return f""", g AS (SELECT * FROM (VALUES {values}) v(t)), q AS (SELECT id, slice, gold, t, sum(exp((z - mz) / t)) AS s, max(exp((z - mz) / t)) FILTER (WHERE j = gold) AS e FROM pl, g GROUP BY ALL)"""


@query(V + _tempered(_T) + " SELECT slice, t AS temperature, round(avg(-ln(e / s + 1e-12)), 6) AS nll, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY slice, t")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.temperature_grid(rows_of(spark, sf_dir), _T, "slice")


@query()
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fit_temperature(rows_of(spark, sf_dir), "slice")


_A, _B = [-0.5, 0.0, 0.5], [-0.2, 0.0, 0.2]


@query(V + f""", n AS (SELECT id, gold, pred, 64 + (id % 2000) AS len FROM pr), c AS (SELECT a, b FROM (SELECT unnest({_A}::DOUBLE[]) AS a), (SELECT unnest({_B}::DOUBLE[]) AS b)),
k AS (SELECT n.id, a, b, n.gold, n.pred, exp(a + b * ln(greatest(len, 64) / 512.0::DOUBLE)) AS t FROM n, c),
q AS (SELECT k.id, a, b, k.pred, k.gold, sum(exp((z - mz) / t)) AS s, max(exp((z - mz) / t)) FILTER (WHERE j = k.gold) AS e, max(exp((z - mz) / t)) AS top FROM k JOIN pl ON pl.id = k.id GROUP BY ALL)
SELECT a, b, round(avg(-ln(e / s + 1e-12)) + 3.0 * avg(CASE WHEN pred <> gold THEN greatest(top / s - 0.7, 0.0) ** 2 ELSE 0.0 END), 6) AS loss FROM q GROUP BY a, b""")
def length_temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir).withColumn("len", F.col("id") % 2000 + 64)
    return M.length_temperature_grid(rows, "len", _A, _B)


@query(V + """, g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0), (2.0)) v(tau)), w AS (SELECT id, gold, j, tau, exp(ln(greatest(p, 1e-12)) / tau) AS w FROM pl, g), sw AS (SELECT id, tau, sum(w) AS s FROM w GROUP BY ALL)
SELECT w.tau, round(avg(b), 6) AS brier FROM (SELECT w.id, w.tau, sum((w / s - CASE WHEN j = gold THEN 1.0 ELSE 0.0 END) ** 2) AS b FROM w JOIN sw ON sw.id = w.id AND sw.tau = w.tau GROUP BY ALL) w GROUP BY w.tau""")
def tau_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tau_scan(rows_of(spark, sf_dir), [0.5, 1.0, 2.0])


@query()
def confidence_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confidence_head(rows_of(spark, sf_dir))


_GRID = [(0.5, 0.5), (0.7, 0.6), (0.9, 0.8)]


@query("WITH " + view() + "," + view(1, "b") + """, g AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (0.7, 0.6), (0.9, 0.8)) v(t1, t2)),
a AS (SELECT t1, t2, pr.gold, pr.conf >= t1 AS f, CASE WHEN pr.conf >= t1 THEN pr.pred WHEN prb.conf >= t2 THEN prb.pred END AS ans FROM pr JOIN prb ON prb.id = pr.id, g)
SELECT t1, t2, round(avg(CAST(ans IS NOT NULL AS INT)), 6) AS auto, round(coalesce(avg(CAST(ans = gold AS INT)), 0.0), 6) AS accuracy, round(avg(CAST(f AS INT)), 6) AS small_share FROM a GROUP BY t1, t2""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cascade(rows_of(spark, sf_dir), rows_of(spark, sf_dir, 1), _GRID)


@query("WITH " + view() + "," + view(1, "b") + """, g AS (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS threshold), a AS (SELECT threshold, pr.gold, pr.conf >= threshold AS f, CASE WHEN pr.conf >= threshold THEN pr.pred ELSE prb.pred END AS c FROM pr JOIN prb ON prb.id = pr.id, g)
SELECT threshold, round(avg(CAST(c = gold AS INT)), 6) AS accuracy, round(avg(CAST(f AS INT)), 6) AS exits, round(avg(CASE WHEN f THEN 0.75::DOUBLE ELSE 1.0 END), 6) AS compute FROM a GROUP BY threshold""")
def depth_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.depth_cascade(rows_of(spark, sf_dir), rows_of(spark, sf_dir, 1))


@query(V + ", b AS (SELECT slice, avg(1 - brier) AS base FROM pr GROUP BY 1) SELECT pr.id, pr.slice, round(least(exp((1 - brier - base) / 0.2), 5.0), 6) AS weight FROM pr JOIN b ON b.slice = pr.slice")
def awr_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.advantage_weights(rows_of(spark, sf_dir), "slice")


@query("""
WITH b AS (SELECT event_type, count(*) AS n, sum(CAST(value > 50 AS INT)) AS k FROM events GROUP BY 1), w AS (SELECT event_type, n, k, k / n AS p, greatest(0.0, (k / n + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(k / n * (1 - k / n) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n)) AS lb FROM b)
SELECT event_type, CAST(n AS BIGINT) AS runs, CAST(k AS BIGINT) AS successes, round(p, 6) AS rate, round(lb, 6) AS lower_bound, lb >= 0.3 AS accepted FROM w""")
def wilson_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wilson_routes(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, need=0.3)


@query(V + """, r AS (SELECT correct, row_number() OVER (ORDER BY floor(conf * 2000), round(conf, 12), id) AS rank FROM pr), rs AS (SELECT sum(correct) AS n1, sum(1 - correct) AS n0, sum(rank * correct) AS rs FROM r)
SELECT CAST(n1 AS BIGINT) AS positives, CAST(n0 AS BIGINT) AS negatives, round(coalesce((rs - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 0.0), 6) AS auroc FROM rs""")
def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_stats.auroc(rows_of(spark, sf_dir), [F.floor(F.col("conf") * 2000), F.round("conf", 12), F.col("id")])


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(max(n) AS BIGINT) AS n, round(median(value), 6) AS p50, round(max(value) FILTER (WHERE i = floor(0.95 * (n - 1))), 6) AS p95, round(avg(value), 6) AS mean FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_stats.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query(V + """, n AS (SELECT id, slice, floor(id % 2000 / 500) AS band, conf, correct, brier FROM pr), b AS (SELECT band, least(9, CAST(floor(conf * 10) AS INT)) AS bin, count(*) AS n, abs(avg(conf) - avg(correct)) AS gap FROM n GROUP BY ALL)
SELECT CAST(band AS BIGINT) AS band, round(sum(n * gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY band""")
def calibration_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir).withColumn("band", F.floor(F.col("id") % 2000 / 500))
    return M.calibration_error(rows, P.bin_floor(F.col("conf")), F.col("conf"), F.col("correct"), "band")


@query(V + ", a AS (SELECT slice, gold, count(*) AS k FROM pr GROUP BY ALL), tn AS (SELECT slice, sum(k) AS n FROM a GROUP BY 1) SELECT a.slice, gold, round((k + 1) / (n + 5), 6) AS prior FROM a JOIN tn ON tn.slice = a.slice")
def label_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    counts = rows.groupBy("slice", "gold").agg(F.count(F.lit(1)).alias("k"))
    total = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, "slice").select("slice", "gold", F.round((F.col("k") + 1) / (F.col("n") + 5), 6).alias("prior"))
