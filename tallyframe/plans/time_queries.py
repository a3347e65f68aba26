"""Queries over events whose times are told by several sources, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import event_times
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query

_ZONE = "CASE {0} % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/London' ELSE 'Asia/Tokyo' END"
_COLUMNS = ("event", "authority", "zone", "when", "date_only", "minutes", "anchor", "offset_days", "at", "stands")


def _source(event: str, authority: int, zone: str, when: str = "NULL", date_only: str = "false", minutes: str = "NULL", anchor: str = "NULL", days: str = "NULL", at: str = "NULL", stands: str = "true") -> str:
    values = (f"'{event}'", authority, zone, f"CAST({when} AS TIMESTAMP)", date_only, f"CAST({minutes} AS INT)", f"CAST({anchor} AS STRING)", f"CAST({days} AS INT)", f"CAST({at} AS STRING)", stands)
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(_COLUMNS, values)) + ")"


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a world: a kickoff told by up to three sources, a draft after it, a launch after that, a review by date.

    In some worlds better sources contradict each other, tell no time, or let launch and approval wait for each other.
    """
    z1, z2, day = _ZONE.format("o_custkey"), _ZONE.format("o_orderkey"), "CAST(o_orderdate AS DATE)"
    at = lambda d, t: f"concat(CAST(date_add({day}, {d}) AS STRING), ' {t}')"
    told = ", ".join([
        _source("kickoff", 1, z1, at(0, "09:00:00"), minutes="60"), _source("kickoff", 2, z1, at(1, "09:00:00"), minutes="60", stands="o_orderkey % 5 = 0"), _source("kickoff", 2, z1, at(2, "09:00:00"), minutes="60", stands="o_orderkey % 7 = 0"),
        _source("draft", 1, z1, anchor="'kickoff'", days="2", at="'10:00'", minutes="60"), _source("launch", 1, z2, anchor="'draft'", days="o_custkey % 4", at="'09:00'", minutes="120"),
        _source("launch", 3, z2, anchor="'approval'", days="1", at="'09:00'", stands="o_orderkey % 13 = 0"), _source("approval", 1, z2, anchor="'launch'", days="-1", at="'12:00'", stands="o_orderkey % 13 = 0"),
        _source("review", 1, z2, f"CASE WHEN o_orderkey % 11 > 0 THEN {at('CAST(o_orderkey % 8 AS INT)', '15:30:00')} END", date_only="true"),
    ])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("world"), F.explode(F.expr(f"array({told})")).alias("s"))
    return rows.select("world", "s.*").where("stands").drop("stands")


_TWIN = f"""WITH o AS (SELECT o_orderkey AS world, CAST(o_orderdate AS DATE) AS day, {_ZONE.format("o_custkey")} AS z1, {_ZONE.format("o_orderkey")} AS z2, o_custkey % 4 AS later, o_orderkey % 5 = 0 AS five, o_orderkey % 7 = 0 AS seven, o_orderkey % 11 > 0 AS dated, o_orderkey % 13 = 0 AS loop FROM orders),
k AS (SELECT *, five AND seven AS conflict, (CAST(day + CASE WHEN five THEN 1 WHEN seven THEN 2 ELSE 0 END AS TIMESTAMP) + INTERVAL 9 HOUR) AT TIME ZONE z1 AT TIME ZONE 'UTC' AS ks FROM o),
d AS (SELECT *, (CAST(CAST(ks AT TIME ZONE 'UTC' AT TIME ZONE z1 AS DATE) + 2 AS TIMESTAMP) + INTERVAL 10 HOUR) AT TIME ZONE z1 AT TIME ZONE 'UTC' AS ds FROM k),
l AS (SELECT *, CAST(CAST(ds AT TIME ZONE 'UTC' AT TIME ZONE z2 AS DATE) + CAST(later AS INTEGER) AS TIMESTAMP) + INTERVAL 9 HOUR AS ll, CAST(day + CAST(world % 8 AS INTEGER) AS TIMESTAMP) AS rl FROM d),
u AS (SELECT *, CASE WHEN loop THEN 'cyclic' WHEN conflict THEN 'unknown' ELSE 'known' END AS state, ll AT TIME ZONE z2 AT TIME ZONE 'UTC' AS ls, (ll + INTERVAL 120 MINUTE) AT TIME ZONE z2 AT TIME ZONE 'UTC' AS le,
  rl AT TIME ZONE z2 AT TIME ZONE 'UTC' AS rs, (rl + INTERVAL 1 DAY) AT TIME ZONE z2 AT TIME ZONE 'UTC' AS re FROM l)"""


@query(f"""{_TWIN} SELECT world, 'kickoff' AS event, CASE WHEN conflict THEN 'conflict' ELSE 'known' END AS state, CASE WHEN NOT conflict THEN CAST(epoch(ks) AS BIGINT) END AS start, CASE WHEN NOT conflict THEN CAST(epoch(ks) AS BIGINT) + 3600 END AS "end" FROM u
UNION ALL SELECT world, 'draft', CASE WHEN conflict THEN 'unknown' ELSE 'known' END, CASE WHEN NOT conflict THEN CAST(epoch(ds) AS BIGINT) END, CASE WHEN NOT conflict THEN CAST(epoch(ds) AS BIGINT) + 3600 END FROM u
UNION ALL SELECT world, 'launch', state, CASE WHEN state = 'known' THEN CAST(epoch(ls) AS BIGINT) END, CASE WHEN state = 'known' THEN CAST(epoch(le) AS BIGINT) END FROM u
UNION ALL SELECT world, 'approval', 'cyclic', NULL, NULL FROM u WHERE loop
UNION ALL SELECT world, 'review', CASE WHEN dated THEN 'known' ELSE 'unknown' END, CASE WHEN dated THEN CAST(epoch(rs) AS BIGINT) END, CASE WHEN dated THEN CAST(epoch(re) AS BIGINT) END FROM u""")
def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_times.event_intervals(sources_of(spark, sf_dir))
    return found.select("world", "event", "state", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"))


@query(f"""{_TWIN}, r AS (SELECT world, CASE WHEN NOT dated OR state <> 'known' THEN 'unknown' WHEN le <= rs THEN 'before' WHEN ls >= re THEN 'after' WHEN ls >= rs AND le <= re THEN 'during' ELSE 'unknown' END AS relation, NOT dated OR state <> 'known' AS missing FROM u)
SELECT world, relation, CASE relation WHEN 'before' THEN 'a_ends_before_b_starts' WHEN 'after' THEN 'a_starts_after_b_ends' WHEN 'during' THEN 'a_within_b' ELSE CASE WHEN missing THEN 'missing_or_underspecified_time' ELSE 'partial_overlap_or_underspecified' END END AS reason FROM r
UNION ALL SELECT world, 'conflicting', 'conflicting_timestamps' FROM u WHERE conflict""")
def temporal_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the launch relates to the review in each world, and the kickoff to the launch where its sources conflict."""
    found = event_times.event_intervals(sources_of(spark, sf_dir))
    worlds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("world"))
    asked = worlds.withColumns({"a": F.lit("launch"), "b": F.lit("review")}).unionByName(worlds.where("world % 35 = 0").withColumns({"a": F.lit("kickoff"), "b": F.lit("launch")}))
    return event_times.relations(asked, found).select("world", "relation", "reason")
