"""Walks and leak scans over nested JSON made from events, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import json_walk as J
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query

#: An event as JSON, wrapped in up to four objects that hold an array each: places down to a depth of twelve.
_INNER = """'{"user": {"id": ' || CAST(user_id AS STRING) || ', "trail": [{"event": "' || event_type || '"}, [1.5, {"label": true}], null, {"' || CASE event_id % 7 WHEN 0 THEN 'gold_note' WHEN 1 THEN 'target' WHEN 2 THEN 'target_level' ELSE 'note' END || '": ["the ' || CASE event_id % 5 WHEN 0 THEN 'right answer' WHEN 1 THEN 'label source' WHEN 2 THEN 'oracle' ELSE 'day' END || ' is known", {}]}]}, "props": ' || props || '}'"""
NESTED = f"""repeat('{{"a": [', CAST(event_id % 5 AS INT)) || {_INNER} || repeat(']}}', CAST(event_id % 5 AS INT))"""
_TREE = f"""WITH e AS (SELECT event_id, CAST({NESTED} AS JSON) AS j FROM events),
t AS (SELECT e.event_id, t.fullkey AS path, CASE WHEN t.fullkey = '$' OR t.fullkey LIKE '%]' THEN NULL ELSE CAST(t.key AS VARCHAR) END AS name,
  CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS kind,
  CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE t.atom ->> '$' END AS value FROM e, json_tree(e.j) AS t)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{NESTED} AS j")


@query(f"{_TREE} SELECT event_id, path, name, kind, value FROM t")
def json_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.walk(nested(spark, sf_dir), "event_id", "j")


@query(f"""{_TREE} SELECT event_id, path, 'label_leak:gold_field_name:' || name AS code FROM t
WHERE name LIKE '%gold%' OR name LIKE '%label%' OR name = 'target' OR name = 'target_level'""")
def json_forbidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.forbidden_names(J.walk(nested(spark, sf_dir), "event_id", "j"), "event_id")


@query("""WITH e AS (SELECT event_id, event_type, CASE event_id % 7 WHEN 0 THEN 'gold_note' WHEN 1 THEN 'target' WHEN 2 THEN 'target_level' END AS bad, CASE event_id % 5 WHEN 0 THEN 'the_right_answer' WHEN 1 THEN 'label_source' WHEN 2 THEN 'oracle' END AS told FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(['label_leak:gold_field_name:label', CASE WHEN event_type IN ('click', 'signup') THEN 'label_leak:' || event_type END,
  'label_leak:gold_field_name:' || bad, 'label_leak:' || told], lambda x: x IS NOT NULL)), ',') AS codes FROM e""")
def pack_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack whose options are some event types: two of them and the generic wordings leak, `view` is in common use."""
    walked = J.walk(nested(spark, sf_dir), "event_id", "j")
    patterns = J.pack_patterns("events_v1.0", ["view", "click", "signup"], {"view"})
    return J.leak_codes(walked, "event_id", patterns).select("event_id", F.array_join("codes", ",").alias("codes"))
