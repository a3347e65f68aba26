"""The registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from tallyframe.plans import audit_queries, dataset_queries, gate_queries, json_queries, metric_queries, reason_queries, report_queries, rerun_queries, rule_queries, scoring_queries, source_queries, stat_queries, text_queries, time_queries

_MODULES = (text_queries, metric_queries, rule_queries, source_queries, audit_queries, gate_queries, dataset_queries, reason_queries, json_queries, time_queries, stat_queries, scoring_queries, rerun_queries, report_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
