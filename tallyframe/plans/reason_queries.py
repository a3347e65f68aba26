"""Routes with their reasons, over facts of which each is null in some rows, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import agent_gates as G
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query


def _columns(facts: dict[str, str], rows: int) -> list[str]:
    """The facts as columns, each null in every `rows`-th event, another one each."""
    return [f"CASE WHEN event_id % {rows} = {k} THEN NULL ELSE {e} END AS {n}" for k, (n, e) in enumerate(facts.items())]


def _nullable(facts: dict[str, str], rows: int) -> str:
    return ", ".join(_columns(facts, rows))


def _no(*names: str) -> str:
    return " OR ".join(f"NOT coalesce({n}, false)" for n in names)


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", *columns)


def _verdict(rows: DataFrame, verdict, *more) -> DataFrame:
    return rows.select("event_id", verdict["route"].alias("route"), verdict["reason"].alias("reason"), *more)


def _split(cases: list[tuple[str, str, str]], route: str, reason: str) -> str:
    """CASE expressions of route and reason; reasons may be SQL expressions."""
    as_sql = lambda r: r if "||" in r else f"'{r}'"
    first = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases) + f" ELSE '{route}' END AS route"
    return first + ", CASE " + " ".join(f"WHEN {c} THEN {as_sql(w)}" for c, _, w in cases) + f" ELSE {as_sql(reason)} END AS reason"


_TOOL = {
    "available": "event_id % 11 <> 0", "alternative": "user_id % 2 = 0", "sensitive": "event_type = 'purchase'", "external": "event_id % 4 = 0", "traversal": "event_id % 31 = 0", "tenant": "user_id % 9",
    "session_tenant": "CASE WHEN event_id % 13 = 0 THEN 9 ELSE user_id % 9 END", "failed_before": "event_type = 'error'", "writes_outside": "event_id % 2 = 0", "approved": "event_id % 3 = 0",
}
_ISSUE = "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'wrong_type:limit' WHEN event_id % 19 = 0 THEN 'missing_required:path' ELSE '' END AS issue"


@query(f"""WITH f AS (SELECT event_id, {_nullable(_TOOL, 23)}, {_ISSUE} FROM events) SELECT event_id, {_split([
    ("(NOT coalesce(available, false)) AND alternative", "choose_alternative", "tool_unavailable_alternative_exists"), (_no("available"), "deny", "tool_unavailable_no_alternative"),
    ("sensitive AND external", "deny", "sensitive_data_exfiltration"), ("traversal", "deny", "path_traversal"), ("tenant IS NULL OR session_tenant IS NULL OR tenant <> session_tenant", "deny", "tenant_boundary_violation"),
    ("failed_before AND alternative", "choose_alternative", "unchanged_failing_retry_alternative"), ("failed_before", "repair_arguments", "unchanged_failing_retry_repair"),
    ("issue IS NULL OR issue <> ''", "repair_arguments", "'schema_invalid:' || coalesce(split_part(issue, ':', 1), 'unknown')"),
    ("writes_outside AND NOT coalesce(approved, false)", "require_confirmation", "external_side_effect_without_approval"), ("writes_outside", "allow", "external_side_effect_approved")],
    "allow", "valid_call_within_policy")} FROM f""")
def reason_tool_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, *_columns(_TOOL, 23), _ISSUE)
    issues = F.when(F.col("issue") == "", F.array().cast("array<string>")).when(F.col("issue").isNotNull(), F.array("issue"))
    return _verdict(rows, G.tool_action({**{n: F.col(n) for n in _TOOL}, "issues": issues}))


_RETRIEVAL = {
    "key_missing": "event_id % 10 = 0", "conflicting": "event_id % 12 = 1", "in_context": "user_id % 3 = 0", "context_date": "CAST(ts AS DATE)", "fresh": "event_id % 2 = 0", "public": "event_type = 'view'", "network": "user_id % 2 = 0",
    "covers": "user_id % 5 = 0", "modified": "CAST(ts AS DATE)", "mounted": "user_id % 4 < 3", "readable": "user_id % 4 < 2", "indexed": "user_id % 3 = 1",
}


@query(f"""WITH f AS (SELECT event_id, DATE '2024-02-15' AS today, {_nullable(_RETRIEVAL, 29)} FROM events),
o AS (SELECT *, NOT coalesce(fresh, false) OR coalesce(date_diff('day', context_date, today) <= 25, false) AS recent, covers AND (NOT coalesce(fresh, false) OR coalesce(date_diff('day', modified, today) <= 25, false)) AS usable FROM f)
SELECT event_id, {_split([
    ("key_missing", "ask_user", "identifier_missing_or_ambiguous"), ("conflicting", "ask_user", "conflicting_authoritative_local_sources"), ("in_context AND recent", "no_retrieval", "answer_in_current_context"),
    ("usable AND mounted AND readable", "read_local_context", "readable_mounted_file_covers_topic"), ("usable AND indexed", "search_local_index", "indexed_source_covers_topic"),
    ("public AND network", "search_web", "public_target_no_usable_local_source_web_available"), ("public", "ask_user", "public_target_network_disallowed")],
    "ask_user", "internal_target_no_accessible_source")} FROM o""")
def reason_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "DATE '2024-02-15' AS today", "25 AS max_age", *_columns(_RETRIEVAL, 29))
    return _verdict(rows, G.retrieval({**{n: F.col(n) for n in rows.columns}, "sources": F.array(F.struct("covers", "modified", "mounted", "readable", "indexed"))}))


_TERMINATION = {
    "input_missing": "event_id % 20 = 0", "error": "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'permanent_env' ELSE 'transient' END END", "retries": "user_id % 4", "budget": "2", "present": "event_id % 7 <> 0",
    "nonempty": "event_id % 9 <> 0", "schema_valid": "event_id % 11 <> 0", "tests_failed": "CASE WHEN user_id % 3 > 0 THEN user_id % 5 END", "conflict": "event_id % 13 = 0", "covered": "user_id % 6", "total": "4",
}


@query(f"""WITH f AS (SELECT event_id, {_nullable(_TERMINATION, 31)} FROM events) SELECT event_id, {_split([
    ("input_missing", "ask_user", "required_user_input_missing"), ("error = 'transient' AND retries < budget", "retry", "transient_failure_within_budget"), ("error = 'transient'", "escalate", "retry_budget_exhausted"),
    ("error = 'permanent_env'", "escalate", "permanent_environment_failure"), ("(NOT coalesce(present, false)) AND retries < budget", "retry", "artifact_absent_within_budget"), (_no("present"), "escalate", "artifact_absent_budget_exhausted"),
    (_no("nonempty", "schema_valid"), "repair", "artifact_empty_or_schema_invalid"), ("tests_failed > 0", "repair", "tests_failing"), ("conflict", "escalate", "conflicting_validation_signals"),
    ("covered IS NULL OR total IS NULL OR covered < total", "continue", "required_fields_missing")], "finish", "artifact_valid_and_complete")} FROM f""")
def reason_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, *_columns(_TERMINATION, 31))
    return _verdict(rows, G.termination({**{n: F.col(n) for n in _TERMINATION}, "exists": F.col("present")}))


_SUFFICIENCY = {
    "ambiguous": "event_id % 17 = 0", "contradicts": "event_id % 19 = 0", "conflicting": "user_id % 23 = 0", "unsupported": "event_id % 13 = 0", "citations_valid": "event_id % 11 <> 0", "format_ok": "event_id % 7 <> 0",
    "in_answer": "event_id % 2 = 0", "in_context": "user_id % 2 = 0", "owner": "CASE WHEN event_type = 'view' THEN 'user' ELSE 'system' END", "retrievable": "event_type = 'click'",
}


@query(f"""WITH f AS (SELECT event_id, {_nullable(_SUFFICIENCY, 37)} FROM events), m AS (SELECT *, NOT coalesce(in_answer, false) AS missing, NOT coalesce(in_answer, false) AND NOT coalesce(in_context, false) AS unknown FROM f)
SELECT event_id, {_split([
    ("ambiguous", "ask_user", "request_ambiguous"), ("contradicts OR conflicting", "escalate", "contradiction_with_or_between_authoritative_sources"), (f"unsupported OR {_no('citations_valid')}", "repair_from_context", "unsupported_claim_or_bad_citation"),
    ("missing AND NOT unknown", "repair_from_context", "missing_fact_available_in_context"), ("unknown AND owner = 'user'", "ask_user", "missing_fact_only_the_user_has"), ("unknown AND retrievable", "retrieve_more", "missing_fact_retrievable"),
    ("missing", "escalate", "missing_fact_unavailable"), (_no("format_ok"), "repair_from_context", "format_constraint_violated")], "return", "complete_supported_answer")} FROM m""")
def reason_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, *_columns(_SUFFICIENCY, 37))
    return _verdict(rows, G.sufficiency({**{n: F.col(n) for n in _SUFFICIENCY}, "facts": F.array(F.struct("in_answer", "in_context", "owner", "retrievable"))}))


_INJECTION = {
    "present": "event_id % 3 > 0", "quoted": "event_id % 7 = 0", "trusted": "user_id % 2 = 0", "side_effect": "event_type IN ('purchase', 'signup')", "approved": "event_id % 5 = 0",
    "target": "CASE event_type WHEN 'purchase' THEN 'exfiltration' WHEN 'error' THEN 'secret' WHEN 'view' THEN 'override' ELSE 'external_action' END",
}


@query(f"""WITH f AS (SELECT event_id, {_nullable(_INJECTION, 11)} FROM events) SELECT event_id, {_split([
    (f"{_no('present')} OR quoted", "safe_data", "no_live_embedded_instruction"), ("trusted AND side_effect AND NOT coalesce(approved, false)", "require_confirmation", "trusted_instruction_with_side_effect"),
    ("trusted", "safe_data", "trusted_legitimate_instruction"), ("target IN ('exfiltration', 'secret')", "block_and_escalate", "'untrusted_' || target || '_request'")],
    "ignore_untrusted_instruction", "'untrusted_' || coalesce(target, 'unknown') || '_instruction'")} FROM f""")
def reason_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(rows := _events(spark, sf_dir, *_columns(_INJECTION, 11)), G.injection({n: F.col(n) for n in rows.columns}))


_ACTS = tuple(G.INTENT_OF)
_ACT = "CASE {0} % 8 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_ACTS)) + " ELSE 'hums' END"
_MEANT = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{i}'" for a, i in G.INTENT_OF.items()) + " ELSE 'other' END"
_MESSAGE = {"a1": _ACT.format("event_id"), "q1": "event_id % 3 = 0", "a2": _ACT.format("user_id"), "q2": "user_id % 2 = 0", "prim": _ACT.format("(event_id % 2 * user_id + (1 - event_id % 2) * event_id)")}


@query(f"""WITH f AS (SELECT event_id, {_nullable(_MESSAGE, 43)}, CASE WHEN event_id % 9 = 0 THEN {_ACT.format("(event_id + 1)")} END AS alt FROM events),
l AS (SELECT *, CASE WHEN (NOT coalesce(q1, false) AND a1 = prim) OR (NOT coalesce(q2, false) AND a2 = prim) THEN prim WHEN NOT coalesce(q1, false) THEN a1 WHEN NOT coalesce(q2, false) THEN a2 END AS act FROM f),
m AS (SELECT *, {_MEANT.format("act")} AS meant, {_MEANT.format("alt")} AS other FROM l)
SELECT event_id, meant AS route, CASE WHEN alt IS NOT NULL THEN 'controlled_ambiguity_primary_policy' WHEN act IS NULL THEN 'no_live_communicative_act' WHEN act = prim THEN 'primary_act:' || act ELSE 'first_live_act:' || act END AS reason,
CASE WHEN alt IS NULL OR other = meant THEN meant ELSE meant || ',' || other END AS acceptable FROM m""")
def reason_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, *_columns(_MESSAGE, 43), f"CASE WHEN event_id % 9 = 0 THEN {_ACT.format('(event_id + 1)')} END AS alt")
    acts = F.array(*[F.struct(F.col(f"a{k}").alias("act"), F.col(f"q{k}").alias("quoted")) for k in (1, 2)])
    verdict = G.intent_verdict(acts, F.col("prim"), F.col("alt"))
    return _verdict(rows, verdict, F.array_join(verdict["acceptable"], ",").alias("acceptable"))
