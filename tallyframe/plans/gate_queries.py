"""Validation and an agent's gates over facts read from events and orders, with their SQL twins.

Facts are expressions that both engines read alike; what follows from them is written once per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import agent_gates as G
from tallyframe.operators import validation as V
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


def facts(spark: SparkSession, sf_dir: str, name: str, *expressions: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*expressions)


def columns(*names: str) -> dict:
    return {n: F.col(n) for n in names}


#: A call's arguments as JSON: mostly well formed, with empty, null, climbing, mistyped and missing paths.
ARGS = (
    "CASE WHEN event_id % 23 = 0 THEN '{bad' WHEN event_id % 19 = 0 THEN '{\"meta\": ' || props || '}' ELSE '{\"path\": ' || CASE event_id % 9 WHEN 0 THEN '\"\"' WHEN 1 THEN 'null' WHEN 2 THEN '\"../x\"' "
    "WHEN 3 THEN '7' WHEN 4 THEN '\"/etc/hosts\"' ELSE '\"reports/' || CAST(event_id AS STRING) || '.txt\"' END || ', \"limit\": ' || CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '2.5' ELSE CAST(user_id AS STRING) END || ', \"meta\": ' || props || CASE WHEN event_id % 7 = 0 THEN ', \"note\": 1' ELSE '' END || '}' END"
)
_TYPE = "json_type(a, '$.{0}')"
_INT = "('UBIGINT', 'BIGINT')"
_CALL = f"WITH e AS (SELECT event_id, {ARGS} AS a FROM events), v AS (SELECT event_id, CASE WHEN json_valid(a) THEN a END AS a FROM e), t AS (SELECT event_id, a, {_TYPE.format('path')} AS tp, {_TYPE.format('limit')} AS tl, {_TYPE.format('meta')} AS tm, {_TYPE.format('note')} AS tn, a ->> '$.path' AS path FROM v)"
_ISSUES = f"CASE WHEN a IS NULL THEN 'malformed_json' ELSE concat_ws(',', CASE WHEN tp IS NULL OR tp = 'NULL' OR path = '' THEN 'missing_required:path' END, CASE WHEN tp NOT IN ('VARCHAR', 'NULL') THEN 'wrong_type:path' END, CASE WHEN tl NOT IN {_INT} AND tl <> 'NULL' THEN 'wrong_type:limit' END) END"
_CLIMBS = r"coalesce(regexp_matches(path, '\.\./|\.\.\\|^/etc/|^/root/|~/\.ssh'), false)"


def calls(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return facts(spark, sf_dir, "events", "event_id", f"{ARGS} AS args", *more)


def _issues():
    return V.argument_issues(F.col("args"), ["path"], {"path": "string", "limit": "integer"})


@query(f"{_CALL} SELECT event_id, {_ISSUES} AS issues, {_CLIMBS} AS climbs FROM t")
def argument_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("event_id", F.array_join(_issues(), ",").alias("issues"), V.path_traversal(F.col("args")).alias("climbs"))


_STRICT = f"""CASE WHEN a IS NULL THEN 'schema:unparseable' ELSE concat_ws(',', CASE WHEN tp IS NULL THEN 'schema:missing:path' WHEN tp <> 'VARCHAR' THEN 'schema:invalid:path' END,
CASE WHEN tl IS NULL THEN 'schema:missing:limit' WHEN tl NOT IN {_INT} THEN 'schema:invalid:limit' END, CASE WHEN tm IS NULL THEN 'schema:missing:meta' WHEN tm <> 'OBJECT' THEN 'schema:invalid:meta' END, CASE WHEN tn IS NOT NULL THEN 'schema:extra_field:note' END) END"""
_FIELDS = {"path": "string", "limit": "integer", "meta": "object"}


@query(f"{_CALL} SELECT event_id, {_STRICT} AS codes FROM t")
def strict_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("event_id", F.array_join(V.strict_codes(F.col("args"), _FIELDS), ",").alias("codes"))


@query(f"{_CALL} SELECT event_id FROM t WHERE {_STRICT} = '' AND {_ISSUES} = '' AND NOT {_CLIMBS}")
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass schema, policy and leak checks when they are run again."""
    leak = F.when(V.path_traversal(F.col("args")), F.array(F.lit("policy:path_traversal"))).otherwise(F.array().cast("array<string>"))
    return V.clean(calls(spark, sf_dir), [V.strict_codes(F.col("args"), _FIELDS), _issues(), leak]).select("event_id")


_NESTED = "'{\"k\": ' || CASE WHEN event_id % 6 = 0 THEN '\"x\"' ELSE CAST(user_id AS STRING) END || ', \"list\": [' || CASE event_id % 4 WHEN 0 THEN '1, \"a\"' WHEN 1 THEN 'true' WHEN 2 THEN '' ELSE '2.5, 3' END || ']' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', \"meta\": ' || CASE WHEN event_id % 10 = 1 THEN '[]' ELSE props END END || '}'"


@query(f"""WITH e AS (SELECT event_id, {_NESTED} AS a FROM events)
SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'required:meta' END, CASE WHEN event_id % 6 = 0 THEN 'k.type:integer' END, CASE event_id % 4 WHEN 0 THEN 'list.[1].type:integer' WHEN 3 THEN 'list.[0].type:integer' END, CASE WHEN event_id % 10 = 1 THEN 'meta.type:object' END) AS errors FROM e""")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "required": ["k", "meta"], "properties": {"k": {"type": "integer"}, "list": {"type": "array", "items": {"type": "integer"}}, "meta": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}}}}}
    rows = facts(spark, sf_dir, "events", "event_id", f"{_NESTED} AS a")
    return rows.select("event_id", F.array_join(V.schema_errors(F.try_parse_json("a"), schema), ",").alias("errors"))


_ROW = (
    "'{\"price\": ' || CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 11 = 0 THEN '\"9\"' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END || ', \"status\": \"' || o_orderstatus || '\", \"email\": \"' || CASE o_orderkey % 5 WHEN 0 THEN 'a b@c.org' WHEN 1 THEN 'x@y' ELSE 'c@d.org' END "
    "|| '\", \"start_date\": \"1996-01-15\", \"end_date\": \"' || CASE WHEN o_orderkey % 7 = 0 THEN '1995-12-31' WHEN o_orderkey % 17 = 0 THEN '96-2-1' ELSE '1996-02-01' END || '\"}'"
)


@query("""SELECT o_orderkey, o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND CAST(o_totalprice AS BIGINT) BETWEEN 1000 AND 300000 AND o_orderstatus IN ('F', 'O') AND o_orderkey % 5 > 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 17 <> 0 AS valid FROM orders""")
def row_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"price": {"type": "integer", "required": True, "min": 1000, "max": 300_000}, "status": {"type": "string", "enum": ["F", "O"]}, "email": {"type": "string", "format": "email"}, "end_date": {"type": "string", "format": "date"}, "remark": {"type": "string"}}
    return facts(spark, sf_dir, "orders", "o_orderkey", f"{_ROW} AS r").select("o_orderkey", V.row_valid(F.col("r"), spec).alias("valid"))


_TOOL = ("event_id % 11 <> 0 AS available", "user_id % 2 = 0 AS alternative", "event_type = 'purchase' AS sensitive", "event_id % 4 = 0 AS external", "user_id % 9 AS tenant", "CASE WHEN event_id % 13 = 0 THEN 9 ELSE user_id % 9 END AS session_tenant", "event_type = 'error' AS failed_before", "event_id % 2 = 0 AS writes_outside", "event_id % 3 = 0 AS approved")


@query(f"""{_CALL}, f AS (SELECT event_id, {", ".join(_TOOL)} FROM events), x AS (SELECT f.*, {_ISSUES} AS issues, {_CLIMBS} AS climbs FROM f JOIN t USING (event_id))
SELECT event_id, CASE WHEN NOT available AND alternative THEN 'choose_alternative' WHEN NOT available THEN 'deny' WHEN sensitive AND external THEN 'deny' WHEN climbs THEN 'deny' WHEN tenant <> session_tenant THEN 'deny'
WHEN failed_before AND alternative THEN 'choose_alternative' WHEN failed_before THEN 'repair_arguments' WHEN issues <> '' THEN 'repair_arguments' WHEN writes_outside AND NOT approved THEN 'require_confirmation' ELSE 'allow' END AS route FROM x""")
def gate_tool_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = columns("available", "alternative", "sensitive", "external", "tenant", "session_tenant", "failed_before", "writes_outside", "approved")
    return calls(spark, sf_dir, *_TOOL).select("event_id", G.tool_action({**f, "traversal": V.path_traversal(F.col("args")), "issues": _issues()})["route"].alias("route"))


_RETRIEVAL = ("event_id % 10 = 0 AS key_missing", "event_id % 12 = 1 AS conflicting", "user_id % 3 = 0 AS in_context", "CAST(ts AS DATE) AS context_date", "DATE '2024-02-15' AS today", "event_id % 2 = 0 AS fresh", "25 AS max_age", "event_type = 'view' AS public", "user_id % 2 = 0 AS network")


@query(f"""WITH f AS (SELECT event_id, user_id, {", ".join(_RETRIEVAL)} FROM events), o AS (SELECT *, NOT fresh OR date_diff('day', context_date, today) <= max_age AS recent FROM f)
SELECT event_id, CASE WHEN key_missing OR conflicting THEN 'ask_user' WHEN in_context AND recent THEN 'no_retrieval' WHEN user_id % 5 = 0 AND recent AND user_id % 4 < 2 THEN 'read_local_context'
WHEN (user_id % 5 = 0 AND recent AND user_id % 3 = 1) OR (user_id % 7 = 0 AND NOT fresh) THEN 'search_local_index' WHEN public AND network THEN 'search_web' ELSE 'ask_user' END AS route FROM o""")
def gate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source as old as the context and one of the year before, which only serves where freshness doesn't matter."""
    sources = "array(struct(user_id % 5 = 0 AS covers, CAST(ts AS DATE) AS modified, user_id % 4 < 3 AS mounted, user_id % 4 < 2 AS readable, user_id % 3 = 1 AS indexed), struct(user_id % 7 = 0 AS covers, DATE '2023-01-01' AS modified, false AS mounted, true AS readable, true AS indexed)) AS sources"
    rows = facts(spark, sf_dir, "events", "event_id", *_RETRIEVAL, sources)
    return rows.select("event_id", G.retrieval(columns(*rows.columns))["route"].alias("route"))


_TERMINATION = ("event_id % 20 = 0 AS input_missing", "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'permanent_env' ELSE 'transient' END END AS error", "user_id % 4 AS retries", "2 AS budget", "event_id % 7 <> 0 AS exists", "event_id % 9 <> 0 AS nonempty", "event_id % 11 <> 0 AS schema_valid", "CASE WHEN user_id % 3 > 0 THEN user_id % 5 END AS tests_failed", "event_id % 13 = 0 AS conflict", "user_id % 6 AS covered", "3 AS total")


@query(f"""WITH f AS (SELECT event_id, {", ".join(_TERMINATION)} FROM events) SELECT event_id, CASE WHEN input_missing THEN 'ask_user' WHEN error = 'transient' AND retries < budget THEN 'retry' WHEN error = 'transient' THEN 'escalate' WHEN error = 'permanent_env' THEN 'escalate'
WHEN NOT "exists" AND retries < budget THEN 'retry' WHEN NOT "exists" THEN 'escalate' WHEN NOT nonempty THEN 'repair' WHEN NOT schema_valid THEN 'repair' WHEN tests_failed > 0 THEN 'repair' WHEN conflict THEN 'escalate' WHEN covered < total THEN 'continue' ELSE 'finish' END AS route FROM f""".replace("AS exists", 'AS "exists"'))
def gate_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir, "events", "event_id", *_TERMINATION)
    return rows.select("event_id", G.termination(columns(*rows.columns))["route"].alias("route"))


_SUFFICIENCY = ("event_id % 17 = 0 AS ambiguous", "event_id % 19 = 0 AS contradicts", "user_id % 23 = 0 AS conflicting", "event_id % 13 = 0 AS unsupported", "event_id % 11 <> 0 AS citations_valid", "event_id % 7 <> 0 AS format_ok")
_FACT = ("event_id % 2 = 0", "user_id % 2 = 0", "event_type = 'view'", "event_type = 'click'"), ("event_id % 3 > 0", "user_id % 3 > 0", "event_type = 'signup'", "event_type <> 'error'")


@query(f"""WITH f AS (SELECT event_id, {", ".join(_SUFFICIENCY)}, NOT ({_FACT[0][0]}) AS m1, NOT ({_FACT[1][0]}) AS m2, {_FACT[0][1]} AS c1, {_FACT[1][1]} AS c2, {_FACT[0][2]} AS u1, {_FACT[1][2]} AS u2, {_FACT[0][3]} AS r1, {_FACT[1][3]} AS r2 FROM events)
SELECT event_id, CASE WHEN ambiguous THEN 'ask_user' WHEN contradicts OR conflicting THEN 'escalate' WHEN unsupported OR NOT citations_valid THEN 'repair_from_context' WHEN (m1 OR m2) AND (NOT m1 OR c1) AND (NOT m2 OR c2) THEN 'repair_from_context'
WHEN (m1 AND NOT c1 AND u1) OR (m2 AND NOT c2 AND u2) THEN 'ask_user' WHEN (m1 AND NOT c1 AND r1) OR (m2 AND NOT c2 AND r2) THEN 'retrieve_more' WHEN m1 OR m2 THEN 'escalate' WHEN NOT format_ok THEN 'repair_from_context' ELSE 'return' END AS route FROM f""")
def gate_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ", ".join(f"struct({a} AS in_answer, {c} AS in_context, CASE WHEN {u} THEN 'user' ELSE 'system' END AS owner, {r} AS retrievable)" for a, c, u, r in _FACT)
    rows = facts(spark, sf_dir, "events", "event_id", *_SUFFICIENCY, f"array({needed}) AS facts")
    return rows.select("event_id", G.sufficiency(columns(*rows.columns))["route"].alias("route"))


_INJECTION = ("event_id % 3 > 0 AS present", "event_id % 7 = 0 AS quoted", "user_id % 2 = 0 AS trusted", "event_type IN ('purchase', 'signup') AS side_effect", "event_id % 5 = 0 AS approved", "CASE event_type WHEN 'purchase' THEN 'exfiltration' WHEN 'error' THEN 'secret' ELSE 'tool_use' END AS target")


@query(f"""WITH f AS (SELECT event_id, {", ".join(_INJECTION)} FROM events) SELECT event_id, CASE WHEN NOT present OR quoted THEN 'safe_data' WHEN trusted AND side_effect AND NOT approved THEN 'require_confirmation' WHEN trusted THEN 'safe_data'
WHEN target = 'tool_use' THEN 'ignore_untrusted_instruction' ELSE 'block_and_escalate' END AS route FROM f""")
def gate_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir, "events", "event_id", *_INJECTION)
    return rows.select("event_id", G.injection(columns(*rows.columns))["route"].alias("route"))


_KINDS = ("clean_neutral", "clean_heated", "clean_profanity_no_target", "spam", "harassment_mild", "harassment_severe", "scam_mild", "scam_severe", "self_harm_signal", "other")
_KIND = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS kind"


@query(f"""WITH f AS (SELECT event_id, {_KIND}, CASE WHEN event_type = 'error' THEN NULL ELSE event_type = 'purchase' END AS attack FROM events) SELECT event_id, coalesce(attack, false) AS manipulation,
CASE WHEN kind LIKE 'clean%' THEN 'allow' WHEN kind = 'spam' OR kind LIKE '%mild' THEN 'hide' WHEN kind LIKE '%severe' THEN 'timeout' WHEN kind LIKE 'self%' THEN 'escalate' END AS action FROM f""")
def gate_moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir, "events", "event_id", _KIND, "CASE WHEN event_type = 'error' THEN NULL ELSE event_type = 'purchase' END AS attack")
    return rows.select("event_id", G.manipulation(F.col("attack")).alias("manipulation"), G.moderation(F.col("kind")).alias("action"))


@query("""WITH f AS (SELECT event_id, event_type AS a1, event_id % 3 = 0 AS q1, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'error' END AS a2, event_id % 5 = 0 AS q2, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS prim FROM events)
SELECT event_id, CASE WHEN NOT q1 AND a1 = prim THEN a1 WHEN NOT q2 AND a2 = prim THEN a2 WHEN NOT q1 THEN a1 WHEN NOT q2 THEN a2 ELSE 'other' END AS intent FROM f""")
def communication_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = "array(struct(event_type AS act, event_id % 3 = 0 AS quoted), struct(CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'error' END AS act, event_id % 5 = 0 AS quoted)) AS acts"
    rows = facts(spark, sf_dir, "events", "event_id", acts, "CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS prim")
    return rows.select("event_id", G.intent(F.col("acts"), F.col("prim")).alias("intent"))


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 8 <> 0 AS same_entity, o_orderkey % 9 <> 0 AS same_period, o_orderkey % 2 = 0 AS has_fee, o_orderkey % 3 > 0 AS has_due, o_orderstatus AS fee, o_custkey % 3 AS authority FROM orders)
SELECT o_orderkey, CASE WHEN NOT same_entity OR NOT same_period THEN 'irrelevant' WHEN has_fee AND fee <> 'F' AND authority <= 1 THEN 'conflicting' WHEN has_fee AND has_due THEN 'directly_relevant' WHEN has_fee OR has_due THEN 'partially_relevant' ELSE 'irrelevant' END AS verdict FROM f""")
def document_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query asks for fee and due of an entity and period; a note of authority 1 says that the fee is F."""
    rows = facts(
        spark, sf_dir, "orders", "o_orderkey", "CASE WHEN o_custkey % 8 = 0 THEN 'b' ELSE 'a' END AS entity", "'a' AS asked_entity", "CASE WHEN o_orderkey % 9 = 0 THEN 'q2' ELSE 'q1' END AS period", "'q1' AS asked_period",
        "map_from_entries(filter(array(CASE WHEN o_orderkey % 2 = 0 THEN struct('fee' AS a, o_orderstatus AS b) END, CASE WHEN o_orderkey % 3 > 0 THEN struct('due' AS a, o_orderpriority AS b) END), x -> x IS NOT NULL)) AS covers",
        "array('fee', 'due') AS asked", "o_custkey % 3 AS authority", "array(struct('fee' AS attribute, 'F' AS value, 1 AS authority)) AS notes",
    )
    return rows.select("o_orderkey", G.relevance(columns(*rows.columns))["route"].alias("verdict"))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS amb, o_orderkey % 4 = 0 AS wrong, o_orderkey % 7 = 0 AS extra, o_orderkey % 5 = 0 AS empty FROM orders)
SELECT o_orderkey, CASE WHEN amb THEN 'ambiguous' WHEN wrong OR extra THEN 'incorrect' WHEN empty THEN 'incomplete' ELSE 'correct' END AS verdict,
CASE WHEN amb THEN 'source_ambiguous:total' WHEN extra THEN 'unsupported_field:iban' WHEN wrong THEN 'value_mismatch:total' WHEN empty THEN 'missing_required:due' ELSE 'all_required_fields_match_source' END AS reason FROM f""")
def extraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values match if they agree without blanks, commas, dollar signs and case."""
    rows = facts(
        spark, sf_dir, "orders", "o_orderkey", "map('total', concat('$', cast(o_orderkey AS string)), 'status', o_orderstatus, 'due', '') AS source", "CASE WHEN o_orderkey % 9 = 0 THEN 'total' END AS amb",
        "map_concat(map('total', concat(cast(o_orderkey AS string), CASE WHEN o_orderkey % 4 = 0 THEN '9' ELSE '' END), 'status', concat(' ', lower(o_orderstatus))), CASE WHEN o_orderkey % 7 = 0 THEN map('iban', 'x') ELSE map('status2', 'x') END) AS p",
    ).withColumn("p", F.map_filter("p", lambda k, _: k != "status2"))
    due = F.when(F.col("o_orderkey") % 5 == 0, F.col("p")).otherwise(F.map_concat("p", F.create_map(F.lit("due"), F.lit(" "))))
    verdict, reason = G.extraction(F.col("source"), due, ["total", "due"], F.col("amb"))
    return rows.select("o_orderkey", verdict.alias("verdict"), reason.alias("reason"))


@query("""WITH f AS (SELECT event_id, event_type AS choice, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE 'view' END AS gold, event_id % 4 = 0 AS hint, event_id % 2 = 0 AS alt, event_id % 10 = 0 AS challenge FROM events),
r AS (SELECT *, CASE WHEN choice = 'error' THEN 'supportability:invalid_choice' WHEN choice <> gold THEN 'supportability:solver_disagrees:' || choice END AS a, CASE WHEN alt THEN 'supportability:alt_valid:' || CASE WHEN gold = 'click' THEN 'purchase,view' ELSE 'click,purchase' END END AS b, CASE WHEN hint THEN 'supportability:label_hint' END AS c FROM f)
SELECT event_id, concat_ws(';', a, b, c) AS reasons, a IS NOT NULL AND NOT challenge AS rejected FROM r""")
def supportability(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("user_id") % 3 == 0, "click").otherwise("view")
    also = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("view"), F.lit("purchase"), F.lit("click"), F.lit("error"))).otherwise(F.array().cast("array<string>"))
    options = F.array(*[F.lit(o) for o in ("view", "click", "signup", "purchase")])
    reasons = G.support_reasons(F.col("event_type"), also, options, F.array(gold), F.col("event_id") % 4 == 0)
    rows = table(spark, sf_dir, "events").select("event_id", reasons.alias("r"))
    return rows.select("event_id", F.array_join("r", ";").alias("reasons"), G.unsupported(F.col("r"), F.col("event_id") % 10 == 0).alias("rejected"))
