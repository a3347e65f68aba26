"""Gates with every fact null, null groups in every operator that takes a group."""

from pyspark.sql import functions as F

from tallyframe.operators import agent_gates as G
from tallyframe.operators import inference, predictions, sampling, similarity
from tallyframe.operators import validation as V

#: Facts under which each gate lets a call, an answer or an artifact pass, as SQL.
PASSING = {
    "tool_action": ({"available": "true", "alternative": "false", "sensitive": "false", "external": "false", "traversal": "false", "tenant": "1", "session_tenant": "1", "failed_before": "false", "issues": "cast(array() AS array<string>)", "writes_outside": "true", "approved": "true"}, "allow"),
    "termination": ({"input_missing": "false", "error": "cast(NULL AS string)", "retries": "0", "budget": "2", "exists": "true", "nonempty": "true", "schema_valid": "true", "tests_failed": "0", "conflict": "false", "covered": "4", "total": "4"}, "finish"),
    "sufficiency": ({"ambiguous": "false", "contradicts": "false", "conflicting": "false", "unsupported": "false", "citations_valid": "true", "format_ok": "true", "facts": "array(struct(true AS in_answer, true AS in_context, 'user' AS owner, true AS retrievable))"}, "return"),
    "injection": ({"present": "true", "quoted": "false", "trusted": "true", "side_effect": "true", "approved": "true", "target": "'secret'"}, "safe_data"),
}
#: What must hold for a pass, with the route when it is not known.
NEEDED = {
    ("tool_action", "available"): "deny", ("tool_action", "tenant"): "deny", ("tool_action", "session_tenant"): "deny", ("tool_action", "issues"): "repair_arguments", ("tool_action", "approved"): "require_confirmation",
    ("termination", "exists"): "retry", ("termination", "nonempty"): "repair", ("termination", "schema_valid"): "repair", ("termination", "covered"): "continue", ("termination", "total"): "continue",
    ("sufficiency", "citations_valid"): "repair_from_context", ("sufficiency", "format_ok"): "repair_from_context", ("injection", "trusted"): "block_and_escalate", ("injection", "approved"): "require_confirmation",
}


def test_every_fact_null_one_by_one(spark):
    kinds = {"true": "boolean", "false": "boolean", "1": "int", "0": "int", "2": "int", "4": "int"}
    asked = {}
    for gate, (facts, route) in PASSING.items():
        for name, value in facts.items():
            kind = "array<string>" if name == "issues" else kinds.get(value, "string")
            unknown = value.replace("true AS in_context", "cast(NULL AS boolean) AS in_context") if name == "facts" else f"cast(NULL AS {kind})"
            asked[f"{gate}/{name}"] = (getattr(G, gate)({k: F.expr(v) for k, v in {**facts, name: unknown}.items()})["route"], NEEDED.get((gate, name), route))
    row = spark.range(1).select(*[c.alias(k) for k, (c, _) in asked.items()]).first()
    assert row.asDict() == {k: r for k, (_, r) in asked.items()}


def test_retrieval_knows_no_age(spark):
    source = "array(struct(true AS covers, cast(NULL AS date) AS modified, true AS mounted, true AS readable, true AS indexed))"
    facts = {"key_missing": "cast(NULL AS boolean)", "conflicting": "cast(NULL AS boolean)", "in_context": "true", "context_date": "cast(NULL AS date)", "today": "current_date()", "fresh": "true", "max_age": "3", "sources": source, "public": "cast(NULL AS boolean)", "network": "true"}
    routes = [G.retrieval({k: F.expr(v) for k, v in {**facts, **more}.items()})["route"] for more in ({}, {"fresh": "false"}, {"sources": f"CASE WHEN rand() > 1 THEN {source} END"})]
    assert tuple(spark.range(1).select(*[r.alias(f"r{k}") for k, r in enumerate(routes)]).first()) == ("ask_user", "no_retrieval", "ask_user")


def test_intents(spark):
    rows = spark.createDataFrame([(1, [("asks_question", False), ("gives_status", True)], "gives_status", None), (2, [("hums", False)], "hums", None), (3, [], "x", None), (4, [("gives_status", None)], "gives_status", "asks_question"), (5, None, None, None)], "id int, acts array<struct<act:string,quoted:boolean>>, prim string, alt string")
    got = {r.id: (r.v.route, r.v.reason, r.v.acceptable) for r in rows.select("id", G.intent_verdict(F.col("acts"), F.col("prim"), F.col("alt")).alias("v")).collect()}
    assert got[1] == ("request_information", "first_live_act:asks_question", ["request_information"]) and got[2] == ("other", "primary_act:hums", ["other"])
    assert got[3][:2] == ("other", "no_live_communicative_act") and got[4] == ("provide_update", "controlled_ambiguity_primary_policy", ["provide_update", "request_information"]) and got[5][0] == "other"


def test_formats_end_where_the_text_ends(spark):
    rows = spark.createDataFrame([(1, '{"e": "a@b.org\\n"}'), (2, '{"e": "a@b.org"}'), (3, '{"d": "2020-01-01\\n"}'), (4, '{"d": "2020-01-01"}')], "id int, r string")
    spec = {"e": {"type": "string", "format": "email"}, "d": {"type": "string", "format": "date"}}
    assert {r.id: r.v for r in rows.select("id", V.row_valid(F.col("r"), spec).alias("v")).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_only_top_texts_climb(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": "x/../y"}}'), (2, '{"a": ["../x"], "c": "ok"}'), (3, '{"a": "../x"}'), (4, "[1]"), (5, None), (6, '{"a": 7, "reasons": "/etc/x"}')], "id int, r string")
    assert {r.id: r.v for r in rows.select("id", V.path_traversal(F.col("r")).alias("v")).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_clean_keeps_own_columns(spark):
    rows = spark.createDataFrame([(1, "mine"), (2, None)], "id int, reasons string")
    codes = F.when(F.col("id") == 2, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    assert [tuple(r) for r in V.clean(rows, [codes]).collect()] == [(1, "mine")]


def test_null_groups_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", None, "train"), (2, "a b c d e f h", None, "dev"), (3, "a b c d e f g", None, "dev"), (4, "a b c d e f g", "x", "train")], "doc_id long, text string, pack string, split string")
    pairs = similarity.similar_pairs(similarity.shingle_sets(docs, "pack"), "pack", 0.5).collect()
    assert [(r.pack, r.id_a, r.id_b) for r in pairs] == [(None, 1, 2)]
    report = {r.pack: (r.splits, r.in_train, r.shared_keys) for r in similarity.isolation_report(docs, "pack").collect()}
    assert report == {None: (2, True, 1), "x": (1, True, 0)}
    assert {r.doc_id for r in sampling.label_quota(docs, "pack", "split", "doc_id", 2.0).collect()} == {1, 2, 3, 4}
    options = spark.createDataFrame([(1, None, 5.0), (2, None, 5.5), (3, "x", 1.0)], "id long, g string, total double")
    assert {r.id: r.p for r in inference.uniform_within(options, "g", "total", 1.0).collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    weights = inference.routing_weights(options, "g", "id", F.col("total")).collect()
    assert sorted((r.id, r.p) for r in weights) == [(1, 0.47619), (2, 0.52381), (3, 1.0)]
    rows = spark.createDataFrame([(1, None, 0.5), (2, None, 0.1), (3, "x", 0.3)], "id long, family string, brier double")
    assert {r.id for r in predictions.advantage_weights(rows, "family").collect()} == {1, 2, 3}
