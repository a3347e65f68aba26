"""Validation, assembly and rule closure on small rows: nulls, ties, cycles, brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import agent_gates as G
from tallyframe.operators import assembly as A
from tallyframe.operators import inference
from tallyframe.operators import validation as V
from tallyframe.plans import dataset_queries


def test_codes_of_odd_records(spark):
    rows = spark.createDataFrame([(1, None), (2, "[1]"), (3, "{}"), (4, '{"a": null, "z": 1}'), (5, '{"a": 1}'), (6, '{"a": true}')], "id int, r string")
    got = {r.id: (list(r.c), list(r.i), r.v) for r in rows.select("id", V.strict_codes(F.col("r"), {"a": "integer"}).alias("c"), V.argument_issues(F.col("r"), ["a"], {"a": "integer"}).alias("i"), V.row_valid(F.col("r"), {"a": {"type": "integer", "required": True}}).alias("v")).collect()}
    assert got[1] == (["schema:unparseable"], ["malformed_json"], False)
    assert got[2][0] == ["schema:unparseable"] and not got[2][2]
    assert got[3] == (["schema:missing:a"], ["missing_required:a"], False)
    assert got[4] == (["schema:invalid:a", "schema:extra_field:z"], ["missing_required:a"], False)
    assert got[5] == ([], [], True)
    assert got[6] == (["schema:invalid:a"], ["wrong_type:a"], False)


def test_null_facts_hold_nothing(spark):
    none = F.lit(None).cast("boolean")
    row = spark.range(1).select(G.injection({"present": none, "quoted": none, "trusted": none, "side_effect": none, "approved": none, "target": F.lit(None).cast("string")}).alias("r"), G.manipulation(none).alias("m"), G.moderation(F.lit(None).cast("string")).alias("k")).first()
    assert (row.r.route, row.r.reason, row.m, row.k) == ("safe_data", "no_live_embedded_instruction", False, None)


def test_first_in_order_with_null_groups_and_ties(spark):
    random.seed(2)
    rows = [(k, random.choice([None, "a", "b"]), random.randrange(40)) for k in range(900)]
    quotas = spark.createDataFrame([(None, 37), ("a", 5), ("c", 9)], "g string, q int")
    got = A.first_in_order(spark.createDataFrame(rows, "id long, g string, v long"), ["g"], F.col("v"), "id", quotas, "q").collect()
    expected = {i for g, q in ((None, 37), ("a", 5)) for _, i in sorted((v, i) for i, h, v in rows if h == g)[:q]}
    assert {r.id for r in got} == expected and len(got) == len(expected)


def test_holdout_is_exact(spark):
    for n, share in ((0, 0.15), (3, 0.15), (101, 0.15), (40, 1.0)):
        got = A.holdout(spark.range(n), "id", "s", share).collect()
        assert len(got) == n and sum(r.held_out for r in got) == int(share * n)


def known_apart(spark):
    """A predicate called `not a` and the denial of `a` are two literals."""
    facts = spark.createDataFrame([(1, "not a", True, 2), (1, "a", False, 5)], "entity long, pred string, pos boolean, authority int")
    return inference.forward_chain(facts, [{"body": [("b", True)], "head": ("c", True)}]).first().known


def test_closure_against_a_loop(spark):
    random.seed(5)
    preds = "abcdef"
    literal = lambda: (random.choice(preds), random.random() < 0.7)
    rules = [{"body": [literal() for _ in range(random.choice([1, 2]))], "head": literal(), "unless": random.sample(preds, random.choice([0, 0, 1])), "quant": random.choice(["all", None, "some"])} for _ in range(12)]
    facts = [(e, p, pos, random.randint(1, 5)) for e in range(40) for p, pos in {literal() for _ in range(random.randint(0, 4))}]

    def slow(given):
        known = dict(given)
        live = [r for r in rules if r["quant"] != "some"]
        for part in ([r for r in live if not r["unless"]], live):
            before = None
            while before != known:
                before = dict(known)
                for r in part:
                    if all(b in known for b in r["body"]) and not any((u, True) in known for u in r["unless"]):
                        known[r["head"]] = max(known.get(r["head"], -1), min(known[b] for b in r["body"]))
        return known

    got = {r.entity: {(k.pred, k.pos): a for k, a in r.known.items()} for r in inference.forward_chain(spark.createDataFrame(facts, "entity long, pred string, pos boolean, authority int"), rules).collect()}
    assert len(known_apart(spark)) == 2
    by = {}
    for e, p, pos, a in facts:
        by.setdefault(e, {})[p, pos] = a
    assert got == {e: slow(g) for e, g in by.items()}


def test_contamination_needs_tokens(spark):
    docs = spark.createDataFrame([(1, "A  b-c."), (2, None), (3, "?!"), (4, "other")], "doc_id long, text string")
    items = spark.createDataFrame([("a b-c",), (None,), ("",)], "text string")
    assert [r.doc_id for r in A.exact_contamination(docs, items).collect()] == [1]


def test_signals_of_texts_without_tokens_equal_the_sql(spark, tmp_path):
    """doc 50 is known by its head, which has no token: texts without one, null or not, are then exact copies as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(50, "!" * 80 + " Some Words follow"), (1, None), (2, "?!"), (3, ""), (4, "one two"), (40, "One, two!"), (5, "three")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "four words of it")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = duck.sql(dataset_queries.ORACLES["contamination_signals"]).fetchall()
    got = dataset_queries.contamination_signals(spark, str(tmp_path)).select("signal", "rows").collect()
    assert sorted(map(tuple, got)) == sorted(expected) == [("any", 5), ("exact", 5)]


def test_buckets_that_come_out_differently_each_time(spark, monkeypatch):
    """Approximate percentiles follow the order in which parts arrive: rows must be dealt and counted by the same ones."""
    given = A.F.percentile_approx
    shifted = F.udf(lambda cuts: [c + random.randrange(-30, 30) for c in sorted(cuts)], "array<long>").asNondeterministic()
    monkeypatch.setattr(A.F, "percentile_approx", lambda *a: A.F.array_sort(shifted(given(*a))))
    rows = spark.range(2000).selectExpr("id", "id % 2 AS g", "pmod(hash(id), 700) AS v").repartition(5)
    quotas = spark.createDataFrame([(0, 400), (1, 1000)], "g long, q int")
    told = sorted((r.g, r.v, r.id) for r in rows.collect())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    expected = {i for g, q in ((0, 400), (1, 1000)) for _, _, i in [r for r in told if r[0] == g][:q]}
    try:
        assert sorted(r.id for r in A.first_in_order(rows, ["g"], F.col("v"), "id", quotas, "q").collect()) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
