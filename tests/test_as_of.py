"""Revisions are dealt by key: however small Spark takes them for, they are not sent through the driver."""

from tallyframe.operators import temporal


def test_revisions_are_not_broadcast(spark):
    facts = spark.createDataFrame([(1, 5), (1, 0), (2, 9), (None, 3), (4, 1)], "k long, at int")
    revisions = spark.createDataFrame([(1, 1, 10.0), (1, 4, 40.0), (2, 10, 1.0), (4, 1, 7.0)], "k long, eff int, price double")
    out = temporal.as_of(facts, revisions, "k", "at", "eff", "price")
    assert {(r.k, r["at"]): r.price for r in out.collect()} == {(1, 5): 40.0, (1, 0): None, (2, 9): None, (None, 3): None, (4, 1): 7.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
