"""Clients that fail: alone, together, always, with nonsense; the gate is closed where they do and nowhere else."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import scoring


def client(bad=lambda r: False, together=lambda rs: False, p=lambda r: {"readonly": 1.0}):
    calls = []

    def ask(rows):
        calls.append(len(rows))
        if together(rows) or any(map(bad, rows)):
            raise TimeoutError("x")
        return [p(r) for r in rows]

    return ask, calls


def test_a_failing_row_fails_alone():
    rows = [{"id": k} for k in range(20)]
    ask, _ = client(bad=lambda r: r["id"] % 10 == 3)
    got = scoring.answers(rows, ask, None, 1)
    assert [(p is None, e) for p, e, _ in got] == [(k % 10 == 3, "TimeoutError" if k % 10 == 3 else None) for k in range(20)]
    assert scoring.answers([], ask, None, 1) == []


def test_retries_and_the_fallback():
    rows = [{"id": k} for k in range(4)]
    ask, calls = client(together=lambda rs: len(calls) < 2)
    assert [(e, n) for _, e, n in scoring.answers(rows, ask, None, 1)] == [(None, 2)] * 4 and calls == [4, 4]
    ask, _ = client(bad=lambda r: r["id"] == 2)
    got = scoring.answers(rows, ask, lambda rs: [{"destructive": 1.0} for _ in rs], 1)
    assert [p for p, *_ in got] == [{"readonly": 1.0}] * 2 + [{"destructive": 1.0}] + [{"readonly": 1.0}] and got[2][2] == 5
    for nonsense in (lambda rs: [], lambda rs: [{}] * len(rs), lambda rs: [{"readonly": 7.0}] * len(rs), lambda rs: [{"readonly": float("nan")}] * len(rs), lambda rs: None, lambda rs: [{"readonly": "x"}] * len(rs)):
        assert all(p is None and e for p, e, _ in scoring.answers(rows, nonsense, None, 0))


def test_the_gate_is_closed_where_the_client_fails(spark):
    calls = spark.createDataFrame([(k, ["ls", "rm -r x", "cat /etc/shadow", None, "it's"][k % 5]) for k in range(50)], "id long, command string").repartition(3)

    def make():
        def ask(rows):
            if any(r["id"] % 10 == 0 for r in rows):
                raise ConnectionError
            return [{"readonly": 0.999, "privileged": 0.001} if r["id"] % 10 != 1 else {"exfiltration": 0.9, "readonly": 0.1} for r in rows]

        return ask

    got = {r.id: r for r in scoring.gated(scoring.scored(calls, make, together=7), "command").collect()}
    for k, r in got.items():
        floor = ["allow", "ask", "deny", "allow", "ask"][k % 5]
        if k % 10 == 0:
            assert (r.error, r.choice, r.action, r.probs) == ("ConnectionError", None, "ask", None) and "evaluator_error" in r.detections and "no_model:asked" in r.trace
        elif k % 10 == 1:
            assert (r.error, r.choice, r.action) == (None, "deny", "deny")
        else:
            assert (r.error, r.choice, r.action) == (None, "allow", floor) and "evaluator_error" not in r.detections
    assert len(got) == 50
    with pytest.raises(ValueError):
        scoring.scored(calls.withColumn("error", F.lit(1)), make)
    assert scoring.scored(calls.where("id > 99"), make).count() == 0


def test_labels_that_are_actions(spark):
    rows = spark.createDataFrame([(1, {"allow": 0.9, "deny": 0.1}, None, "ls"), (2, {"allow": 0.999}, None, "ls"), (3, {"maybe": 1.0}, None, "ls"), (4, None, None, "ls"), (5, {"ask": 0.5, "deny": 0.5}, None, "ls")], "id int, probs map<string,double>, error string, command string")
    got = {r.id: (r.choice, r.action) for r in scoring.gated(rows, "command", None).collect()}
    assert got == {1: ("allow", "ask"), 2: ("allow", "allow"), 3: ("maybe", "ask"), 4: (None, "ask"), 5: ("ask", "ask")}
