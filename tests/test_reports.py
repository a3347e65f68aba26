"""Teacher and case reports against loops: missing grades and targets, null domains and cases, ties, empty tables."""

import math
import random
import statistics

import pytest

from tallyframe.operators import reports

RECORD = "id long, domain string, labels array<string>, target map<string,double>"


def test_teacher_scores(spark):
    random.seed(1)
    labels = ["x", "y", "z"]
    made = lambda: random.choice([None, {"x": 0.5, "y": 0.5}, {"z": 1.0}, {k: random.random() for k in random.sample(labels, 2)}, {"q": 1.0}, {}])
    records = [(k, random.choice([None, "a", "b"]), labels, made()) for k in range(200)] + [(900, "never", labels, None)]
    grades = {k: made() for k in range(0, 220)}
    got = {r.domain: r for r in reports.teacher_scores(spark.createDataFrame(records, RECORD), spark.createDataFrame(list(grades.items()), "id long, probs map<string,double>")).collect()}
    want = {}
    for k, domain, own, target in records:
        g = grades.get(k)
        if g is None or target is None:
            continue
        v = [g.get(x, 0.0) for x in own]
        p = [x / sum(v) for x in v] if sum(v) > 0 else [1 / 3] * 3
        t = [target.get(x, 0.0) for x in own]
        for d in (domain or "none", None):
            want.setdefault(d, []).append((sum((a - b) ** 2 for a, b in zip(p, t)), p.index(max(p)) == t.index(max(t))))
    assert set(got) == set(want)
    for d, rows in want.items():
        assert (got[d].n, got[d].soft_brier, got[d].agreement) == (len(rows), pytest.approx(sum(b for b, _ in rows) / len(rows), abs=1e-6), pytest.approx(sum(h for _, h in rows) / len(rows), abs=1e-6))
    assert got[None].coverage == pytest.approx(len(want[None]) / len(records), abs=1e-6) and got["a"].coverage is None
    none = reports.teacher_scores(spark.createDataFrame(records[:3], RECORD), spark.createDataFrame([], "id long, probs map<string,double>")).collect()
    assert [(r.domain, r.n, r.soft_brier, r.coverage) for r in none] == [(None, 0, None, 0.0)]


def test_case_scores(spark):
    rows = [("a", "x", "x", {"x": 0.7, "y": 0.3}), ("a", "y", "x", {"x": 1.0}), (None, "y", None, {"y": 0.25, "x": 0.75}), ("b", "x", "x", {"x": 1.0})]
    times = [("a", 5.0), ("a", 1.0), ("a", 9.0), ("a", 2.0), (None, 3.0), ("other", 1.0)]
    got = {r.case: r for r in reports.case_scores(spark.createDataFrame(rows, "case string, oracle string, selected string, probs map<string,double>"), spark.createDataFrame(times, "case string, ms double")).collect()}
    assert set(got) == {"a", "b", "none", None}
    a = got["a"]
    assert (a.questions, a.correct, a.p50, a.max, a.per_decision) == (2, 1, statistics.median([5, 1, 9, 2]), 9.0, 1.8)
    assert a.nll_mean == round((-math.log(0.7) - math.log(1e-12)) / 2, 4) and a.brier_mean == round((0.18 + 1.0) / 2, 4)
    assert (got["none"].correct, got["none"].p50, got["b"].p50, got["b"].nll_mean) == (0, 3.0, None, 0.0)
    assert (got[None].questions, got[None].correct, got[None].nll_mean) == (4, 2, round((a.nll_mean * 2 + got["none"].nll_mean) / 4, 4))
    empty = reports.case_scores(spark.createDataFrame([], "case string, oracle string, selected string, probs map<string,double>"), spark.createDataFrame(times, "case string, ms double"))
    assert empty.count() == 0
