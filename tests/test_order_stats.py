"""Ranks, places, batches and layers against loops: ties, nulls, all values equal, empty tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import layers, order_stats


def test_ranks_with_every_first_key_equal(spark):
    random.seed(1)
    for values in ([0.5] * 400, [random.choice([None, 0.1, 0.2, random.random()]) for _ in range(400)], []):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double").repartition(6)
        got = {r.id: r.rank for r in order_stats.ranked(rows, [F.col("v"), F.col("id")]).collect()}
        order = sorted(range(len(values)), key=lambda k: (values[k] is not None, values[k] or 0, k))
        assert got == {k: i + 1 for i, k in enumerate(order)}


def test_places_by_passes(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "PARTS", 4)
    random.seed(2)
    groups = {"a": [random.gauss(0, 1) for _ in range(300)], "b": [7.0] * 200, None: [random.choice([1.0, 2.0, 2.0, 1e300, -1e300, 1e-300]) for _ in range(150)], "c": [3.5], "d": [float(k) for k in range(64)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    places = order_stats.median_places() | {"p95": F.floor(F.lit(0.95) * (n - 1)), "first": F.lit(0), "last": n - 1, "out": n}
    got = {r.g: r for r in order_stats.order_statistics(frame, ["g"], "v", places).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, r = sorted(vs), got[g]
        assert (r.n, r["__low"], r["__high"], r.p95, r["first"], r["last"], r.out) == (len(s), s[(len(s) - 1) // 2], s[len(s) // 2], s[int(0.95 * (len(s) - 1))], s[0], s[-1], None)
    whole = order_stats.order_statistics(frame, [], "v", {"m": F.floor(n / 2)}).first()
    every = sorted(v for vs in groups.values() for v in vs)
    assert (whole.n, whole.m) == (len(every), every[len(every) // 2])
    assert order_stats.order_statistics(frame.where("v > 1e301"), ["g"], "v", places).count() == 0
    times = {r.g: r for r in order_stats.latency(frame.where("v IS NOT NULL"), "v", "g").collect()}
    assert times["a"].p50 == pytest.approx(statistics.median(groups["a"]), abs=1e-6) and times["b"].p95 == 7.0


def test_auroc_of_equal_confidences(spark):
    random.seed(3)
    for conf in (lambda: 0.5, random.random):
        rows = [(k, conf(), random.randint(0, 1)) for k in range(300)]
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        n1 = sum(r[2] for r in rows)
        area = (sum((i + 1) * r[2] for i, r in enumerate(order)) - n1 * (n1 + 1) / 2) / (n1 * (300 - n1))
        got = order_stats.auroc(spark.createDataFrame(rows, "id long, conf double, correct int"), [F.col("conf"), F.col("id")]).first()
        assert got.positives == n1 and got.auroc == pytest.approx(area, abs=1e-6)
        kept = {r.coverage: (r.kept, r.accuracy) for r in order_stats.selective_accuracy(spark.createDataFrame(rows, "id long, conf double, correct int"), [-F.col("conf"), F.col("id")], [0.001, 0.25, 1.0]).collect()}
        top = sorted(rows, key=lambda r: (-r[1], r[0]))
        assert kept == {c: (m, pytest.approx(sum(r[2] for r in top[:m]) / m, abs=1e-6)) for c, m in ((0.001, 1), (0.25, 75), (1.0, 300))}
    assert order_stats.auroc(spark.createDataFrame([(1, 0.2, 1)], "id long, conf double, correct int"), [F.col("conf"), F.col("id")]).first().auroc == 0.0


def loop(rows, budget):
    batches, batch = [], []
    for key, n in sorted(rows, key=lambda r: (r[1] or 0, r[0])):
        if batch and (len(batch) + 1) * (n or 0) > budget:
            batches.append(batch)
            batch = []
        batch.append(key)
    return batches + [batch] if batch else batches


def test_batches_are_those_of_the_loop(spark):
    random.seed(4)
    for budget, longest, n in ((100, 30, 500), (7, 20, 300), (1, 3, 40), (1000, 40, 200), (50, 1, 120), (64, 64, 0)):
        rows = [(k, random.choice([None, random.randint(0, longest), random.randint(1, longest)])) for k in range(n)]
        want = loop(rows, budget)
        for parts in (1, 7):
            got = order_stats.token_batches(spark.createDataFrame(rows, "key long, n int").repartition(parts), "n", "key", budget).collect()
            assert sorted((r.key, r.batch, r.place) for r in got) == sorted((k, b, p) for b, own in enumerate(want) for p, k in enumerate(own))
    for _ in range(300):  # the plan alone, against the loop
        budget, own = random.randint(1, 40), sorted(random.randint(0, 50) for _ in range(random.randint(1, 60)))
        counts, upto = {}, {}
        for x in own:
            counts[min(x, budget + 1)] = counts.get(min(x, budget + 1), 0) + 1
        plan, at = order_stats.batch_plan(counts, budget), []
        for x in own:
            batch, room, most = plan[min(x, budget + 1)]
            j = upto[min(x, budget + 1)] = upto.get(min(x, budget + 1), -1) + 1
            at.append(batch if j < room else batch + 1 + (j - room) // most)
        assert [at.count(b) for b in range(at[-1] + 1)] == [len(b) for b in loop(list(enumerate(own)), budget)]


def test_layers_against_a_loop(spark):
    random.seed(5)
    made = lambda: (lambda w: [x / sum(w) for x in w])([random.random() ** 4 for _ in range(4)])
    rows = [([made() for _ in range(12)], random.choice([0, 1, 2, 3, None])) for _ in range(80)] + [([], 1), (None, 2), ([[0.5, 0.5]], 0)]
    got = {(r.kind, r.k): r for r in layers.layer_probe(spark.createDataFrame(rows, "p array<array<double>>, gold int"), "p", "gold").collect()}
    live = [(p, g) for p, g in rows if p]
    best = lambda p: p.index(max(p))
    for k in range(12):
        own = [(p[k], g, p) for p, g in live if len(p) > k]
        assert got["layer", k].n == len(own) and got["layer", k].accuracy == pytest.approx(sum(best(x) == g for x, g, _ in own) / len(own), abs=1e-6)
        assert got["layer", k].extra == pytest.approx(sum(best(x) == best(p[-1]) for x, _, p in own) / len(own), abs=1e-6)
    for k in layers.LASTS:
        tails = [([sum(c) / len(p[-k:]) for c in zip(*p[-k:])], g) for p, g in live]
        assert got["last", k].mean_conf == pytest.approx(sum(max(x) for x, _ in tails) / len(tails), abs=1e-6)
        assert got["last", k].accuracy == pytest.approx(sum(best(x) == g for x, g in tails) / len(tails), abs=1e-6)
    flips = [(len({best(x) for x in p[-8:]}) - 1, best(p[-1]) == g) for p, g in live]
    for lo, hi in layers.BUCKETS:
        own = [c for f, c in flips if lo <= f <= hi]
        assert not own and ("flips", lo) not in got or (got["flips", lo].n, got["flips", lo].accuracy) == (len(own), pytest.approx(sum(own) / len(own), abs=1e-6))
    probe = spark.createDataFrame([("layer", k, a) for k, a in enumerate([0.1, 0.61, 0.596, 0.6])], "kind string, k int, accuracy double")
    assert tuple(layers.saturation(probe).first()) == (1, 0.6, 2)
