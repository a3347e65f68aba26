"""Operators without an SQL twin, against brute force, and functions at their edges."""

import json
import math
import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.functions import text as T
from tallyframe.operators import gates, inference, policy, predictions, rules, sampling, similarity, temporal
from tallyframe.sources import records
from tallyframe.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_near_pairs_and_greedy(spark):
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [random.choice(vocabulary) for _ in range(40)]
        for _ in range(3):
            own = list(base)
            for _ in range(random.randint(0, 2)):
                own[random.randrange(40)] = random.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["a b", "", None, "!!!"]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pack string")

    def cut(t):
        w = (t or "").replace("!", " ").split()
        return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = similarity.shingle_sets(docs, "pack")
    reps = sorted(r.rep for r in sets.collect())
    pairs = similarity.similar_pairs(sets, "pack", 0.6)
    expected = {(a, b) for a, b in combinations(reps, 2) if len(cut(texts[a]) & cut(texts[b])) / len(cut(texts[a]) | cut(texts[b])) >= 0.6}
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == expected and len(expected) > 10
    kept, keeper = [], {}
    for i in sorted(reps, key=lambda i: (-len(texts[i]), i)):
        near = [k for k in kept if tuple(sorted((i, k))) in expected]
        if near:
            keeper[i] = near[0]
        else:
            kept.append(i)
    nodes = docs.join(sets.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("id"), F.struct((-F.length("text")).alias("n"), F.col("doc_id").alias("i")).alias("rank"))
    got = {r.id: (r.status, r.keeper) for r in similarity.greedy_kept(nodes, pairs).collect()}
    assert got == {**{i: ("kept", None) for i in kept}, **{i: ("near_duplicate", k) for i, k in keeper.items()}}


def test_text_edges(spark):
    assert one(spark, T.normalize(F.lit("  Élan, VITAL!\n2  "))) == "lan vital 2" and one(spark, T.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, T.shingles(T.words(F.lit("")))) == [] and one(spark, T.shingles(T.words(F.lit("a b c d")))) == ["a b c d"]
    assert one(spark, T.grams(T.words(F.lit("a b c")), 8)) == [] and one(spark, T.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and one(spark, T.base_id(F.lit("x-p12"))) == "x"
    assert len(one(spark, T.truncate_middle(F.lit("x" * 13_000)))) > 12_000 and one(spark, T.squeeze_value(F.lit("$1, 200 USD"))) == "1200usd"


def test_probability_edges(spark):
    assert [one(spark, f(F.lit(0.1))) for f in (P.bin_floor, P.bin_right_closed, P.bin_left_closed)] == [1, 0, 1]
    assert [one(spark, f(F.lit(1.0))) for f in (P.bin_floor, P.bin_right_closed, P.bin_left_closed)] == [9, 9, 9]
    assert [one(spark, f(F.lit(0.3))) for f in (P.bin_floor, P.bin_left_closed)] == [3, 2]
    assert one(spark, P.normalized(F.array(F.lit(-1.0), F.lit(0.0)))) == [0.5, 0.5] and one(spark, P.argmax(F.array(F.lit(2.0), F.lit(2.0)))) == 0
    assert one(spark, P.band_levels(0.0, 1.0, 3)) == [0.0, 0.5, 1.0] and one(spark, P.wilson_lower(F.lit(0.0), F.lit(0.0), 1.645)) == 0
    assert one(spark, inference.abstain_shift(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))) == [0.2, 0.2, 0.1, 0.5]


def test_temperature_recovers_sharpening(spark):
    random.seed(7)
    rows = []
    for i in range(3000):
        z = [random.gauss(0, 1) for _ in range(3)]
        e = [math.exp(x) for x in z]
        gold = random.choices(range(3), e)[0]
        rows.append((i, [3 * x for x in z], gold, "a" if i else "few"))
    got = {r.kind: r.temperature for r in predictions.fit_temperature(spark.createDataFrame(rows, "id long, z array<double>, gold int, kind string"), "kind").collect()}
    assert 2.4 < got["a"] < 3.6 and got["few"] == 1.0


def test_sampling_probability_exact(spark):
    rows = [(lot, bad, n, k) for lot in (4, 9, 17) for bad in (0, 2, 4) for n in (1, 3, 4) for k in (1, 2)]
    table = spark.createDataFrame(rows, "lot long, bad long, n long, k long")
    for r in table.select("*", inference.hypergeometric_tail(*[F.col(c) for c in ("lot", "bad", "n", "k")], 20).alias("p")).collect():
        ways = [sum(x < r.bad for x in c) >= r.k for c in combinations(range(r.lot), r.n)]
        assert abs(float(Fraction(sum(ways), len(ways))) - r.p) < 1e-12


def test_holdout_and_hard_half(spark):
    rows = spark.createDataFrame([(f, l) for f in "abcdef" for l in ("x", "y")] + [("g", "z")], "family string, label string")
    held = {r.family for r in sampling.holdout_families(rows, "family", "label", "s").where("held_out").collect()}
    assert 1 <= len(held) <= 2 and "g" not in held
    rows = spark.createDataFrame([(i, i % 2, i / 20) for i in range(20)], "id long, correct int, conf double")
    got = sampling.hardest_and_random(rows, "id", 8, "s").collect()
    assert [r.id for r in got if r.why == "hard"] == [0, 2, 4, 6] and len({r.id for r in got}) == 8


def test_rules_edges(spark):
    assert one(spark, rules.next_action(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == "b" and one(spark, rules.next_action(F.array(F.lit("a")), F.array(F.lit("a")))) == "ask_user"
    skills = lambda *s: F.array(*[F.lit(x) for x in s]).cast("array<string>")
    assert one(spark, rules.recruiting(skills("py"), skills("sql", "go"), skills("py", "sql"), F.lit(6), F.lit(3))) == 3 and one(spark, rules.recruiting(skills("py"), skills(), skills(), F.lit(9), F.lit(1))) == 0
    assert one(spark, rules.rbac(skills("r"), skills("w"), F.lit("w"), F.lit(False), F.lit(True))) == "require_approval"
    mass = policy.action_mass(F.create_map(F.lit("readonly"), F.lit(0.7), F.lit("error"), F.lit(0.3)), {"readonly": "allow", "error": "ask", "privileged": "deny"})
    assert one(spark, mass) == {"allow": 0.7, "ask": 0.3, "deny": 0.0}


@pytest.mark.parametrize("command,expected", [("ls -la", "allow"), ("curl http://x", "ask"), ("cat /etc/shadow", "deny"), ("echo 'x", "ask"), ("rm -rf /tmp/x", "ask"), ("chmod 777 a", "deny"), ("x" * 9000, "ask")])
def test_policy_floor(spark, command, expected):
    assert one(spark, policy.floor(F.lit(command))) == expected


def test_gates(spark):
    assert one(spark, gates.anchors_missing(F.lit("It cost 1,200 EUR"), F.array(F.lit("1200"), F.lit("eur"), F.lit("usd")))) == ["usd"]
    assert one(spark, gates.flatten_json(F.lit('{"a": {"b": 1, "c": null}, "d": "x"}'))) == {"a.b": "1", "d": "x"}
    assert one(spark, gates.forbidden_keys(F.lit('{"a": {"label": 1}}'), "label")) == ["a.label"]
    assert one(spark, gates.fenced_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, gates.fenced_object(F.lit("[1]"))) is None
    assert [one(spark, gates.compare_facts(F.lit("A  b"), F.lit(g).cast("string"))) for g in ("a b", None, "c")] == ["matched", "unverifiable", "mismatched"]
    assert one(spark, gates.semantic_reasons(F.array(F.lit("a"), F.lit("b")), F.lit("c"), F.array(F.lit("a")))) == ["preferred_not_an_option", "preferred_not_acceptable"]
    rows = spark.createDataFrame([(i,) for i in range(10)], "id long")
    assert gates.judge_cap(rows, [F.col("id")], 0.25).where("judged").count() == 2


def test_calendar(spark):
    day = lambda s: F.to_date(F.lit(s))
    assert str(one(spark, temporal.add_business_days(day("2024-12-20"), 3, ["2024-12-25"]))) == "2024-12-26"
    assert str(one(spark, temporal.add_months_rolled(day("2024-01-31"), 1))) == "2024-03-01" and str(one(spark, temporal.add_months_rolled(day("2024-01-15"), 1))) == "2024-02-15"
    assert str(one(spark, temporal.to_utc(F.lit("2024-07-01 12:00:00").cast("timestamp"), F.lit("Europe/Paris")))) == "2024-07-01 10:00:00"


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([json.loads('{"record_id": "é", "split": "train"}')], "record_id string, split string")
    records.write_jsonl(rows, str(tmp_path / "j"))
    records.write_jsonl(rows, str(tmp_path / "j"), append=True)
    assert records.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    assert records.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and len(records.config_hash({"b": 1, "a": 2})) == 16
    with pytest.raises(ValueError):
        records.select_only(spark, "drop table x")
    with pytest.raises(ValueError):
        records.select_only(spark, "select 1; select 2")


def test_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Same text", "2024-01-01 00:00:00"), (2, "same TEXT!", "2024-01-01 00:01:00"), (3, "other", "2024-01-01 00:02:00")], "id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.dedup_within(streams.stream_of(spark, str(tmp_path / "in")), "ts", "1 hour")
    stream.select("id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 3 in got and len(got & {1, 2}) == 1
    counts = streams.windowed_counts(streams.stream_of(spark, str(tmp_path / "in")), "ts", "text", "10 minutes", "1 minute")
    assert counts.isStreaming and counts.columns == ["start", "text", "n"]


def test_null_groups_stay(spark):
    rows = [(k, "the very same text here again and more of it 9" if k % 2 else f"another text number {k} of the small book", [None, "en"][k % 3 == 0], k % 4 == 0) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, is_eval boolean")
    kept = similarity.dedup_exact(docs, "lang").collect()
    assert len(kept) == 24 and {r.keep_id for r in kept if r.lang is None and r.doc_id % 2} == {1}
    for table in (similarity.dedup_summary(docs, "lang"), similarity.phrase_coverage(docs, "lang"), similarity.boilerplate_share(docs, "lang")):
        assert {r.lang for r in table.collect()} == {None, "en"}
    assert sum(r.n_docs for r in similarity.dedup_summary(docs, "lang").collect()) == 24


def test_judge_cap_takes_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, None)], "id long, x string")
    got = gates.judge_cap(rows, [F.col("id")], 0.5).collect()
    assert len(got) == 4 and sum(r.judged for r in got) == 2


def test_texts_are_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = similarity.dedup_summary(docs, "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_candidates_are_about_as_many_as_pairs(spark, monkeypatch):
    """Texts of a few stock sentences share most shingles and are unlike; among them stand near copies, equal texts of two splits, short texts."""
    random.seed(5)
    stock = [" ".join(random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(2, 5) for _ in range(6)) for _ in range(150)]
    bodies = [random.sample(stock, 12) for _ in range(200)]
    for _ in range(20):
        near = [*bodies[random.randrange(200)]]
        near[random.randrange(12)] += " end"
        bodies.append(near)
    texts = [" ".join(b) for b in bodies] + [" ".join("xyzuvw"[i % 6] + str(i // (1 + k)) for i in range(9 + k)) for k in range(12)] + [" ".join(bodies[0])] * 2
    rows = [(i, t, None if i % 5 == 4 else "p", "test" if i % 3 == 0 else "train") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pack string, split string")

    def cut(t):
        w = t.split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}

    sets = [cut(t) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    written, kept = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: written.append(kept(df)) or written[-1])
    for apart in ((), (3,)):
        first = {}
        for r in rows:
            first.setdefault((r[1], r[2], *(r[k] for k in apart)), r[0])
        reps = sorted(first.values())
        for threshold in (0.9, 0.8):
            expected = {(a, b) for a, b in combinations(reps, 2) if rows[a][2] == rows[b][2] and not (apart and rows[a][3] == rows[b][3]) and like(a, b) >= threshold}
            got = similarity.cross_split_pairs(docs, "pack", threshold) if apart else similarity.similar_pairs(similarity.shingle_sets(docs, "pack"), "pack", threshold)
            found = [(r.id_a, r.id_b, r.jaccard) for r in got.collect()]
            assert {f[:2] for f in found} == expected and len(found) == len(expected) > 3
            assert all(math.isclose(j, like(a, b)) for a, b, j in found)
            asked = [df.count() for df in written if df.columns == ["row_a", "row_b"]]
            # Of 24,000 pairs; at 0.8 a part holds three shingles, which stock sentences share now and then.
            assert asked and asked[-1] <= (3 * len(expected) + 20 if threshold == 0.9 else 400)


def test_rounds_hold_linked_nodes_only(spark, monkeypatch):
    nodes = spark.range(50).select("id", F.col("id").alias("rank"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 12), (11, 12)], "id_a long, id_b long")
    written, kept = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: written.append(kept(df)) or written[-1])
    got = {r.id: (r.status, r.keeper) for r in similarity.greedy_kept(nodes, pairs).collect()}
    assert got == {**{i: ("kept", None) for i in range(50)}, 2: ("near_duplicate", 1), 4: ("near_duplicate", 3), 12: ("near_duplicate", 10)}
    assert max(df.count() for df in written) == 7


def test_a_large_group_of_copies_takes_few_rounds(spark, monkeypatch):
    """Dropped is who has an earlier kept neighbour, also while others are open; the keeper is still the first one in order."""
    nodes = spark.range(34).select("id", F.col("id").alias("rank"))
    linked = [*combinations(range(30), 2), (30, 31), (31, 32), (30, 33), (32, 33)]
    pairs = spark.createDataFrame(linked, "id_a long, id_b long")
    written, kept = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: written.append(df.columns) or kept(df))
    got = {r.id: (r.status, r.keeper) for r in similarity.greedy_kept(nodes, pairs).collect()}
    assert got == {0: ("kept", None), **{i: ("near_duplicate", 0) for i in range(1, 30)}, 30: ("kept", None), 31: ("near_duplicate", 30), 32: ("kept", None), 33: ("near_duplicate", 30)}
    assert sum("status" in columns for columns in written) <= 6


def test_sets_are_written_once_and_those_of_candidates(spark, monkeypatch):
    """Texts that share three quarters of their shingles meet in some part: bitmaps tell them apart, their sets aren't dealt."""
    random.seed(8)
    stock = [f"w{k}" for k in range(700)]
    texts = [" ".join([*stock, *(f"own{d}x{k}" for k in range(110))]) for d in range(30)]
    texts += [texts[0] + " more", texts[0] + " most"]
    docs = spark.createDataFrame([(i, t, "p", "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, pack string, split string")
    written, kept = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: written.append(kept(df)) or written[-1])
    got = {(r.id_a, r.id_b) for r in similarity.cross_split_pairs(docs, "pack", 0.9).collect()}
    assert got == {(0, 31), (30, 31)}
    met = [df.count() for df in written if df.columns == ["row_a", "row_b"]]
    assert met[0] > 100 and met[-1] == 2
    assert sorted(df.count() for df in written if "set" in df.columns) == [3, 32]
