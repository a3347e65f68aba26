"""Walks of nested JSON against recursion; runs that are published, killed, changed."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import json_walk as J
from tallyframe.sources import records, runs


def made(depth):
    pick = random.random()
    if depth == 0 or pick < 0.3:
        return random.choice([None, True, False, 7, -3, 12345678901, "text", "", "é \n x", "gold label"])
    if pick < 0.6:
        return [made(depth - 1) for _ in range(random.randrange(4))]
    return {random.choice(["a", "b", "note", "gold", "target", "intent", "x y", "is_truth"]) + random.choice(["", "1", ""]): made(depth - 1) for _ in range(random.randrange(4))}


def places(node, path="$", name=None):
    kind = {type(None): "null", bool: "boolean", int: "integer", str: "string", list: "array", dict: "object"}[type(node)]
    value = None if kind in ("null", "array", "object") else str(node).lower() if kind == "boolean" else str(node)
    yield path, name, kind, value
    if kind == "object":
        for k, v in node.items():
            yield from places(v, f"{path}.{k}", k)
    if kind == "array":
        for i, v in enumerate(node):
            yield from places(v, f"{path}[{i}]")


def test_walk_of_any_depth(spark):
    random.seed(1)
    nodes = [made(9) for _ in range(60)]
    deep = {"gold": 1}
    for k in range(25):
        deep = [deep] if k % 2 else {"a": deep, "b": k}
    nodes.append(deep)
    rows = [(k, json.dumps(n)) for k, n in enumerate(nodes)] + [(900, None), (901, "{bad"), (902, "")]
    walked = J.walk(spark.createDataFrame(rows, "id long, j string"), "id", "j").cache()
    got = sorted((tuple(r) for r in walked.collect()), key=repr)
    assert got == sorted(((k, *p) for k, n in enumerate(nodes) for p in places(n)), key=repr)
    named = {(r.id, r.path) for r in J.forbidden_names(walked, "id").collect()}
    wanted = {(k, p[0]) for k, n in enumerate(nodes) for p in places(n) if p[1] and (p[1].startswith(("gold", "is_truth")) or p[1] in ("target", "intent"))}
    assert named == wanted and any(p.count("[") + p.count(".") > 20 for _, p in named)


def test_leaks_with_an_allow_list(spark):
    rows = [(1, '{"note": "See the ORACLE of Delphi"}'), (2, '{"note": ["ask the oracle", {"x": "use-it or use it"}]}'), (3, '{"note": "nothing"}'), (4, None)]
    walked = J.walk(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    patterns = J.pack_patterns("gate_v1.0", ["use_it", "view"], {"view"})
    got = {r.id: r.codes for r in J.leak_codes(walked, "id", patterns, ["delphi"]).collect()}
    assert got == {2: ["label_leak:oracle", "label_leak:use_it"]}
    texts = spark.createDataFrame([(1, "x" * 30 + "the\nGold-label here" + "y" * 30), (2, None), (3, "")], "id long, t string")
    one = J.leak_matches(texts, "id", "t", list(J.LEAK_PATTERNS)).collect()
    assert [(r.id, r.match, len(r.context)) for r in one if r.match == "Gold-label"] == [(1, "Gold-label", 50)] and not any("\n" in r.context for r in one)
    assert spark.range(1).select(J.slug(F.lit("  The *Gold*  Label! ")).alias("s")).first().s == "the_gold_label"


def test_keys_are_sorted_at_every_depth(spark, tmp_path):
    schema = "z int, a struct<y:int, b:array<struct<q:int, c:string>>>, m map<string,int>"
    rows = spark.createDataFrame([(1, (2, [(3, "é")]), {"k2": 1, "k1": 2}), (None, None, None)], schema)
    records.write_jsonl(rows, str(tmp_path / "t"))
    lines = sorted(x for f in Path(tmp_path / "t").glob("part-*") for x in f.read_text().splitlines())
    assert lines == ['{"a":{"b":[{"c":"é","q":3}],"y":2},"m":{"k1":2,"k2":1},"z":1}', "{}"]


def run_of(spark, path):
    accepted = spark.createDataFrame([(str(k), ["train", "challenge"][k % 2], "t\nx" * k) for k in range(9)], "record_id string, split string, state string")
    rejected = spark.createDataFrame([("r1", ["a"])], "candidate_id string, reasons array<string>")
    empty = spark.createDataFrame([], "record_id string, n int")
    return runs.write_run(path, {"accepted": accepted, "rejected": rejected, "judged": empty}, {"seed": 3}, ("dry run",))


def test_manifest_agrees_with_files(spark, tmp_path):
    path = str(tmp_path / "run")
    made = [r.asDict() for r in run_of(spark, path).collect()]
    assert {r["table"]: r["rows"] for r in made if r["kind"] == "run"} == {"accepted": 9, "rejected": 1, "judged": 0}
    listed = [r for r in made if r["kind"] == "file"]
    for r in listed:
        file = Path(path, r["table"], f"split={r['split']}" if r["split"] else ".", r["file"])
        assert hashlib.sha256(file.read_bytes()).hexdigest() == r["sha256"] and file.stat().st_size == r["bytes"] and len(file.read_text().splitlines()) == r["rows"]
    assert sum(r["rows"] for r in listed if r["split"] == "train") == 5 and all(r["notes"] == ["dry run"] for r in made if r["kind"] == "run")
    assert {r.status for r in runs.verify(spark, path).collect()} == {"ok"}
    assert runs.read_table(spark, path, "accepted", "record_id string, split string, state string").where("split = 'challenge'").count() == 4
    assert sorted((r.table, r.split) for r in runs.inspect(spark, path, "4").collect()) == [("accepted", "train")]
    assert [r.table for r in runs.inspect(spark, path, "r1").collect()] == ["rejected"]
    with pytest.raises(Exception):
        run_of(spark, path)


def test_a_killed_run_is_not_complete(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    runs.write_table(spark.range(3), f"{path}/accepted")
    for read in (runs.manifest, runs.verify, lambda s, p: runs.read_table(s, p, "accepted", "id long"), lambda s, p: runs.inspect(s, p, "1")):
        with pytest.raises(runs.IncompleteRun):
            read(spark, path)
    # Files of an earlier attempt in the same folder are noticed before anything is published.
    kept = runs.write_table
    monkeypatch.setattr(runs, "write_table", lambda rows, p, split=None: kept(rows, p, split) + 1)
    with pytest.raises(runs.IncompleteRun):
        run_of(spark, str(tmp_path / "other"))
    with pytest.raises(runs.IncompleteRun):
        runs.manifest(spark, str(tmp_path / "other"))


def test_changes_are_seen(spark, tmp_path):
    path = str(tmp_path / "run")
    run_of(spark, path)
    file = next(Path(path, "rejected").glob("part-*.json"))
    gone = next(Path(path, "accepted").rglob("part-*.json"))
    for f in (file, gone):
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    file.write_text("{}\n")
    gone.unlink()
    Path(path, "rejected", "part-extra.json").write_text("{}\n")
    assert sorted(r.status for r in runs.verify(spark, path).collect() if r.status != "ok") == ["changed", "missing", "unlisted"]


def test_lineage_keeps_records_without_a_candidate(spark):
    own = spark.createDataFrame([("1", "p", "train", ("s", 3, "c", "h")), ("2", None, None, None)], "record_id string, task_pack string, split string, provenance struct<scenario_id:string,scenario_seed:bigint,source_code_commit:string,config_hash:string>")
    candidates = spark.createDataFrame([("1", "raw/1", 2)], "candidate_id string, raw_generation_path string, repair_attempt_count int")
    got = {r.record_id: (r.scenario_id, r.raw_generation_path, r.repair_attempt_count, r.surface_prompt_sha256) for r in runs.lineage(own, candidates, spark.createDataFrame([("p", "abc")], "task_pack string, surface_prompt_sha256 string")).collect()}
    assert got == {"1": ("s", "raw/1", 2, "abc"), "2": (None, None, None, None)}


def test_a_single_file_is_walked_by_many_tasks(spark, monkeypatch):
    written, kept = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df: written.append(kept(df)) or written[-1])
    rows = spark.range(200).coalesce(1).selectExpr("id", """'{"a": [{"b": 1}, "the oracle"]}' AS j""")
    walked = J.walk(rows, "id", "j")
    assert walked.count() == 1000 and len(written[0].inputFiles()) > 1 and written[0].where("p.node IS NOT NULL").count() == 0
    assert [(r.codes, r["count"]) for r in J.leak_codes(walked, "id").groupBy("codes").count().collect()] == [(["label_leak:oracle"], 200)]
