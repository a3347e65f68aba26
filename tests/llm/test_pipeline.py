"""The pipeline's stages on a small corpus with planted cases, and the registered queries' columns."""

import random

import pytest

import corpus_pipeline
from tallyframe.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(9)
    kinds = {"xx": ["thor", "anding", "whe", "ere"], "yy": ["ción", "ñada", "llo", "que"]}
    say = lambda k, n: " ".join(random.choice(kinds[k]) + random.choice(["", "a", "e", "o"]) + str(random.randint(0, 99)) for _ in range(n))
    rows, items = [], [(k, say("xx", 30)) for k in range(3)]
    for i in range(300):
        k = "xx" if i % 2 else "yy"
        rows.append((i, say(k, random.randint(30, 80)) + "\n" + say(k, 20), k, f"s{i % 3}", 0))
    rows += [(400, rows[7][1], "xx", "s1", 0), (401, None, "xx", "s0", 0), (402, "12 34 !!", None, None, 0), (403, say("xx", 20) + " " + items[1][1].upper() + ". " + say("xx", 20), "xx", "s2", 0)]
    rows += [(500 + i, say("xx", 40) + f"\nthis very same line stands in many documents\n{say('xx', 15)}", "xx", "s1", 0) for i in range(5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        if name != "mix":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = corpus_pipeline.stored(docs)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everything = {*range(300), *range(400, 404), *range(500, 505)}
    assert set(kept["language_id"]) == everything - {401, 402}
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    lines = [i for i in range(500, 505) if "very same line" in kept["line_dedup"][i].text]
    assert lines == [504] and kept["line_dedup"][500].n_chars == len(kept["line_dedup"][500].text)
    assert set(kept["language_id"]) - set(kept["near_dedup"]) == {400}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {403}
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and all(r.taken <= 3 * r.size for r in kept["mix"].values())
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, corpus).collect()} == {i: r.taken for i, r in kept["mix"].items()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, corpus, name):
    rows = queries.QUERIES[name](spark, corpus)
    # Four sources by 600 steps, three items by their best twenty; the others have a row a document.
    expected = {"op6_decontaminate": 1, "op11_filter_audit": 2400, "op13_lexical_search": 60}
    assert ("part" if name == "op11_filter_audit" else "doc_id") in rows.columns and rows.count() == expected.get(name, 309)
