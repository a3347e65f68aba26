"""Words and grams in one pass against the texts that they stand for; token sets of texts that no item's size fits."""

from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import similarity

ODD = [None, "", " ", "#", "a", "A1b2,3.c  d", "12,5 kg of x", ".5,", "É é ß İstanbul K", "tab\tnew\nline\r\x0bx", "a-b_c a b c d e f a b c d e", "1 2 3 4 5 6", "x 9.9.9y 7 z's"]


def test_words_and_grams_of_odd_texts(spark):
    c = F.col("text")
    grams = lambda w: F.transform(T.grams(w, 3), lambda g: g)
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select(
        T.text_words(c).alias("w"), T.words(T.normalize(c)).alias("w0"), T.text_words(c, digits=False).alias("s"), T.words(T.normalize(T.skeleton(c))).alias("s0"),
        F.size(T.gram_hashes(T.text_words(c), 3)).alias("n"), F.size(grams(T.words(T.normalize(c)))).alias("n0"),
    ).collect()
    assert all(r.w == r.w0 and r.s == r.s0 and r.n == r.n0 for r in rows)


def test_token_sets_are_kept_only_where_an_item_fits(spark, monkeypatch):
    kept = []
    given = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: kept.append(given(df)) or kept[-1])
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{k}" for k in range(500)) + " a b c d"), (3, None), (4, "a"), (5, "D c, b; a e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d"), (8, ""), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.jaccard for r in similarity.token_set_matches(docs, items, 0.5).collect()}
    assert got == {(1, 7): 0.75, (5, 7): 0.5}
    assert {r.doc_id for df in kept if "doc_id" in df.columns for r in df.collect()} == {1, 5}
    assert similarity.token_set_matches(docs, items.where("false"), 0.5).isEmpty()
