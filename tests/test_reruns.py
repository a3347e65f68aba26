"""Rules run again on changed facts: nulls, repeats, extras that keep or change the label."""

from pyspark.sql import functions as F

from tallyframe.operators import reruns


def rule(features):
    """a, if there are a and b; c, if there is c without b; null for nothing at all."""
    has = lambda x: F.array_contains(features, x)
    return F.when(F.size(features) == 0, F.lit(None)).when(has("a") & has("b"), "ab").when(has("c") & ~has("b"), "c").otherwise("other")


def test_features_read_back(spark):
    rows = [(1, ["a", "b"], ["b", "a", "x"], "matched"), (2, ["a", "b"], ["b"], "features_present:missing_a"), (3, ["c"], ["c", "b"], "features_present:extra_features_change_class"), (4, [], [], "matched"), (5, None, None, "matched"),
            (6, None, ["x"], "features_present:extra_features_change_class"), (7, ["a", None, "a"], ["a", "a"], "matched"), (8, ["z", "y"], None, "features_present:missing_y")]
    got = spark.createDataFrame(rows, "id int, w array<string>, r array<string>, want string").select("id", "want", reruns.features_verdict(rule, F.col("w"), F.col("r")).alias("v")).collect()
    assert {r.id: r.v for r in got} == {r.id: r.want for r in got}


def test_extras_and_reproduction(spark):
    rows = spark.createDataFrame([(1, ["c"], "c"), (2, ["a", "b"], "other"), (3, None, None), (4, ["b"], None)], "id int, w array<string>, label string")
    extras = F.array(*[F.lit(x) for x in ("b", "a", "x")], F.lit(None))
    got = rows.select("id", reruns.preserving_extras(rule, F.col("w"), extras).alias("e"), reruns.reproduced(lambda w: rule(reruns.feature_set(w)), (F.col("w"),), F.col("label")).alias("p")).collect()
    assert {r.id: (r.e, r.p is None) for r in got} == {1: (["a", "x"], True), 2: (["x"], False), 3: ([], True), 4: (["x"], False)}
