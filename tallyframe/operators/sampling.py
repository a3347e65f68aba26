"""Splits, caps, quotas, mixtures and permutations, all in the order of a stable hash."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.functions.joins import join_null_safe


def first_by_hash(rows: DataFrame, group: str, key: str, seed: str, most: int) -> DataFrame:
    """At most `most` rows of each group, in the order of the key's hash; the limit is pushed before the shuffle."""
    order = Window.partitionBy(group).orderBy(T.hash_hex(F.lit(seed), F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def diversity_cap(docs: DataFrame, pack: str, easy: Column, ratio: float = 0.6) -> DataFrame:
    """pack, n, easy, cap, kept_easy. No-op for fewer than 20 rows or less than a quarter of rows that aren't easy;
    else easy rows are capped at max(int(r rest / (1 - r)), int(r n / 2))."""
    by = docs.groupBy(pack).agg(F.count(F.lit(1)).alias("n"), F.sum(easy.cast("int")).alias("easy"))
    rest, r = F.col("n") - F.col("easy"), Fraction(str(ratio))
    # Whole numbers: at millions of rows a term against rounding is itself rounded away.
    a, b = r.numerator, r.denominator
    cap = F.greatest(F.floor(F.lit(a) * rest / (b - a)), F.floor(F.lit(a) * F.col("n") / (2 * b)))
    bound = F.when((F.col("n") < 20) | (rest < F.col("n") * 0.25), F.col("easy")).otherwise(F.least("easy", cap))
    return by.select(pack, "n", "easy", bound.cast("long").alias("kept_easy"))


def mixture_balance(rows: DataFrame, family: str, split: str, shares: dict[str, float]) -> DataFrame:
    """family, split, available, keep: shares renormalised over the families that have rows, the total bound by the
    scarcest family, each split's part rounded half to even. A null family has no share, so it is left out."""
    target = F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))]), F.col(family))
    cells = rows.groupBy(family, split).agg(F.count(F.lit(1)).alias("available"))
    fam = cells.groupBy(family).agg(F.sum("available").alias("have")).withColumn("share", target).where("share > 0")
    everything = Window.partitionBy()
    fam = fam.withColumn("share", F.col("share") / F.sum("share").over(everything))
    fam = fam.withColumn("total", F.floor(F.min(F.col("have") / F.col("share")).over(everything) + 1e-9))
    keep = F.least("have", F.bround(F.col("share") * F.col("total")))
    return cells.join(fam, family).select(family, split, "available", F.bround(keep * F.col("available") / F.col("have")).cast("long").alias("keep"))


def split_counts(groups: DataFrame, key: str, n: str, shares: dict[str, float]) -> DataFrame:
    """key, split, count: largest remainder; then every split with a share gets one at least, from the largest."""
    names = list(shares)
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), (F.col(n) * F.lit(shares[s])).alias("exact")) for i, s in enumerate(names)])
    cells = groups.select(key, n, F.inline(parts)).withColumn("low", F.floor(F.col("exact") + 1e-9))
    by = Window.partitionBy(key)
    spare = F.col(n) - F.sum("low").over(by)
    rank = F.row_number().over(by.orderBy(F.round(F.col("low") - F.col("exact"), 9), "i"))
    given = cells.withColumn("count", F.col("low") + (rank <= spare).cast("int"))
    empty = F.sum((F.col("count") == 0).cast("int")).over(by)
    donor = F.row_number().over(by.orderBy(F.desc("count"), "i")) == 1
    fixed = F.when((F.col("count") == 0) & (F.col(n) >= len(names)), 1).when(donor & (F.col(n) >= len(names)), F.col("count") - empty).otherwise(F.col("count"))
    return given.withColumn("count", fixed.cast("long")).select(key, "split", "count")


def group_split(rows: DataFrame, group: str, permille: int, seed: str) -> DataFrame:
    """rows with `part`: whole groups go to val by the hash of the group, about `permille` of a thousand."""
    return rows.withColumn("part", F.when(T.hash_share(F.lit(seed), F.col(group)) < permille * 10, "val").otherwise("train"))


def label_quota(rows: DataFrame, split: str, label: str, key: str, factor: float = 1.6) -> DataFrame:
    """rows kept under a label cap of ceil(n / k * factor) in each split, in the order of the key."""
    sized = rows.groupBy(split).agg(F.ceil(F.count(F.lit(1)) / F.count_distinct(label) * factor).alias("cap"))
    rank = F.row_number().over(Window.partitionBy(split, label).orderBy(key))
    return join_null_safe(rows.withColumn("rank", rank), sized, [split]).where(F.col("rank") <= F.col("cap")).drop("cap", "rank")


def permuted_options(rows: DataFrame, key: str, options: list[str], copies: int) -> DataFrame:
    """key, copy, order, joined: the options in the order of their hash for each copy; unchanged orders are left out."""
    many = rows.select(key, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    keyed = F.array_sort(F.array(*[F.struct(T.hash_hex(F.col(key), F.col("copy"), F.lit(o)).alias("h"), F.lit(o).alias("o")) for o in options]))
    joined = F.array_join(F.transform(keyed, lambda s: s["o"]), ",")
    return many.select(F.concat(F.col(key).cast("string"), F.lit("-p"), F.col("copy").cast("string")).alias("id"), joined.alias("joined")).where(F.col("joined") != ",".join(options))


def holdout_families(rows: DataFrame, family: str, label: str, seed: str, share: float = 0.34) -> DataFrame:
    """family, held_out: families in hash order, at most max(1, int(share F)), as long as the others still have every label.

    One row per family: the greedy pass runs on the driver over families, not rows.
    """
    sets = rows.groupBy(family).agg(F.collect_set(label).alias("labels"), T.hash_hex(F.lit(seed), F.first(family)).alias("h")).orderBy("h").collect()
    every = set().union(*(r["labels"] for r in sets)) if sets else set()
    held: set = set()
    for r in sets:
        rest = [x for x in sets if x[family] not in held and x[family] != r[family]]
        if len(held) < max(1, int(share * len(sets))) and rest and set().union(*(x["labels"] for x in rest)) == every:
            held.add(r[family])
    return rows.select(family).distinct().withColumn("held_out", F.col(family).isin(*held) if held else F.lit(False))


def hardest_and_random(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n // 2 hardest rows (wrong first, then least confident) and as many of the rest in hash order."""
    hard = rows.orderBy("correct", F.round("conf", 9), key).limit(n // 2)
    rest = rows.join(hard.select(key), key, "left_anti").orderBy(T.hash_hex(F.lit(seed), F.col(key))).limit(n - n // 2)
    return hard.withColumn("why", F.lit("hard")).unionByName(rest.withColumn("why", F.lit("random")))
