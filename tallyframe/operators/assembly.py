"""Putting datasets together: caps and mixtures that return rows, holdouts, exclusions, reloading a run.

Rows are ranked inside buckets of their order, and buckets are counted first: no window holds a whole group, however
large the group is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import sampling, similarity
from tallyframe.plans.session import stored

#: Buckets of an order: a group's rows are spread over so many tasks.
BUCKETS = 256


def hash_order(seed: str, key: str) -> Column:
    """A number of 48 bits from the key's stable hash."""
    return F.conv(F.substring(T.hash_hex(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _same(names: list[str], right: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(right[n])) for n in names])


def _renamed(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    right = {n: f"__{n}" for n in names}
    return df.withColumnsRenamed(right), right


def first_in_order(rows: DataFrame, groups: list[str], order: Column, key: str, quotas: DataFrame, quota: str) -> DataFrame:
    """The first `quota` rows of each group by (order, key). quotas: a row for each group; groups without one keep nothing.

    order is a number. Buckets follow approximate percentiles of the group, which decide how rows are spread, not which
    ones are kept. They depend on the order in which tasks' parts arrive, so they are written before rows are dealt and
    counted by them. A null group is a group.
    """
    keyed = rows.withColumn("__v", order)
    shares = F.array(*[F.lit((i + 1) / BUCKETS) for i in range(BUCKETS - 1)])
    cuts, right = _renamed(keyed.groupBy(*groups).agg(F.percentile_approx("__v", shares, F.lit(1000)).alias("__cuts")), groups)
    asked, asked_right = _renamed(quotas.select(*groups, F.col(quota).alias("__quota")), groups)
    bounds = stored(cuts.join(asked.withColumnsRenamed({v: f"_{v}" for v in asked_right.values()}), reduce(lambda a, b: a & b, [F.col(f"__{n}").eqNullSafe(F.col(f"___{n}")) for n in groups])).drop(*[f"___{n}" for n in groups]))
    bucket = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    dealt = keyed.join(bounds, _same(groups, right)).withColumn("__bucket", bucket).drop("__cuts", *right.values())
    counted = dealt.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before, right = _renamed(counted.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n"), [*groups, "__bucket"])
    reached = dealt.join(before, _same([*groups, "__bucket"], right)).where(F.col("__before") < F.col("__quota"))
    rank = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy("__v", key))
    return reached.withColumn("__rank", rank).where(F.col("__before") + F.col("__rank") <= F.col("__quota")).select(*rows.columns)


def diversity_select(rows: DataFrame, pack: str, key: str, easy: Column, ratio: float = 0.6) -> DataFrame:
    """All rows that aren't easy, and of the easy ones of each pack as many as sampling.diversity_cap allows, by key.

    key is a number; a row whose `easy` is null isn't easy.
    """
    flagged = F.coalesce(easy, F.lit(False))
    quotas = sampling.diversity_cap(rows, pack, flagged, ratio)
    return rows.where(~flagged).unionByName(first_in_order(rows.where(flagged), [pack], F.col(key), key, quotas, "kept_easy"))


def mixture_select(rows: DataFrame, family: str, split: str, key: str, shares: dict[str, float], seed: str = "mixture") -> DataFrame:
    """The rows that sampling.mixture_balance counts: of each family and split the first by the stable hash of the key."""
    return first_in_order(rows, [family, split], hash_order(seed, key), key, sampling.mixture_balance(rows, family, split, shares), "keep")


def holdout(rows: DataFrame, key: str, seed: str, share: float = 0.15) -> DataFrame:
    """rows with held_out: the first int(share * n) rows in hash order. Rows of one key stay together.

    The driver learns 4,096 bucket counts and one cut; inside its bucket the cut is found by a top-k.
    """
    keyed = rows.withColumn("__h", hash_order(seed, key))
    counts = {r["b"]: r["n"] for r in keyed.groupBy(F.shiftright("__h", 36).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    need = int(share * sum(counts.values()) + 1e-9)
    for b in sorted(counts):
        if need <= counts[b]:
            break
        need -= counts[b]
    if not counts or need == 0 and b == min(counts):
        return keyed.withColumn("held_out", F.lit(False)).drop("__h")
    cut = keyed.where(F.shiftright("__h", 36) == b).orderBy("__h").limit(need).agg(F.max("__h")).first()[0] if need else b << 36
    return keyed.withColumn("held_out", F.col("__h") <= cut if need else F.col("__h") < cut).drop("__h")


def without_prefixes(rows: DataFrame, pack: str, prefixes: list[str]) -> DataFrame:
    """Rows whose pack starts with none of the prefixes; a null pack starts with none."""
    return rows.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(pack).startswith(p), F.lit(False)) for p in prefixes], F.lit(False)))


def assemble(sources: list[DataFrame], pack: str, key: str, prefixes: list[str], diagnostic: DataFrame, similar: float, cap: int, seed: str, held: float) -> DataFrame:
    """One dataset of several: packs by prefix go, rows too like a diagnostic item go, packs are capped in hash order,
    and `held_out` marks the share kept for later training. Sources have doc_id, text and the pack."""
    rows = without_prefixes(reduce(lambda a, b: a.unionByName(b), sources), pack, prefixes)
    leaks = similarity.token_set_matches(rows, diagnostic, similar).select("doc_id").distinct()
    kept = rows.join(leaks, "doc_id", "left_anti")
    quotas = kept.groupBy(pack).agg(F.lit(cap).alias("quota"))
    # holdout reads its rows three times.
    return holdout(stored(first_in_order(kept, [pack], hash_order(seed, key), key, quotas, "quota")), key, seed + "-held", held)


def reload_run(candidates: DataFrame, worlds: DataFrame, rejections: DataFrame, world: str, candidate: str) -> DataFrame:
    """candidates with their world's columns, `reasons` (sorted, none if never rejected) and `alive`.

    Candidates without a world are dropped: there is nothing to resume them from.
    """
    reasons = rejections.groupBy(candidate).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    joined = candidates.join(worlds, world).join(reasons, candidate, "left")
    return joined.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))).withColumn("alive", F.size("reasons") == 0)


def with_source(rows: DataFrame, sources: DataFrame, key: str, by: str) -> DataFrame:
    """by, matched, missing: rows that have a source record and rows that are dropped for want of one."""
    known = sources.select(key).distinct().withColumn("__known", F.lit(True))
    return rows.join(known, key, "left").groupBy(by).agg(F.count_if(F.col("__known")).alias("matched"), F.count_if(F.col("__known").isNull()).alias("missing"))


def deal_by_capacity(groups: DataFrame, posture: str, name: str, capacity: str, postures: list[str], splits: list[str]) -> DataFrame:
    """groups of the listed postures with `split`: the largest first, dealt in turn; each posture starts one split later."""
    rank = F.row_number().over(Window.partitionBy(posture).orderBy(F.desc(capacity), name))
    at = (rank + F.array_position(F.array(*[F.lit(p) for p in postures]), F.col(posture)) - 2) % len(splits) + 1
    return groups.where(F.col(posture).isin(*postures)).withColumn("split", F.element_at(F.array(*[F.lit(s) for s in splits]), at.cast("int")))


#: Fixed value: a word, with inner - _ / . between letters or digits.
TOKEN = r"[a-z0-9][a-z0-9\-_/\.]*[a-z0-9]|[a-z0-9]"


def fingerprint(text: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the text's tokens."""
    tokens = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), " ")
    return F.substring(F.sha1(F.encode(tokens, "UTF-8")), 1, 12)


def exact_contamination(docs: DataFrame, items: DataFrame, tokenless: bool = False) -> DataFrame:
    """doc_id of documents with an item's fingerprint. Texts without a token aren't compared, or with `tokenless` equal each other."""
    empty = F.substring(F.sha1(F.encode(F.lit(""), "UTF-8")), 1, 12)
    known = items.select(fingerprint(F.col("text")).alias("f")).where(F.lit(tokenless) | (F.col("f") != empty)).distinct()
    return docs.select("doc_id", fingerprint(F.col("text")).alias("f")).join(known, "f", "left_semi").select("doc_id")


def contamination_report(signals: dict[str, DataFrame]) -> DataFrame:
    """signal, rows for each signal, and `any`, the signals together: a row that two of them catch counts twice there."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select("doc_id").distinct().withColumn("signal", F.lit(name)) for name, df in signals.items()])
    return every.select(F.explode(F.array("signal", F.lit("any"))).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("rows"))
