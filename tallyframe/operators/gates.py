"""Acceptance gates with reason codes, leakage scans, schema checks and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.session import stored

#: A gate is a name and the reason it rejects with (null: it passes).
Gate = tuple[str, Column]


def first_reason(gates: list[Gate]) -> Column:
    """The reason of the first gate that rejects; later gates are not evaluated."""
    return F.coalesce(*[F.when(reason.isNotNull(), F.concat(F.lit(f"{name}:"), reason)) for name, reason in gates])


def reason_category(reason: Column) -> Column:
    """The first two parts of schema and label_leak reasons, else the first."""
    first = F.substring_index(reason, ":", 1)
    return F.when(first.isin("schema", "label_leak"), F.substring_index(reason, ":", 2)).otherwise(first)


def funnel(rows: DataFrame, gates: list[Gate], by: str) -> DataFrame:
    """by, reason, n: rows by the category of the reason they end with, 'accepted' for those that pass."""
    reason = F.coalesce(reason_category(first_reason(gates)), F.lit("accepted"))
    return rows.groupBy(by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def composition(rows: DataFrame, family: str, targets: DataFrame) -> DataFrame:
    """family, n, share, target, gap: counts against targets, either side alone included."""
    counts = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("t")).withColumn("__k", F.lit(1))
    both = counts.join(targets, family, "full").withColumn("__k", F.lit(1)).join(total, "__k")
    share, target = F.coalesce(F.col("n"), F.lit(0)) / F.col("t"), F.coalesce("target", F.lit(0.0))
    return both.select(family, F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 6).alias("share"), F.round(target, 6).alias("target"), F.round(share - target, 6).alias("gap"))


def anchors_missing(text: Column, anchors: Column) -> Column:
    """Anchors that are no case-insensitive substring of the text once thousands' commas are gone."""
    plain = F.lower(F.regexp_replace(text, "(?<=[0-9]),(?=[0-9]{3})", ""))
    return F.filter(anchors, lambda a: ~F.contains(plain, F.lower(a)))


def semantic_reasons(options: Column, preferred: Column, acceptable: Column) -> Column:
    """Reason codes of a record whose answers and options don't fit."""
    return F.array_compact(F.array(
        F.when(F.size(options) < 2, "too_few_options"), F.when(F.size(F.array_distinct(options)) < F.size(options), "repeated_option"),
        F.when(~F.array_contains(options, preferred), "preferred_not_an_option"), F.when(~F.array_contains(acceptable, preferred), "preferred_not_acceptable"),
        F.when(F.size(F.array_except(acceptable, options)) > 0, "acceptable_not_an_option"),
    ))


def compare_facts(expected: Column, got: Column) -> Column:
    """matched, mismatched or unverifiable (null or 'unknown') of two values as text."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, " +", " ")))
    return F.when(got.isNull() | (norm(got) == "unknown"), "unverifiable").when(norm(expected) == norm(got), "matched").otherwise("mismatched")


def scan_leaks(rows: DataFrame, key: str, text: str, deny: dict[str, str], allow: str | None = None, window: int = 20) -> DataFrame:
    """key, code, context: every match of a deny pattern with `window` characters of each side, unless the allow
    pattern occurs in it. Positions are needed, so the matching is Python, batch by batch."""
    import re

    patterns = {code: re.compile(p) for code, p in deny.items()}
    allowed = re.compile(allow) if allow else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for k, t in zip(batch[key], batch[text]):
                for code, pattern in patterns.items():
                    for m in pattern.finditer(t or ""):
                        context = t[max(0, m.start() - window) : m.end() + window]
                        if not (allowed and allowed.search(context)):
                            found.append((k, code, context))
            yield pd.DataFrame(found, columns=[key, "code", "context"])

    return rows.select(key, text).mapInPandas(scan, f"{key} long, code string, context string")


def flatten_json(c: Column, depth: int = 3) -> Column:
    """Paths and values of a JSON object as a map, nested objects to the depth given; nulls are left out."""
    entries = F.map_entries(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")))
    for _ in range(depth - 1):
        entries = F.flatten(F.transform(entries, _expanded))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _expanded(e: Column) -> Column:
    inner = F.from_json(F.when(e["value"].startswith("{"), e["value"]), "map<string,string>")
    nested = F.transform(F.map_entries(inner), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value")))
    return F.when(inner.isNotNull(), nested).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def forbidden_keys(c: Column, pattern: str) -> Column:
    return F.filter(F.map_keys(flatten_json(c)), lambda k: k.rlike(pattern))


def fenced_object(c: Column) -> Column:
    """The JSON object inside an optional code fence, null if it is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^```[a-z]*\\s*", ""), "\\s*```$", ""))
    return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)


def judge_cap(rows: DataFrame, order: list[Column], share: float) -> DataFrame:
    """rows with `judged`: the first max(1, int(share n)) in the order given."""
    numbered = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    first = numbered.orderBy(*order).limit(max(1, int(share * numbered.count()))).select("__row", F.lit(True).alias("__judged"))
    return numbered.join(first, "__row", "left").select(*rows.columns, F.coalesce("__judged", F.lit(False)).alias("judged"))


def map_batches(rows: DataFrame, schema: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """The seam for scorers, embedders and clients: `make` builds one in each task, which then maps batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            yield client(batch)

    return rows.mapInPandas(run, schema)


def fake_scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A deterministic scorer: three probabilities from the text's length."""
    import numpy as np

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        n = batch["text"].fillna("").str.len().to_numpy()
        z = np.stack([(n * k % 97) / 20.0 for k in (31, 37, 41)], axis=1)
        p = np.exp(z - z.max(1, keepdims=True))
        return pd.DataFrame({"doc_id": batch["doc_id"], "probs": list((p / p.sum(1, keepdims=True)).round(6))})

    return score
