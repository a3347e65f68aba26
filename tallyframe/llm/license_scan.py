"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by interval containment.

A text is reduced to its lower-cased words. Only texts that hold some keyword are looked at further, and there only
the rules of the keywords they hold. Each match is an interval of words with the rule's priority; a match is
suppressed if another of the same or a higher priority contains it. One sweep over the matches in order of their
start decides that, so a text with many matches takes time in proportion. Everything happens within the row: the
plan has no join, no shuffle and no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, UPPER, whole_text
from tallyframe.llm.license_rules import BASE, keywords, rules

#: Words: runs of ASCII letters and digits and of anything outside ASCII, as they stand before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: No word holds it.
MARK = "\x01"
SCORES = (1.0, 0.9, 0.75, 0.5)
_RULE = "struct<rule:int,priority:int,label:string,base:boolean,regex:string>"


def _rules() -> Column:
    """Every rule, folded into one literal by the optimizer."""
    bases = {phrase for phrase, _ in BASE}
    found = [{"rule": i, "priority": p, "label": label, "base": p == 4 and regex in bases, "regex": f"(?<![^ ])(?:{regex})(?![^ ])"} for i, (p, label, _, regex) in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(found)), f"array<{_RULE}>")


def _rule_map() -> Column:
    """keyword -> the numbers of its rules, from one, folded into one literal by the optimizer."""
    by: dict[str, list] = {}
    for i, (_, _, keyword, _) in enumerate(rules(), 1):
        for one in keyword.split("/"):
            by.setdefault(one, []).append(i)
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<int>>")


def _held(norm: Column) -> Column:
    """The keywords that the text holds; a beginning of words stands with its star."""
    whole, begun = [k for k in keywords() if k[-1] != "*"], [k for k in keywords() if k[-1] == "*"]
    padded = F.concat(F.lit(" "), norm)
    starts = [F.when(F.contains(padded, F.lit(" " + k[:-1])), F.lit(k)) for k in begun]
    return F.concat(F.array_intersect(F.split(norm, " "), F.array(*[F.lit(k) for k in whole])), F.array_compact(F.array(*starts)))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _matches(norm: Column, rule: Column) -> Column:
    """Every match of the rule as first and last word, in time in proportion to the text.

    A mark is put before each match; the words that begin with it are the starts.
    """
    none = F.array().cast("array<struct<start:int,back:int,priority:int,rule:int,label:string,base:boolean>>")

    def hit(start: Column, text: Column) -> Column:
        # Ordered by start, then the longest, then the highest priority, then the earliest rule.
        back = -(start + _blanks(text))
        return F.struct(start.alias("start"), back.alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"))

    def of(hits: Column) -> Column:
        words = F.split(F.regexp_replace(norm, rule["regex"], F.lit(MARK + "$0")), " ")
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        return F.when(F.size(hits) > 0, F.zip_with(starts, hits, hit)).otherwise(none)

    return F.flatten(F.transform(F.array(F.regexp_extract_all(norm, rule["regex"], F.lit(0))), of))


def _sweep(hits: Column) -> Column:
    """labels, n and the best priority of the matches that no match of at least their priority contains."""
    reach = [f"reach{p}" for p in range(1, 5)]

    def step(acc: Column, h: Column) -> Column:
        end = -h["back"]
        hidden = F.array(*[acc[r] for r in reach])
        free = F.element_at(hidden, h["priority"]) < end
        moved = [F.when(h["priority"] <= p, F.greatest(acc[r], end)).otherwise(acc[r]).alias(r) for p, r in enumerate(reach, 1)]
        return F.struct(
            *moved,
            F.when(free, F.array_union(acc["labels"], F.array(h["label"]))).otherwise(acc["labels"]).alias("labels"),
            (acc["n"] + free.cast("long")).alias("n"),
            F.when(free, F.least(acc["best"], h["priority"])).otherwise(acc["best"]).alias("best"),
        )

    start = F.struct(*[F.lit(-1).alias(r) for r in reach], F.array().cast("array<string>").alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(9).alias("best"))
    return F.aggregate(F.array_sort(hits), start, step)


def _gate() -> str:
    """One pass over the raw text: may it hold a keyword as a word?"""
    return "(?i)(?<![0-9a-z])(?:" + "|".join(k[:-1] + "[0-9a-z]*" if k[-1] == "*" else k for k in keywords()) + ")(?![0-9a-z])"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, whatever other columns docs has.

    Base phrases count at every place where their words stand consecutively, suppressed or not, and their labels stay
    in `labels`; n_found counts the matches that are left. Null and empty texts have no words, no labels ('') and
    score 0; repeated rows are scanned each by itself; an empty table gives no rows.
    """
    text = whole_text()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = docs.select("doc_id", F.size(words).cast("long").alias("n_words"), F.when(text.rlike(_gate()), F.translate(F.array_join(words, " "), UPPER, LOWER)).alias("norm"))
    numbers = F.array_distinct(F.flatten(F.transform(_held(F.col("norm")), lambda k: F.element_at(_rule_map(), k))))
    found = F.flatten(F.transform(numbers, lambda i: _matches(F.col("norm"), F.element_at(_rules(), i))))
    none = F.array().cast("array<struct<start:int,back:int,priority:int,rule:int,label:string,base:boolean>>")
    hits = counted.withColumn("hits", F.when(F.col("norm").isNull(), none).otherwise(found)).drop("norm")
    swept = hits.withColumn("base", F.filter("hits", lambda h: h["base"])).withColumn("kept", F.when(F.size("hits") > 0, _sweep(F.col("hits"))))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda h: h["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("kept.labels", F.array().cast("array<string>")))))
    starts = F.transform("base", lambda h: h["start"].cast("long"))
    return swept.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.try_element_at(F.array(*[F.lit(s) for s in SCORES]), F.nullif(F.col("kept.best"), F.lit(9))), F.lit(0.0)).alias("score"),
        F.coalesce("kept.n", F.lit(0).cast("long")).alias("n_found"),
    )
