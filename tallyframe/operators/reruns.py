"""Rules run again: on facts that were read back from a rendering, and on the facts that a label was made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule gives the label of a set of features, or of any facts, as a column.
Rule = Callable[[Column], Column]


def feature_set(features: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(features, F.array().cast("array<string>")))))


def features_verdict(rule: Rule, world: Column, read: Column) -> Column:
    """matched, features_present:missing_f or features_present:extra_features_change_class.

    world: the features that a text was made from; read: those found in it. Every one of the world has to be found (of
    those that aren't, f is the first by name). Others are tolerated as long as the rule, run on both together, gives
    the label that it gives for the world alone: two worlds in one row, compared so that two nulls are equal. Null sets
    are empty, null and repeated features don't count.
    """
    want, got = feature_set(world), feature_set(read)
    missing = F.try_element_at(F.array_except(want, got), F.lit(1))
    same = rule(F.array_union(want, got)).eqNullSafe(rule(want))
    return F.when(missing.isNotNull(), F.concat(F.lit("features_present:missing_"), missing)).when(~same, "features_present:extra_features_change_class").otherwise("matched")


def preserving_extras(rule: Rule, world: Column, extras: Column) -> Column:
    """Those of the extras that, each added alone, leave the world's label as it is, by name."""
    want = feature_set(world)
    label = rule(want)
    return F.filter(feature_set(F.array_except(feature_set(extras), want)), lambda x: rule(F.array_union(want, F.array(x))).eqNullSafe(label))


def reproduced(rule: Callable[..., Column], facts: tuple[Column, ...], recorded: Column) -> Column:
    """policy:oracle_not_reproducible where the rule, run again on a record's facts, gives another label than the record has; else null.

    A null label is a label: the rule has to give null again.
    """
    return F.when(~rule(*facts).eqNullSafe(recorded), "policy:oracle_not_reproducible")
