"""A floor for shell commands by pattern, and how it meets a model's opinion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of command patterns (ASCII classes only), each with the least restrictive answer it permits.
PATTERNS = {
    "sensitive": ("deny", r"/etc/shadow|[.]ssh/id_[a-z0-9]+|[.]aws/credentials"),
    "weakening": ("deny", r"chmod +777|setenforce +0|ufw +disable"),
    "egress": ("ask", r"(curl|wget|scp|rsync) +[^ ]"),
    "mutation": ("ask", r"(^|[;&| ])(rm|mv|dd|mkfs|truncate) +[^ ]"),
    "opaque": ("ask", r"base64 +(-d|--decode)|eval +[^ ]"),
}
RANK = {"allow": 0, "ask": 1, "deny": 2}
LONGEST = 8000


def hits(command: Column) -> Column:
    """Names of the groups that the command matches, in order."""
    return F.array_compact(F.array(*[F.when(command.rlike(f"(?i){pattern}"), F.lit(name)) for name, (_, pattern) in PATTERNS.items()]))


def balanced(command: Column) -> Column:
    """Whether single and double quotes come in pairs."""
    return (F.regexp_count(command, F.lit("'")) % 2 == 0) & (F.regexp_count(command, F.lit('"')) % 2 == 0)


def floor(command: Column) -> Column:
    """allow, ask or deny; too long or unbalanced commands are at least asked about."""
    ranks = [F.when(command.rlike(f"(?i){pattern}"), RANK[least]).otherwise(0) for least, pattern in PATTERNS.values()]
    odd = F.when((F.char_length(command) > LONGEST) | ~balanced(command), 1).otherwise(0)
    return F.element_at(F.array(F.lit("allow"), F.lit("ask"), F.lit("deny")), F.greatest(*ranks, odd) + 1)


def resolve(floor_label: Column, model_label: Column, model_p: Column, sure: float = 0.995) -> Column:
    """The more restrictive of the two; a model's allow counts from `sure` up, and without a model it is asked."""
    rank = lambda c: F.when(c == "deny", 2).when(c == "ask", 1).otherwise(0)
    opinion = F.when(model_label.isNull(), 1).when((model_label == "allow") & (model_p < sure), 1).otherwise(rank(model_label))
    return F.element_at(F.array(F.lit("allow"), F.lit("ask"), F.lit("deny")), F.greatest(rank(floor_label), opinion) + 1)


def action_mass(postures: Column, actions: dict[str, str]) -> Column:
    """action -> probability: the postures' map of probabilities summed by the action each means."""
    total = lambda a: reduce(lambda x, y: x + y, [F.coalesce(F.try_element_at(postures, F.lit(p)), F.lit(0.0)) for p, to in actions.items() if to == a])
    return F.create_map(*[x for a in sorted(set(actions.values())) for x in (F.lit(a), total(a))])
