"""Decision rules as columns. Each function takes a mapping from fact to column and returns the label's column.

First-match rules are a CASE chain in the order given; point rules sum points and cut the sum at limits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Facts = dict[str, Column]


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F
    for condition, label in cases:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def points(terms: list[tuple[Column, int]]) -> Column:
    """Sum of the points of the terms that hold; a null term doesn't."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in terms])


def steps(value: Column, limits: list[tuple[float, int]], at_least: bool = True) -> Column:
    """Points of the first limit that the value reaches (or doesn't exceed), else 0. Limits stand strictest first."""
    out = F
    for limit, p in limits:
        out = out.when(value >= limit if at_least else value <= limit, p)
    return out.otherwise(0)


def graded(score: Column, cuts: tuple[int, int, int]) -> Column:
    """0 up to the first cut, 1 up to the second, 2 up to the third, else 3."""
    return F.when(score <= cuts[0], 0).when(score <= cuts[1], 1).when(score <= cuts[2], 2).otherwise(3)


def fraud(f: Facts) -> tuple[Column, Column]:
    """points, label: block, review or approve."""
    ratio = f["amount"] / F.greatest(f["average"], F.lit(1.0))
    score = (
        F.when(ratio > 5, 3).when(ratio > 2, 1).otherwise(0)
        + steps(f["per_hour"], [(5, 3), (3, 1)])
        + F.when(f["account_days"] < 7, 2).when(f["account_days"] < 30, 1).otherwise(0)
        + points([(f["new_device"], 1), (f["foreign"], 2), (f["risky_merchant"], 2), (f["ships_elsewhere"], 1), (f["card_present"], -1)])
    )
    return score, first_match([((score >= 7) | (f["gift_card"] & f["new_device"] & f["foreign"]), "block"), (score >= 4, "review")], "approve")


def invoice(f: Facts) -> Column:
    return first_match(
        [
            (f["bank_changed"] | (~f["known_vendor"] & (f["amount"] > 5000)), "fraud_review"),
            (f["po"].isNull() | (f["amount"] > f["po"] * 1.05), "dispute"),
            (f["duplicate"] | ~f["approved"], "hold"),
        ],
        "pay",
    )


def claim(f: Facts) -> Column:
    score = points([(f["claims"] >= 3, 2), (f["policy_days"] < 30, 2), (~f["complete"], 1), (f["loss"] > 25_000, 1)])
    return first_match([(score >= 4, "SIU"), (f["injury"] | (f["loss"] > 50_000) | ~f["active"], "specialist")], "STP")


def lead(f: Facts) -> Column:
    score = F.when(f["title"].isin("director", "VP", "CTO"), 2).when(f["title"] == "manager", 1).otherwise(0)
    score = score + F.when(f["months"] <= 3, 2).when(f["months"] <= 6, 1).otherwise(0)
    return graded(score + points([(f["employees"].between(50, 5000), 1), (f["budget"], 2), (f["demo"], 2), (f["industry"], 1)]), (2, 4, 6))


def churn(f: Facts) -> Column:
    score = steps(f["idle_days"], [(14, 3), (7, 2), (3, 1)])
    score = score + points([(f["last_week"] < f["week_before"] * 0.5, 2), (f["days_since_purchase"] >= 60, 1), (f["friends"] < 2, 1)])
    return graded(score, (1, 3, 5))


def refund(f: Facts) -> Column:
    return ~f["final_sale"] & ((f["state"].isin("unopened", "opened") & (f["days"] <= f["window"])) | ((f["state"] == "damaged") & (f["days"] <= 2 * f["window"])))


def urgency(f: Facts) -> Column:
    score = (
        F.when(f["scope"] == "team", 1).when(f["scope"] == "org", 2).when(f["scope"] == "all", 3).otherwise(0)
        + F.when(f["service"] == "degraded", 1).when(f["service"] == "down", 2).otherwise(0)
        + F.when(f["revenue"] == "minor", 1).when(f["revenue"] == "major", 2).otherwise(0)
        + F.when(f["real_deadline"], F.when(f["hours"] <= 4, 3).when(f["hours"] <= 24, 2).when(f["hours"] <= 72, 1).otherwise(0)).otherwise(0)
        + F.when(f["workaround"] == "partial", -1).when(f["workaround"] == "full", -3).otherwise(0)
    )
    return F.when(f["safety"], 3).when(f["scope"].isNull(), 1).otherwise(graded(score, (0, 2, 4)))


def tool_risk(f: Facts) -> Column:
    return first_match(
        [(f["sends_out"] & ~f["trusted"], "exfiltration"), (f["changes_access"] | f["weakens"], "privileged"), (f["deletes"] | f["irreversible"], "destructive"), (f["reads"], "readonly")], "error"
    )


def financial_triage(f: Facts) -> Column:
    skip = (f["earnings_days"] <= 2) | (f["volatility"] > 60) | (f["sentiment"] < -0.5)
    buy = (f["price"] > f["ma50"]) & f["rsi"].between(50, 70) & (f["return5"] > 0) & (f["sentiment"] >= 0.2)
    return first_match([(skip, "SKIP"), (buy, "BUY")], "HOLD")


def game(f: Facts) -> Column:
    return first_match(
        [
            ((f["health"] < 25) & f["medkit"], "heal"), (f["health"] < 25, "retreat"), ((f["ammo"] == 0) & f["cover"], "reload"), (f["ammo"] == 0, "retreat"),
            ((f["enemies"] >= 3) & f["cover"], "take_cover"), ((f["enemies"] >= 1) & f["in_range"], "attack"),
        ], "advance",
    )


def robot(f: Facts) -> Column:
    return first_match([(f["battery"] < 15, "return_to_dock"), (f["obstacle"] <= 0.5, "stop"), ((f["obstacle"] <= 2) | (f["fragile"] & (f["obstacle"] <= 4)), "slow")], "continue")


def soc_triage(f: Facts) -> Column:
    return first_match(
        [
            (f["lateral"] | (f["confirmed"] & f["critical"]), "contain_now"),
            (f["known_false"] | ((f["severity"] <= 2) & ~f["confirmed"] & ~f["impacted"]), "auto_close"),
            (f["impacted"] & (f["severity"] <= 3) & ~f["confirmed"], "notify_user"),
        ], "queue_tier2",
    )


def soc_escalation(triage: Column, f: Facts) -> Column:
    return first_match(
        [
            ((triage == "contain_now") & f["critical"], "page_oncall"), ((triage == "contain_now") | ((f["severity"] >= 4) & f["high"]), "handoff_ir"), (triage == "notify_user", "notice_users"),
        ], "stay_queue",
    )


def soc_recovery(f: Facts) -> Column:
    return first_match([(~f["clean"] | (f["hours"] < 4), "remain_isolated"), ((f["hours"] >= 24) & f["fixed"], "full_restore")], "limited_restore")


def crime_alert(f: Facts) -> Column:
    return graded(points([(f["structuring"], 3), (f["jurisdiction"], 2), (f["pep"], 2), (f["prior"], 2), (f["false_rate"] > 80, -2)]), (1, 3, 5))


def recruiting(required: Column, nice: Column, have: Column, years: Column, least: Column) -> Column:
    """required, nice, have: arrays of skills."""
    score = 1 + F.when(2 * F.size(F.array_intersect(nice, have)) >= F.size(nice), 1).otherwise(0) + F.when(years >= least + 2, 1).otherwise(0)
    return F.when(F.size(F.array_except(required, have)) > 0, 0).otherwise(F.least(F.lit(3), score))


def model_route(f: Facts) -> Column:
    return first_match(
        [
            (f["reasoning"] | (f["code"] & f["critical"]), "large"), (f["latency_ms"] < 500, "small"), (f["extraction"] & (f["tokens"] < 4000) & ~f["critical"], "small"),
        ], "medium",
    )


def same_entity(name: Column, email: Column, phone: Column, address: Column) -> Column:
    """name: exact, variant or different; the others: same, different or unknown."""
    shared, conflict = (email == "same") | (phone == "same"), (email == "different") | (phone == "different")
    return first_match(
        [
            (name.isin("exact", "variant") & shared & ~conflict, "match"),
            ((name == "exact") & (address == "same") & (email != "different") & (phone != "different"), "match"),
            ((name == "different") & ~shared, "no_match"),
            ((email == "different") & (phone == "different") & (name != "exact"), "no_match"),
        ], "needs_review",
    )


#: What each way of answering costs.
ROUTER_COSTS = {"use_cache": 0, "use_python": 1, "ask_user": 2, "call_small_model": 4, "search_web": 5, "call_large_model": 20}


def next_action(preferred: Column, blocked: Column) -> Column:
    """The first preferred action that isn't blocked, else ask_user."""
    return F.coalesce(F.try_element_at(F.filter(preferred, lambda a: ~F.array_contains(blocked, a)), F.lit(1)), F.lit("ask_user"))


def coverage_type(features: Column, signatures: dict[str, list[str]], least: float = 0.6) -> Column:
    """The type whose signature the features cover best, if that is unique and at least `least`; else other."""
    cover = [F.struct(F.round(F.size(F.array_intersect(features, F.array(*[F.lit(x) for x in own]))) / len(own), 9).alias("c"), F.lit(name).alias("t")) for name, own in signatures.items()]
    ranked = F.sort_array(F.array(*cover), asc=False)
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    return F.when((best["c"] >= least) & (best["c"] > second["c"]), best["t"]).otherwise("other")


def rbac(roles: Column, grants: Column, needed: Column, expired: Column, needs_approval: Column) -> Column:
    """roles, grants: arrays of permissions that roles and direct grants give."""
    held = F.array_contains(F.array_union(roles, grants), needed)
    return first_match([(~held | expired, "deny"), (needs_approval, "require_approval")], "allow")


#: Fixed value: days of a month.
MONTH_DAYS = 30.4375


def procedure_tier(f: Facts, new_months: int, limits: list[list[float]], tiers: list[str]) -> Column:
    """The approval tier of a payment. Facts: category (0 to 3), approved_country, days_known, watched, total.

    A country that isn't approved and a partner of less than new_months raise the category by one each, to 3 at most; a
    watched partner is 3. The tier is the first whose limit of that category holds the total, the last if none does.
    """
    raised = f["category"] + (~f["approved_country"]).cast("int") + (f["days_known"] < new_months * MONTH_DAYS).cast("int")
    category = F.when(f["watched"], 3).otherwise(F.least(raised, F.lit(3)))
    row = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in limits]), category.cast("int") + 1)
    over = F.size(F.filter(row, lambda x: x < f["total"]))
    return F.element_at(F.array(*[F.lit(t) for t in tiers]), over + 1)
