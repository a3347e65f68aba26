"""Gates of an agent's loop: what to do with a tool call, a retrieval, an answer, an instruction, a post, an extraction.

Every gate takes columns by name and gives a struct of route and reason. A fact that is null counts as not holding, its
negation as holding: what is not known to be available, approved, valid or of the same tenant is not. Routes, reasons,
kinds and their order are fixed values of the decision tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import squeeze_value

Facts = dict[str, Column]
#: A line of a decision table: a condition, the route and the reason.
Line = tuple[Column, Column | str, Column | str]


def decide(table: list[tuple[Column, Column | str]], default: Column | str) -> Column:
    """The value of the first line whose condition holds."""
    out = lambda r: r if isinstance(r, Column) else F.lit(r)
    return F.coalesce(*[F.when(c, out(r)) for c, r in table], out(default))


def routed(table: list[Line], route: Column | str, reason: Column | str) -> Column:
    """route and reason of the first line whose condition holds, else those given."""
    return F.struct(decide([(c, r) for c, r, _ in table], route).alias("route"), decide([(c, w) for c, _, w in table], reason).alias("reason"))


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _told(f: Facts, *names: str) -> Facts:
    """The facts, with nulls among the named ones (conditions) as false."""
    return {**f, **{n: holds(f[n]) for n in names}}


def tool_action(f: Facts) -> Column:
    """allow, deny, repair_arguments, require_confirmation or choose_alternative for a proposed call.

    Facts: available, alternative, sensitive, external, traversal, tenant, session_tenant, failed_before,
    issues (codes of the arguments; null: not known to be valid), writes_outside, approved.
    """
    f = _told(f, "available", "alternative", "sensitive", "external", "traversal", "failed_before", "writes_outside", "approved")
    first = F.coalesce(F.substring_index(F.try_element_at(f["issues"], F.lit(1)), ":", 1), F.lit("unknown"))
    return routed([
        (~f["available"] & f["alternative"], "choose_alternative", "tool_unavailable_alternative_exists"),
        (~f["available"], "deny", "tool_unavailable_no_alternative"),
        (f["sensitive"] & f["external"], "deny", "sensitive_data_exfiltration"),
        (f["traversal"], "deny", "path_traversal"),
        (~holds(f["tenant"] == f["session_tenant"]), "deny", "tenant_boundary_violation"),
        (f["failed_before"] & f["alternative"], "choose_alternative", "unchanged_failing_retry_alternative"),
        (f["failed_before"], "repair_arguments", "unchanged_failing_retry_repair"),
        (~holds((F.size(f["issues"]) == 0) & f["issues"].isNotNull()), "repair_arguments", F.concat(F.lit("schema_invalid:"), first)),
        (f["writes_outside"] & ~f["approved"], "require_confirmation", "external_side_effect_without_approval"),
        (f["writes_outside"], "allow", "external_side_effect_approved"),
    ], "allow", "valid_call_within_policy")


def retrieval(f: Facts) -> Column:
    """ask_user, no_retrieval, read_local_context, search_local_index or search_web.

    Facts: key_missing, conflicting, in_context, context_date, today, fresh, max_age, sources (array of structs with
    covers, modified, mounted, readable, indexed), public, network.
    """
    f = _told(f, "key_missing", "conflicting", "in_context", "fresh", "public", "network")
    recent = lambda d: ~f["fresh"] | holds(F.datediff(f["today"], d) <= f["max_age"])
    usable = F.filter(f["sources"], lambda s: holds(s["covers"]) & recent(s["modified"]))
    return routed([
        (f["key_missing"], "ask_user", "identifier_missing_or_ambiguous"),
        (f["conflicting"], "ask_user", "conflicting_authoritative_local_sources"),
        (f["in_context"] & recent(f["context_date"]), "no_retrieval", "answer_in_current_context"),
        (F.exists(usable, lambda s: holds(s["mounted"] & s["readable"])), "read_local_context", "readable_mounted_file_covers_topic"),
        (F.exists(usable, lambda s: holds(s["indexed"])), "search_local_index", "indexed_source_covers_topic"),
        (f["public"] & f["network"], "search_web", "public_target_no_usable_local_source_web_available"),
        (f["public"], "ask_user", "public_target_network_disallowed"),
    ], "ask_user", "internal_target_no_accessible_source")


def termination(f: Facts) -> Column:
    """finish, continue, repair, retry, ask_user or escalate.

    Facts: input_missing, error (transient, permanent_env or null), retries, budget, exists, nonempty, schema_valid,
    tests_failed (a count; null: no tests), conflict, covered, total.
    """
    f = _told(f, "input_missing", "exists", "nonempty", "schema_valid", "conflict")
    left = holds(f["retries"] < f["budget"])
    return routed([
        (f["input_missing"], "ask_user", "required_user_input_missing"),
        ((f["error"] == "transient") & left, "retry", "transient_failure_within_budget"),
        (f["error"] == "transient", "escalate", "retry_budget_exhausted"),
        (f["error"] == "permanent_env", "escalate", "permanent_environment_failure"),
        (~f["exists"] & left, "retry", "artifact_absent_within_budget"),
        (~f["exists"], "escalate", "artifact_absent_budget_exhausted"),
        (~f["nonempty"] | ~f["schema_valid"], "repair", "artifact_empty_or_schema_invalid"),
        (f["tests_failed"] > 0, "repair", "tests_failing"),
        (f["conflict"], "escalate", "conflicting_validation_signals"),
        (~holds(f["covered"] >= f["total"]), "continue", "required_fields_missing"),
    ], "finish", "artifact_valid_and_complete")


def sufficiency(f: Facts) -> Column:
    """return, repair_from_context, retrieve_more, ask_user or escalate for a drafted answer.

    Facts: ambiguous, contradicts, conflicting, unsupported, citations_valid, format_ok, facts (array of structs with
    in_answer, in_context, owner, retrievable).
    """
    f = _told(f, "ambiguous", "contradicts", "conflicting", "unsupported", "citations_valid", "format_ok")
    missing = F.filter(f["facts"], lambda x: ~holds(x["in_answer"]))
    unknown = F.filter(missing, lambda x: ~holds(x["in_context"]))
    some = F.size(missing) > 0
    return routed([
        (f["ambiguous"], "ask_user", "request_ambiguous"),
        (f["contradicts"] | f["conflicting"], "escalate", "contradiction_with_or_between_authoritative_sources"),
        (f["unsupported"] | ~f["citations_valid"], "repair_from_context", "unsupported_claim_or_bad_citation"),
        (some & (F.size(unknown) == 0), "repair_from_context", "missing_fact_available_in_context"),
        (F.exists(unknown, lambda x: holds(x["owner"] == "user")), "ask_user", "missing_fact_only_the_user_has"),
        (F.exists(unknown, lambda x: holds(x["retrievable"])), "retrieve_more", "missing_fact_retrievable"),
        (some, "escalate", "missing_fact_unavailable"),
        (~f["format_ok"], "repair_from_context", "format_constraint_violated"),
    ], "return", "complete_supported_answer")


def injection(f: Facts) -> Column:
    """safe_data, require_confirmation, block_and_escalate or ignore_untrusted_instruction.

    Facts: present, quoted, trusted, side_effect, approved, target.
    """
    f = _told(f, "present", "quoted", "trusted", "side_effect", "approved")
    target = F.coalesce(f["target"], F.lit("unknown"))
    return routed([
        (~f["present"] | f["quoted"], "safe_data", "no_live_embedded_instruction"),
        (f["trusted"] & f["side_effect"] & ~f["approved"], "require_confirmation", "trusted_instruction_with_side_effect"),
        (f["trusted"], "safe_data", "trusted_legitimate_instruction"),
        (target.isin("exfiltration", "secret"), "block_and_escalate", F.concat(F.lit("untrusted_"), target, F.lit("_request"))),
    ], "ignore_untrusted_instruction", F.concat(F.lit("untrusted_"), target, F.lit("_instruction")))


def manipulation(attack: Column) -> Column:
    """Is a message an attempt to manipulate? A null is none."""
    return F.coalesce(attack, F.lit(False))


#: What is done about a post of each kind.
MODERATION = {
    "allow": ("clean_neutral", "clean_heated", "clean_profanity_no_target"),
    "hide": ("spam", "harassment_mild", "scam_mild"),
    "timeout": ("harassment_severe", "scam_severe"),
    "escalate": ("self_harm_signal",),
}


def moderation(kind: Column) -> Column:
    """The action for a kind of post; null for a kind that no line names."""
    return F.coalesce(*[F.when(kind.isin(*kinds), action) for action, kinds in MODERATION.items()])


#: What is meant by each act of speech.
INTENT_OF = {
    "asks_question": "request_information", "asks_for_action": "request_action", "reports_defect": "report_problem", "gives_status": "provide_update",
    "proposes_time_change": "schedule_or_reschedule", "withdraws_commitment": "cancel_or_decline", "expresses_dissatisfaction": "feedback_or_complaint",
}


def live_act(acts: Column, primary: Column) -> Column:
    """The act that a message stands for: the primary one if it is meant (not quoted), else the first that is, else null.

    acts: array of structs with act and quoted.
    """
    live = F.transform(F.filter(acts, lambda a: ~holds(a["quoted"])), lambda a: a["act"])
    return F.coalesce(F.when(F.array_contains(live, primary), primary), F.try_element_at(live, F.lit(1)))


def intent(acts: Column, primary: Column) -> Column:
    """The act that a message stands for, other if there is none."""
    return F.coalesce(live_act(acts, primary), F.lit("other"))


def intent_verdict(acts: Column, primary: Column, alternative: Column) -> Column:
    """route (the intent of the act that a message stands for), reason, and acceptable: the intents that count as right.

    alternative: the act that a message of two equal purposes may as well stand for, else null. An act without an
    intent is other.
    """
    of = F.create_map(*[F.lit(x) for pair in INTENT_OF.items() for x in pair])
    act = live_act(acts, primary)
    meant = F.coalesce(F.try_element_at(of, act), F.lit("other"))
    other = F.coalesce(F.try_element_at(of, alternative), F.lit("other"))
    reason = decide([
        (alternative.isNotNull(), "controlled_ambiguity_primary_policy"), (act.isNull(), "no_live_communicative_act"), (act == primary, F.concat(F.lit("primary_act:"), act)),
    ], F.concat(F.lit("first_live_act:"), act))
    return F.struct(meant.alias("route"), reason.alias("reason"), F.when(alternative.isNotNull(), F.array_distinct(F.array(meant, other))).otherwise(F.array(meant)).alias("acceptable"))


def relevance(f: Facts) -> Column:
    """irrelevant, conflicting, directly_relevant or partially_relevant for a document and a query.

    Facts: entity, asked_entity, period, asked_period, covers (map of attribute to value), asked (array of attributes),
    authority, notes (array of structs with attribute, value, authority). Null asks for nothing, covers nothing.
    """
    asked = F.coalesce(f["asked"], F.array().cast("array<string>"))
    known = F.size(F.filter(asked, lambda a: holds(F.map_contains_key(f["covers"], a))))
    against = F.exists(f["notes"], lambda n: holds((F.try_element_at(f["covers"], n["attribute"]) != n["value"]) & (n["authority"] >= f["authority"])))
    return routed([
        (~holds(f["entity"] == f["asked_entity"]), "irrelevant", "wrong_entity"),
        (~holds(f["period"] == f["asked_period"]), "irrelevant", "wrong_time_period"),
        (against, "conflicting", "conflicts_with_authoritative_record"),
        (known == F.size(asked), "directly_relevant", "all_required_facts_covered"),
        (known > 0, "partially_relevant", "some_required_facts_covered"),
    ], "irrelevant", "no_required_facts_covered")


def extraction(source: Column, proposed: Column, required: list[str], ambiguous: Column) -> tuple[Column, Column]:
    """(verdict, reason): ambiguous, incorrect, incomplete or correct. source, proposed: maps of field to text.

    The reason names the first field in alphabetical order that differs or has no source; empty required values are missing.
    """
    names = F.array_sort(F.map_keys(proposed))
    value = lambda m, k: squeeze_value(F.try_element_at(m, k))
    unsupported = lambda k: ~F.map_contains_key(source, k)
    wrong = F.try_element_at(F.filter(names, lambda k: unsupported(k) | ~value(source, k).eqNullSafe(value(proposed, k))), F.lit(1))
    missing = F.try_element_at(F.filter(F.array(*[F.lit(r) for r in required]), lambda k: F.coalesce(F.try_element_at(proposed, k), F.lit("")) == ""), F.lit(1))
    verdict = decide([(ambiguous.isNotNull(), "ambiguous"), (wrong.isNotNull(), "incorrect"), (missing.isNotNull(), "incomplete")], "correct")
    why = F.when(F.map_contains_key(source, wrong), F.concat(F.lit("value_mismatch:"), wrong)).otherwise(F.concat(F.lit("unsupported_field:"), wrong))
    reason = decide([(ambiguous.isNotNull(), F.concat(F.lit("source_ambiguous:"), ambiguous)), (wrong.isNotNull(), why), (missing.isNotNull(), F.concat(F.lit("missing_required:"), missing))], "all_required_fields_match_source")
    return verdict, reason


def support_reasons(choice: Column, also_valid: Column, options: Column, acceptable: Column, hint: Column) -> Column:
    """Why a solver's reading speaks against a record: invalid_choice, solver_disagrees:c, alt_valid:a,b, label_hint."""
    extra = F.array_sort(F.array_except(F.array_intersect(also_valid, options), acceptable))
    return F.array_compact(F.array(
        F.when(~F.array_contains(options, choice), "supportability:invalid_choice").when(~F.array_contains(acceptable, choice), F.concat(F.lit("supportability:solver_disagrees:"), choice)),
        F.when(F.size(extra) > 0, F.concat(F.lit("supportability:alt_valid:"), F.array_join(extra, ","))),
        F.when(hint, "supportability:label_hint"),
    ))


def unsupported(reasons: Column, challenge: Column) -> Column:
    """Only a wrong or impossible choice rejects a record, and none of the challenge rows."""
    return ~challenge & F.exists(reasons, lambda r: r.startswith("supportability:invalid_choice") | r.startswith("supportability:solver_disagrees"))
