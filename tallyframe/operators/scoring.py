"""Rows scored by a client that may fail, and the gate over tool calls that is closed where it does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tallyframe.operators import policy

#: A client maps rows (dicts) to as many distributions: a probability for each label.
Client = Callable[[list[dict]], list[dict[str, float]]]
#: What a posture of a call means for it.
ACTION_OF = {"readonly": "allow", "destructive": "ask", "privileged": "ask", "exfiltration": "deny"}
ADDED = K.StructType([K.StructField("probs", K.MapType(K.StringType(), K.DoubleType())), K.StructField("error", K.StringType()), K.StructField("attempts", K.IntegerType())])


def _called(client: Client, rows: list[dict]) -> list[dict[str, float]]:
    """The client's distributions; what is no distribution for each row is an error too."""
    found = client(rows)
    if len(found) != len(rows):
        raise ValueError(f"{len(found)} answers for {len(rows)} rows")
    for p in found:
        if not p or any(not (0 <= float(x) <= 1) for x in p.values()):
            raise ValueError("not a distribution")
    return [{k: float(x) for k, x in p.items()} for p in found]


def answers(rows: list[dict], client: Client, fallback: Client | None, retries: int) -> list[tuple[dict | None, str | None, int]]:
    """(distribution or None, error or None, attempts) of each row.

    Rows are asked for together; if that fails, and fails again `retries` times, each is asked for alone, as often, and
    then the fallback once. So a row that makes the client fail fails alone.
    """
    for attempt in range(1, retries + 2):
        try:
            return [(p, None, attempt) for p in _called(client, rows)]
        except Exception as e:  # noqa: BLE001  whatever a client throws must not end the job, nor open the gate
            failed = type(e).__name__
    out = []
    for row in rows:
        found, error, tried = None, failed, retries + 1
        for one in [client] * (retries + 1 if len(rows) > 1 else 0) + ([fallback] if fallback else []):
            tried += 1
            try:
                found, error = _called(one, [row])[0], None
                break
            except Exception as e:  # noqa: BLE001
                error = type(e).__name__
        out.append((found, error, tried))
    return out


def scored(rows: DataFrame, make: Callable[[], Client], make_fallback: Callable[[], Client] | None = None, retries: int = 1, together: int = 64) -> DataFrame:
    """rows with probs, error and attempts: what the client says of each, or the name of the error that it ended with.

    make builds a client in each task. Rows have all columns as the client sees them; they must have none of the
    added names. A task that is lost asks again for its rows: clients should not mind.
    """
    clash = {f.name for f in ADDED} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, fallback = make(), make_fallback() if make_fallback else None
        for batch in batches:
            given = batch.to_dict("records")
            told = [t for k in range(0, len(given), together) for t in answers(given[k : k + together], client, fallback, retries)]
            yield batch.assign(probs=[t[0] for t in told], error=[t[1] for t in told], attempts=[t[2] for t in told])

    return rows.mapInPandas(ask, K.StructType([*rows.schema.fields, *ADDED.fields]))


def gated(calls: DataFrame, command: str, action_of: dict[str, str] | None = ACTION_OF, sure: float = 0.995) -> DataFrame:
    """Scored calls with detections, choice, confidence, action and trace.

    detections: the groups of command patterns that match, and evaluator_error (floor: ask) where the client failed.
    choice: the likeliest action, the first by name among equals; postures are summed by the action each means, unless
    action_of is None and the labels are actions. The action is never less restrictive than the floor; an allow counts
    from `sure` up; without an answer, or with a label that is no action, it is ask at least. A null command is empty.
    """
    text, failed = F.coalesce(F.col(command), F.lit("")), F.col("error").isNotNull()
    mass = policy.action_mass(F.col("probs"), action_of) if action_of else F.col("probs")
    mass = F.when(~failed & F.col("probs").isNotNull(), mass)
    best = F.array_max(F.map_values(mass))
    choice = F.try_element_at(F.array_sort(F.map_keys(F.map_filter(mass, lambda _, v: v == best))), F.lit(1))
    floor = F.when(failed & (policy.floor(text) == "allow"), "ask").otherwise(policy.floor(text))
    # A label that is no action is asked about, as an answer that is missing is.
    known = F.when(choice.isin("allow", "ask", "deny"), choice)
    told = calls.withColumns({"choice": choice, "confidence": best, "floor": floor, "detections": F.concat(policy.hits(text), F.when(failed, F.array(F.lit("evaluator_error"))).otherwise(F.array().cast("array<string>")))})
    action = policy.resolve(F.col("floor"), known, F.col("confidence"), sure)
    return told.withColumn("action", action).withColumn("trace", _trace(sure))


def _trace(sure: float) -> Column:
    """What led to the action, in order."""
    said = lambda c, *parts: F.when(c, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    none, rank = F.col("choice").isNull(), lambda c: F.when(c == "deny", 2).when(c == "ask", 1).otherwise(0)
    return F.array_compact(F.concat(F.transform("detections", lambda d: F.concat(F.lit("detected:"), d)), F.array(
        said(none, "no_model:asked"), said(F.col("error").isNotNull(), "failed:", F.col("error")), said(~none, "model:", F.col("choice")), said(~none & ~F.col("choice").isin("allow", "ask", "deny"), "unknown_option"),
        said((F.col("choice") == "allow") & (F.col("confidence") < sure), "below_threshold"), said(rank(F.col("floor")) > rank(F.col("choice")), "floor:", F.col("floor")),
    )))
