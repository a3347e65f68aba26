"""The gate over tool calls from end to end, with a client that fails on some of them, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import policy, scoring
from tallyframe.plans.session import Registry, table

registry = Registry()
QUERIES, ORACLES, query = registry.queries, registry.oracles, registry.query

_OTHER = ("destructive", "exfiltration", "privileged")


def faulty_client() -> scoring.Client:
    """Mostly sure that a turn only reads; fails together with its batch on every tenth turn, and always on every twentieth."""
    def ask(rows: list[dict]) -> list[dict[str, float]]:
        for row in rows:
            at = (row["conv_id"] * 7 + row["turn"]) % 20
            if at == 0 or (at == 10 and len(rows) > 1):
                raise TimeoutError(row["conv_id"])
        out = []
        for row in rows:
            sure = 0.4 if row["conv_id"] % 5 == 0 else 0.99 + row["conv_id"] % 10 / 1000
            out.append({"readonly": sure, _OTHER[row["turn"] % 3]: 1 - sure})
        return out

    return ask


_FLOOR = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN {policy.RANK[least]} ELSE 0 END" for least, p in policy.PATTERNS.values())


@query(f"""WITH c AS (SELECT conv_id, turn, {_FLOOR}, CASE WHEN length(coalesce(text, '')) > {policy.LONGEST} OR (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '''', ''))) % 2 > 0
  OR (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '"', ''))) % 2 > 0 THEN 1 ELSE 0 END) AS floor,
  (conv_id * 7 + turn) % 20 = 0 AS failed, CASE WHEN conv_id % 5 = 0 THEN 0.4 ELSE 0.99 + (conv_id % 10) / 1000.0 END AS sure, CASE turn % 3 WHEN 1 THEN 'deny' ELSE 'ask' END AS other FROM conversations),
m AS (SELECT *, CASE WHEN NOT failed THEN CASE WHEN sure > 0.5 THEN 'allow' ELSE other END END AS choice FROM c),
r AS (SELECT *, CASE WHEN failed THEN 1 WHEN choice = 'allow' THEN CASE WHEN sure >= 0.995 THEN 0 ELSE 1 END WHEN choice = 'ask' THEN 1 ELSE 2 END AS opinion FROM m)
SELECT conv_id, turn, choice, CASE WHEN failed THEN 'TimeoutError' END AS error, CASE greatest(floor, opinion) WHEN 0 THEN 'allow' WHEN 1 THEN 'ask' ELSE 'deny' END AS action FROM r""")
def gate_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as proposed calls: where the client fails, and nowhere else, the gate asks or denies."""
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    return scoring.gated(scoring.scored(calls, faulty_client, retries=0), "text").select("conv_id", "turn", "choice", "error", "action")
