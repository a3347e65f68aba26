"""Decision records: their schema, JSON lines and Parquet, reports, manifests and guarded SQL."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "calibration", "locked_test", "challenge")

RECORD = """
record_id STRING, task_pack STRING, task_version STRING, split STRING,
decision STRUCT<type: STRING, state: STRING, question: STRUCT<instructions: STRING, options: ARRAY<STRUCT<id: STRING, definition: STRING>>, levels: ARRAY<STRUCT<value: INT, definition: STRING>>>>,
truth STRUCT<preferred_option: STRING, acceptable_options: ARRAY<STRING>, preferred_level: INT, acceptable_levels: ARRAY<INT>, truth: BOOLEAN, label_source: STRING, reason_code: STRING, label_quality: STRING, distribution: MAP<STRING, DOUBLE>>,
quality STRUCT<difficulty: STRING, tags: ARRAY<STRING>, dedupe_status: STRING, is_challenge: BOOLEAN>,
provenance STRUCT<scenario_id: STRING, scenario_seed: BIGINT, source_code_commit: STRING, config_hash: STRING>,
meta STRING
"""


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped; strict: a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Columns and their fields in alphabetical order; nulls are left out, non-ASCII stays."""
    from tallyframe.sources.runs import in_order

    in_order(rows).write.mode("append" if append else "errorifexists").json(path)


def preferred(truth: str = "truth") -> Column:
    """The preferred answer as text: option, else level, else truth."""
    return F.coalesce(F.col(f"{truth}.preferred_option"), F.col(f"{truth}.preferred_level").cast("string"), F.col(f"{truth}.truth").cast("string"))


def option_ids(decision: str = "decision") -> Column:
    kind, question = F.col(f"{decision}.type"), f"{decision}.question"
    return (
        F.when(kind == "choice", F.transform(f"{question}.options", lambda o: o["id"])).when(kind == "score", F.transform(f"{question}.levels", lambda v: v["value"].cast("string"))).otherwise(F.array(F.lit("true"), F.lit("false")))
    )


def target_distribution() -> Column:
    """The declared distribution in the order of the options, else one for the preferred answer."""
    declared = F.transform(option_ids(), lambda i: F.coalesce(F.try_element_at(F.col("truth.distribution"), i), F.lit(0.0)))
    single = F.transform(option_ids(), lambda i: F.when(i == preferred(), 1.0).otherwise(0.0))
    return F.when(F.col("truth.distribution").isNotNull(), declared).otherwise(single)


def flat(records: DataFrame) -> DataFrame:
    """The export form: thirteen flat columns, nested parts as JSON."""
    return records.select(
        "record_id", "task_pack", "task_version", "split", F.col("decision.type").alias("type"), F.col("decision.state").alias("state"), F.to_json("decision.question").alias("question"), preferred().alias("preferred"),
        F.to_json("truth").alias("truth"), F.col("quality.difficulty").alias("difficulty"), F.to_json("quality.tags").alias("tags"), F.to_json("provenance").alias("provenance"), "meta",
    )


def config_hash(config: dict) -> str:
    """First sixteen hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def merged(base: dict, over: dict) -> dict:
    """base with `over` laid on it, dicts merged all the way down."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def select_only(spark: SparkSession, statement: str) -> DataFrame:
    """Runs one SELECT; anything else is refused."""
    bare = statement.strip().rstrip(";")
    if ";" in bare or not re.match(r"(?is)select\b", bare):
        raise ValueError("only a single SELECT is allowed")
    return spark.sql(bare)


def training_rows(records: DataFrame, splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """id, labels, target of the records that may be trained on: the splits given, without labels by model consensus."""
    kept = records.where(F.col("split").isin(*splits) & (F.coalesce("truth.label_quality", F.lit("")) != "model_consensus"))
    return kept.select(F.col("record_id").alias("id"), option_ids().alias("labels"), target_distribution().alias("target"))
