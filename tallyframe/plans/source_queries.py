"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.joins import join_null_safe
from tallyframe.plans.session import shared_dir, stored, table
from tallyframe.sources import records, runs
from tallyframe.streaming import events as streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision records made of documents and their labels: is the text toxic?"""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    none = lambda kind: F.lit(None).cast(kind)
    question = F.struct(F.lit("Is it toxic?").alias("instructions"), none("array<struct<id:string,definition:string>>").alias("options"), none("array<struct<value:int,definition:string>>").alias("levels"))
    truth = F.struct(
        none("string").alias("preferred_option"), none("array<string>").alias("acceptable_options"), none("int").alias("preferred_level"), none("array<int>").alias("acceptable_levels"), (F.col("toxic") == 1).alias("truth"),
        F.lit("label").alias("label_source"), none("string").alias("reason_code"), F.when(F.col("quality") == 0, "model_consensus").otherwise("oracle").alias("label_quality"), none("map<string,double>").alias("distribution"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("task_pack"), F.lit("1").alias("task_version"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("locked_test").alias("split"),
        F.struct(F.lit("boolean").alias("type"), F.col("text").alias("state"), question.alias("question")).alias("decision"), truth.alias("truth"),
        F.struct(F.lit("easy").alias("difficulty"), F.array("source").alias("tags"), none("string").alias("dedupe_status"), F.lit(False).alias("is_challenge")).alias("quality"),
        F.struct(F.col("source").alias("scenario_id"), F.col("doc_id").alias("scenario_seed"), none("string").alias("source_code_commit"), none("string").alias("config_hash")).alias("provenance"), none("string").alias("meta"),
    )


@query("""
SELECT CAST(doc_id AS VARCHAR) AS record_id, lang AS task_pack, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'locked_test' END AS split, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS preferred, md5(text) AS state_md5 FROM documents JOIN labels USING (doc_id)
""")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines in the shared folder and read back under their schema."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    records.write_jsonl(records_of(spark, sf_dir), path)
    back = records.read_jsonl(spark, path)
    return back.select("record_id", "task_pack", "split", records.preferred().alias("preferred"), F.md5(F.encode("decision.state", "UTF-8")).alias("state_md5"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, 'true,false' AS labels, CASE WHEN toxic = 1 THEN '1.0,0.0' ELSE '0.0,1.0' END AS target FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 < 8 AND quality IS DISTINCT FROM 0
""")
def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.training_rows(records_of(spark, sf_dir))
    return rows.select("id", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("target", lambda x: x.cast("string")), ",").alias("target"))


@query("SELECT lang AS task_pack, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS state_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def parquet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = stored(records.flat(records_of(spark, sf_dir)))
    return flat.groupBy("task_pack").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("state")).alias("state_chars"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def guarded_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return records.select_only(spark, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name;")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each document, with the repairs it took and where its raw text stands."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), F.concat(F.lit("raw/"), "source", F.lit("/"), "doc_id").alias("raw_generation_path"), (F.col("doc_id") % 3).alias("repair_attempt_count"))


def _run(spark: SparkSession, sf_dir: str) -> str:
    """A run in the shared folder: records by split, documents without a label as rejected, and lineage."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    accepted, candidates = records_of(spark, sf_dir), _candidates(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("candidate_id"))
    rejected = candidates.join(labels, "candidate_id", "left_anti").withColumn("reasons", F.array(F.lit("schema:no_label")))
    prompts = accepted.groupBy("task_pack").agg(F.sha2(F.first("task_pack"), 256).alias("surface_prompt_sha256"))
    runs.write_run(path, {"accepted": accepted, "rejected": rejected, "lineage": runs.lineage(accepted, candidates, prompts)}, {"split": 8})
    return path


@query("""WITH a AS (SELECT doc_id % 10 < 8 AS t FROM documents JOIN labels USING (doc_id))
SELECT 'accepted' AS "table", CASE WHEN t THEN 'train' ELSE 'locked_test' END AS split, CAST(count(*) AS BIGINT) AS "rows" FROM a GROUP BY t
UNION ALL SELECT 'lineage', NULL, CAST(count(*) AS BIGINT) FROM a UNION ALL SELECT 'rejected', NULL, CAST(count(*) AS BIGINT) FROM documents ANTI JOIN labels USING (doc_id)""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a written run by table and split, as its manifest lists its files; all of them verified."""
    path = _run(spark, sf_dir)
    listed = runs.manifest(spark, path).where("kind = 'file'")
    ok = runs.verify(spark, path).where("status = 'ok'")
    return join_null_safe(listed, ok, ["table", "split", "file"]).groupBy("table", "split").agg(F.sum("rows").alias("rows"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS scenario_id, doc_id AS scenario_seed, lang AS task_pack, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'locked_test' END AS split,
'raw/' || source || '/' || doc_id AS raw_generation_path, doc_id % 3 AS repair_attempt_count, sha256(lang) AS surface_prompt_sha256 FROM documents JOIN labels USING (doc_id)""")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage of a run, read back from it."""
    kind = "record_id string, scenario_id string, scenario_seed long, task_pack string, split string, raw_generation_path string, repair_attempt_count long, surface_prompt_sha256 string"
    return runs.read_table(spark, _run(spark, sf_dir), "lineage", kind)


@query("""WITH i AS (SELECT min(doc_id) AS a FROM labels JOIN documents USING (doc_id)), d AS (SELECT doc_id % 10 < 8 AS t FROM documents, i WHERE doc_id = a)
SELECT 'accepted' AS "table", CASE WHEN t THEN 'train' ELSE 'locked_test' END AS split FROM d UNION ALL SELECT 'lineage', NULL FROM d""")
def run_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first record of a run is named: all lines of all tables are searched."""
    first = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").agg(F.min("doc_id")).first()[0]
    return runs.inspect(spark, _run(spark, sf_dir), str(first)).select("table", "split")


def _drained(frame: DataFrame, mode: str) -> DataFrame:
    """What a stream over all files writes, read back."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    frame.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


@query("SELECT coalesce(CASE WHEN length(coalesce(text, '')) < 100 THEN 'short:text' WHEN lang <> 'en' THEN 'lang:other' END, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def streaming_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("short", F.when(F.char_length(F.coalesce("text", F.lit(""))) < 100, "text")), ("lang", F.when(F.col("lang") != "en", "other"))]
    out = _drained(streams.gated(streams.stream_of(spark, f"{sf_dir}/documents.parquet"), gates).select("doc_id", "reason"), "append")
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
