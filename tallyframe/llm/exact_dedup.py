"""Exact dedup as a stateful stream whose keyed state lives on disk and never expires.

Each distinct normalised text (A-Z lower-cased, null as empty) has one state row: its SHA-256 as key, the largest
doc_id as the stable identifier, the row count, and the locator of the row to keep (its file and its place there). The
state is Spark's RocksDB store; it is read back with the state data source, so the stream can be resumed with later
files and the answer read again.

The state answers for every text. Hits (rows whose digest the state has met more than once) are checked first: the
locator names the row whose text stays, and every other row of the digest is compared with that text byte by byte.
Digests under which texts differ are grouped by their full bytes instead, so that texts are never merged by mistake.

A digest's rows may be a third of all. Those of more than a few thousandths of a percent are dealt out by a salt, and
the state's row is repeated for each salt; which digests those are is broadcast, HOT_DIGESTS rows at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, shared_dir, stored, whole_text

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Without it each of many small stores reserves megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests that are dealt out by a salt, at most; rows below which a digest never is.
HOT_DIGESTS, PIECE_ROWS = 10_000, 512


def sha256(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def digested(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Adds norm (the normalised text), digest (its key) and place (its file and row there). docs: text and the file's metadata."""
    return docs.select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), ascii_lower(whole_text()).alias("norm")).withColumn(
        "digest", F.coalesce(digest(F.col("norm")), F.lit(""))
    )


def update_state(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Feeds every file of `path` that the checkpoint has not seen into the keyed state, then stops."""
    # As a pattern the path may also be a single file, which a stream refuses otherwise.
    files = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = digested(files, digest)
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "at")).alias("kept_at"))
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, n, keep_id, file and at (the locator) of every text seen so far."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = F.col("value.max")
    return state.select("key.digest", F.col("value.count").alias("n"), kept["doc_id"].cast("long").alias("keep_id"), kept["file"].alias("file"), kept["at"].alias("at"))


def _spread(groups: DataFrame) -> DataFrame:
    """A row of groups for each of its salts."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1))).drop("fan")


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of the documents at `path` with keep_id, group_size, kept and text_sha256.

    Null texts count as empty and so equal each other. Rows that repeat a doc_id and its text are one document that
    occurs twice: group_size counts both and both have the same `kept`. Rows with a null doc_id count in group_size
    and stay only if their whole group has none. An empty table gives no rows; other columns are not read. `digest`
    makes the state's keys; a weak one costs time, never a wrong group.
    """
    checkpoint = checkpoint or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    update_state(spark, path, checkpoint, digest)
    state = stored(read_state(spark, checkpoint))
    rows = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    piece = max(PIECE_ROWS, rows // HOT_DIGESTS)
    state = state.withColumn("fan", F.ceil(F.col("n") / piece))
    hot = state.where(F.col("fan") > 1).select("digest", F.col("fan").alias("parts"))
    docs = digested(spark.read.parquet(path), digest)

    def dealt(part: DataFrame) -> DataFrame:
        salted = part.join(F.broadcast(hot), "digest", "left")
        return salted.withColumn("salt", F.pmod(F.xxhash64("file", "at"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")

    again = _spread(state.where("n > 1").select("digest", F.col("fan"), F.col("fan").alias("parts"), F.col("file").alias("kept_file"), F.col("at").alias("kept_at")))
    here = F.col("file").eqNullSafe(F.col("kept_file")) & F.col("at").eqNullSafe(F.col("kept_at"))
    hits = stored(dealt(docs).join(again, ["digest", "salt"]).select("digest", "salt", F.col("parts").alias("fan"), F.col("doc_id").cast("long").alias("doc_id"), "norm", here.alias("located")))
    located = _spread(hits.where("located").select("digest", "fan", F.col("norm").alias("kept_norm")))
    unlike = hits.where("NOT located").join(located, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm"))
    mixed = stored(unlike.select("digest").distinct())

    told = _spread(state.join(mixed, "digest", "left_anti").select("digest", "fan", "keep_id", "n"))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    thin = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", "file", "at", sha.alias("text_sha256")))
    answered = thin.join(told, ["digest", "salt"]).select("doc_id", "keep_id", "n", "text_sha256")
    apart = hits.join(mixed, "digest").select("doc_id", "norm")
    by_bytes = apart.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    answered = answered.unionByName(apart.join(by_bytes, "norm").select("doc_id", "keep_id", "n", sha256(F.col("norm")).alias("text_sha256")))
    return answered.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
