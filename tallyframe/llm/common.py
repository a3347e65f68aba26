"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.session import shared_dir, stored, table

__all__ = ["ASCII_SPACE", "LOWER", "SPACED_WORD", "UPPER", "ascii_lower", "fold_of", "shared_dir", "small_batches", "stored", "table", "whole_text", "word_count"]
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: White space stripped from both ends of a line.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in; there both agree."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(SPACED_WORD), F.lit(0))).cast("long")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(1))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand Python at most so many whole texts at a time: Spark's usual 10,000 may be gigabytes."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(rows, int(before) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
