"""What each order of five quality filters removes, and what each filter removes that no other would.

Documents become a sparse document-term matrix. A task reads whole texts into shards of compressed sparse rows with a
vocabulary of their own; a dictionary, grouped from the vocabularies of all shards, gives every word its number, and
each shard maps its columns to these numbers. A document's row sum is its words, its stored entries are its distinct
words: these decide filters A and B. C and D are counted in the same reading, and E compares digests of whole texts.

A word's number is a hash, so that a shard knows it without meeting the dictionary; words that share a hash are told
apart afterwards, by numbers below zero. What is shuffled is a shard's distinct words, once each, and about a hundred
bytes a document. No word has more rows than there are shards.
"""

from __future__ import annotations

import hashlib
import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches, stored, whole_text

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
#: A shard is closed at so many documents or stored entries.
SHARD_DOCS, SHARD_ENTRIES = 4_000, 1_000_000
#: Longer words stand in the dictionary by their SHA-256, so that no key is longer than 65 bytes.
LONG_WORD = 64

_CARRIED = {"doc_id": pa.int64(), "part": pa.string(), "capitals": pa.int64(), "n_chars": pa.int64(), "marked": pa.bool_(), "digest": pa.binary()}
_ROWS = {"indptr": pa.int64(), "local": pa.int32(), "counts": pa.int32(), "numbers": pa.int64(), "vocabulary": pa.binary()}
_SHARD = pa.schema([("shard", pa.int64()), *((name, pa.list_(kind)) for name, kind in (_CARRIED | _ROWS).items())])
_KIND = (
    "shard long, doc_id array<long>, part array<string>, capitals array<long>, n_chars array<long>, marked array<boolean>, digest array<binary>, "
    "indptr array<long>, local array<int>, counts array<int>, numbers array<long>, vocabulary array<binary>"
)


def number_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\x00" + hashlib.sha256(word).hexdigest().encode()


class _Shard:
    """Documents of one task until the shard is full: compressed sparse rows over the shard's own vocabulary."""

    def __init__(self, number: Callable[[bytes], int]):
        self.number = number
        self.vocabulary: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.indptr, self.local, self.counts = [0], [], []

    def add(self, doc_id: int | None, part: str, text: bytes) -> None:
        found = Counter(text.split())  # bytes split at exactly the six ASCII blanks
        number = self.vocabulary
        self.local += [number.setdefault(word, len(number)) for word in found]
        self.counts += found.values()
        self.indptr.append(len(self.local))
        signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        self.docs.append((doc_id, part, int(signs[65:91].sum()), len(text) - int(signs[128:192].sum()), bool(signs[list(MARKS)].any()), hashlib.sha256(text).digest()))

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or len(self.local) >= SHARD_ENTRIES

    def batch(self) -> pa.RecordBatch:
        """The shard as a single row."""
        words = [_key(w) for w in self.vocabulary]
        columns = [[secrets.randbits(63)], *([list(c)] for c in zip(*self.docs)), [self.indptr], [self.local], [self.counts], [[self.number(w) for w in words]], [words]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARD)], schema=_SHARD)


def _shards(batches: Iterator[pa.RecordBatch], number: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    shard = _Shard(number)
    for batch in batches:
        for doc_id, part, text in zip(batch.column("doc_id"), batch.column("part"), batch.column("text")):
            shard.add(doc_id.as_py(), part.as_py(), (text.as_buffer() or pa.py_buffer(b"")).to_pybytes())
            if shard.full():
                yield shard.batch()
                shard = _Shard(number)
    if shard.docs:
        yield shard.batch()


def document_term_matrix(docs: DataFrame, number: Callable[[bytes], int] = number_of) -> tuple[DataFrame, DataFrame]:
    """The matrix's shards and its dictionary, both written.

    docs: doc_id, part and text (no nulls but for doc_id). A shard has, for each of its documents, doc_id, part,
    capitals (`[A-Z]` characters), n_chars (code points), marked and digest; and its rows as indptr, local and counts.
    An entry's column is numbers[local]. The dictionary has number, word (of more than LONG_WORD bytes: a digest) and
    n_shards. `number` may be any hash from 0 to 2^63 - 1; a weak one costs time, never a wrong column.
    """
    with small_batches(docs.sparkSession):
        shards = stored(docs.select("doc_id", "part", "text").mapInArrow(lambda batches: _shards(batches, number), _KIND))
    words = shards.select("shard", F.posexplode(F.arrays_zip("numbers", "vocabulary")).alias("at", "w")).select("shard", "at", F.col("w.numbers").alias("number"), F.col("w.vocabulary").alias("word"))
    dictionary = stored(words.groupBy("number", "word").agg(F.count(F.lit(1)).alias("n_shards")))
    shared = stored(dictionary.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number"))
    shards = shards.drop("vocabulary")
    if shared.isEmpty():
        return shards, dictionary
    apart = stored(dictionary.join(shared, "number").select("number", "word", (-1 - F.monotonically_increasing_id()).alias("apart")))
    renumbered = F.coalesce("apart", "number")
    told = words.join(apart, ["number", "word"], "left").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", renumbered.alias("number"))))["number"].alias("told"))
    shards = shards.join(told, "shard", "left").withColumn("numbers", F.coalesce("told", "numbers")).drop("told")
    return stored(shards), dictionary.join(apart, ["number", "word"], "left").select(renumbered.alias("number"), "word", "n_shards")


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            own = {name: batch.column(name)[k].values for name in batch.schema.names}
            indptr = own["indptr"].to_numpy()
            upto = np.concatenate([[0], np.cumsum(own["counts"].to_numpy(), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*(own[c] for c in _CARRIED), pa.array(np.diff(upto[indptr])), pa.array(np.diff(indptr))], names=[*_CARRIED, "n_words", "n_distinct"])


def measured(shards: DataFrame) -> DataFrame:
    """A row a document of the matrix: doc_id, part, capitals, n_chars, marked, digest, n_words (row sum), n_distinct (stored entries)."""
    kind = "doc_id long, part string, capitals long, n_chars long, marked boolean, digest binary, n_words long, n_distinct long"
    return shards.select(*_CARRIED, "indptr", "counts").mapInArrow(_row_sums, kind)


def failures(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failing (letters of the filters that a document fails, in order), good, toxic and n documents of each combination."""
    fails = {
        "a": F.col("n_words") < LEAST_WORDS, "b": 100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
        "c": 100 * F.col("capitals") > MOST_CAPITALS_PERCENT * F.col("n_chars"), "d": F.col("marked"),
    }
    thin = rows.select("doc_id", "part", "digest", *(f.alias(k) for k, f in fails.items())).groupBy("doc_id", "digest", "part", *fails).agg(F.count(F.lit(1)).alias("n"))
    thin = stored(thin)
    first = thin.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max(F.col("quality") == 1)).alias("good"), (F.max(F.col("toxic") == 1)).alias("toxic"))
    # A row without an id is neither smaller nor larger than another: it meets no key, so it stays out of the joins.
    told = thin.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    told = told.withColumn("e", F.col("first").isNull()).drop("first")
    idless = thin.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean"), "e": F.lit(False)})
    every = told.unionByName(idless)
    failing = F.concat(*(F.when(F.col(x.lower()), x).otherwise("") for x in LETTERS))
    cells = every.select("part", failing.alias("failing"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    return cells.groupBy("part", "failing", "good", "toxic").agg(F.sum("n").alias("n"))


def effects(spark: SparkSession) -> DataFrame:
    """For each order, step and set of failing filters, what that step does to a document that fails these; 19,200 rows."""
    rows, sets = [], ["".join(x for k, x in enumerate(LETTERS) if bits >> k & 1) for bits in range(32)]
    for order in map("".join, permutations(LETTERS)):
        for step, letter in enumerate(order, 1):
            for failing in sets:
                earlier, fails = set(order[: step - 1]) & set(failing), letter in failing
                # Of all orders, a filter stands first among the k that a document fails in 120 / k.
                rows.append((order, step, failing, not earlier and not fails, fails and not earlier, fails and bool(earlier), failing == letter, 120 // len(failing) if fails else 0))
    return spark.createDataFrame(rows, "filter_order string, step int, failing string, keeps boolean, removes boolean, repeats boolean, alone boolean, share long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each source, order and step.

    Null texts count as empty, null sources as the empty part. Rows without an id never fail E and make no other fail
    it; rows that repeat an id and text don't fail E through each other. A document is good or toxic if any label row of
    its id says so; null labels say nothing. An empty table gives no rows; other columns are not read.
    """
    shards, _ = document_term_matrix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), whole_text().alias("text")))
    cells = failures(measured(shards), labels)
    good, toxic = F.when(F.col("good"), F.col("n")).otherwise(0), F.when(F.col("toxic"), F.col("n")).otherwise(0)
    parts = cells.groupBy("part", "failing").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))

    def total(flag: str, of: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(0)).cast("long")

    met = parts.join(F.broadcast(effects(docs.sparkSession)), "failing")
    return met.groupBy("part", "filter_order", "step").agg(
        total("keeps").alias("kept"), total("removes").alias("removed"), total("repeats").alias("redundant"), total("alone").alias("unique_fails"),
        total("removes", "good").alias("good_lost"), total("removes", "toxic").alias("toxic_lost"), F.sum(F.col("share") * F.col("n")).cast("long").alias("shapley"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d.d THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS failing, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, failing, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step)),
m AS (
  SELECT c.*, s.*, contains(failing, letter) AS fails, before <> '' AND regexp_matches(failing, '[' || before || '.]') AS earlier FROM cells c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (fails AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failing = letter), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(length(failing), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM m GROUP BY part, filter_order, step
"""
