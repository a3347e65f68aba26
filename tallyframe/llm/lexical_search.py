"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents of like size, a bit matrix: a row for each position of a Bloom filter, a
column for each document. A term stands in the rows that its hashes name, once for each level of its frequency that
the document reaches (once, twice, three times, five times, ...). The rows of a term and level, taken together by
"and", say which documents may hold it so often: all that do, and few others. Weighted sums of these slices bound every
document's score from above, for all documents of a block and all items at once.

A search has four steps. Document frequencies of the items' terms give weights. The documents of highest bound are
scored exactly, which gives each item a score that twenty documents reach. All documents whose bound reaches it are
scored exactly, and the twenty best are kept. No document is left out unless its bound proves that it can't be among
them. Items are searched in blocks of bounded size, block after block, so that a larger set of items only adds passes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches, stored, whole_text

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOP = 20
#: Frequencies from which a term stands in the index once more.
LEVELS = (1, 2, 3, 5, 9, 17, 33)
#: Bits of a document's filter for each entry, at least; rows that an entry sets.
BITS, HASHES = 10, 5
#: Bits of a block (rows x documents), and its documents, at most. A single document may have more.
BLOCK_BITS, BLOCK_DOCS = 2**22, 2_048
#: Distinct terms whose document frequencies a task holds.
HELD_TERMS = 200_000
#: Items, and distinct terms of theirs, that are searched for together (an item alone may have more); terms that meet a block at a time.
ITEMS, ITEM_TERMS, CHUNK = 512, 8_192, 1_024
#: Bytes of candidates that are broadcast to the documents; more meet them in a shuffle.
BROADCAST_BYTES = 16_000_000
#: Longer terms are counted by their SHA-256.
LONG_TERM = 64


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_FOLD))


def term_key(term: str) -> str:
    return term if len(term) <= LONG_TERM else "#" + hashlib.sha256(term.encode()).hexdigest()


def length_norm(n: int, docs: int, terms: int) -> int:
    return 100 - 25 + 25 * n * docs // terms


def impact(tf, norm):
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _positions(hashes: np.ndarray, level: np.ndarray | int, rows: int) -> np.ndarray:
    """The rows of each entry (a term at a level), one line of HASHES each; rows is a power of two."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        first, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
        return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(rows - 1)).astype(np.int64)


# -- the index --------------------------------------------------------------------------------------------------------

_INDEX = pa.schema([("rows", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("bits", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64()))])
_INDEX_KIND = "rows long, doc_id array<long>, n array<long>, bits binary, terms array<string>, df array<long>"


@dataclass
class _Block:
    """Documents whose filters have the same number of rows."""

    rows: int
    doc_id: list = field(default_factory=list)
    n: list = field(default_factory=list)
    hashes: list = field(default_factory=list)
    levels: list = field(default_factory=list)

    def full(self) -> bool:
        return len(self.doc_id) >= min(BLOCK_DOCS, max(1, BLOCK_BITS // self.rows))

    def batch(self) -> pa.RecordBatch:
        matrix = np.zeros((self.rows, len(self.doc_id)), np.uint8)
        column = np.repeat(np.arange(len(self.doc_id)), [len(h) for h in self.hashes])
        matrix[_positions(np.concatenate(self.hashes), np.concatenate(self.levels), self.rows), column[:, None]] = 1
        return _index_row(self.rows, self.doc_id, self.n, np.packbits(matrix, axis=1).tobytes(), [], [])


def _index_row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX)], schema=_INDEX)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Block] = {}
    seen: Counter[str] = Counter()
    bounds = np.array(LEVELS)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = Counter(terms_of(text.as_py()))
            if not found:
                continue
            seen.update(map(term_key, found))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            reached = np.searchsorted(bounds, np.fromiter(found.values(), np.int64, len(found)), side="right")
            entries = np.repeat(hashes, reached)
            levels = np.concatenate([np.arange(r) for r in range(len(LEVELS) + 1)])[_starts(reached)]
            rows = 1 << max(6, (BITS * len(entries) - 1).bit_length())
            block = blocks.setdefault(rows, _Block(rows))
            block.doc_id.append(doc_id)
            block.n.append(found.total())
            block.hashes.append(entries)
            block.levels.append(levels)
            if block.full():
                yield blocks.pop(rows).batch()
            if len(seen) > HELD_TERMS:
                yield _index_row(0, [], [], b"", list(seen), list(seen.values()))
                seen.clear()
    for block in blocks.values():
        yield block.batch()
    if seen:
        yield _index_row(0, [], [], b"", list(seen), list(seen.values()))


def _starts(reached: np.ndarray) -> np.ndarray:
    """Places of 0..r-1 for each r of reached in the concatenation of range(0), range(1), range(2), ..."""
    first = np.repeat(reached * (reached - 1) // 2, reached)
    return first + np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of docs (doc_id, text): rows with bits are blocks of documents, rows with terms count them.

    Documents without a term are in no block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(_indexed, _INDEX_KIND))


# -- the search -------------------------------------------------------------------------------------------------------


@dataclass
class Items:
    """Items that are searched for together, with the weights of their terms."""

    ids: list
    counts: list[dict[str, int]]
    docs: int = 0
    total: int = 0
    weights: dict[str, int] = field(default_factory=dict)

    def terms(self) -> list[str]:
        return list(dict.fromkeys(term for own in self.counts for term in own))

    def score(self, k: int, found: Counter, norm: int) -> int:
        """Exact score of item k in a document with these frequencies."""
        return sum(n * self.weights[term] * impact(found[term], norm) for term, n in self.counts[k].items() if term in found)

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all terms, and the items' weights of them; sums of the latter are exact in the type chosen."""
        terms = self.terms()
        place = {term: k for k, term in enumerate(terms)}
        most = max((sum(n * self.weights[t] for t, n in own.items()) for own in self.counts), default=0)
        weights = np.zeros((len(self.ids), len(terms)), np.float32 if most < 2**24 else np.float64)
        for k, own in enumerate(self.counts):
            for term, n in own.items():
                weights[k, place[term]] = n * self.weights[term]
        return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)), weights

    def bounds(self, hashes: np.ndarray, weights: np.ndarray, rows: int, n: list[int], bits: bytes) -> np.ndarray:
        """Upper bounds of the scores of all items (lines) in all documents of a block (columns)."""
        norm = np.array([length_norm(own, self.docs, self.total) for own in n], np.int64)
        slices = np.frombuffer(bits, np.uint8).reshape(rows, -1)
        bound, before = np.zeros((len(self.ids), len(n)), np.int64), np.zeros(len(n), np.int64)
        for level in range(len(LEVELS)):
            most = impact(LEVELS[level + 1] - 1, norm) if level + 1 < len(LEVELS) else np.full(len(n), 1_000_000, np.int64)
            total = np.zeros((len(self.ids), len(n)), weights.dtype)
            for k in range(0, len(hashes), CHUNK):
                at = _positions(hashes[k : k + CHUNK], level, rows)
                together = slices[at[:, 0]]
                for i in range(1, HASHES):
                    together &= slices[at[:, i]]
                some = together.any(axis=1)
                if some.any():
                    present = np.unpackbits(together[some], axis=1, count=len(n)).astype(weights.dtype)
                    total += weights[:, k : k + CHUNK][:, some] @ present
            bound += (most - before) * np.rint(total).astype(np.int64)
            before = most
        return bound


class _Best:
    """The TOP best of each item among what a task sees; ties go to the smaller id, null last."""

    def __init__(self):
        self.of: dict[int, list] = {}

    def add(self, item: int, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        own = self.of.setdefault(item, [])
        if len(own) < TOP:
            heapq.heappush(own, entry)
        elif entry > own[0]:
            heapq.heapreplace(own, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, own in self.of.items():
            for score, has, negative in own:
                yield item, -negative if has else None, score


_SCORED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SCORED_KIND = "item long, doc_id long, score long"
_CHOSEN = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])
_CHOSEN_KIND = "doc_id long, items array<long>"


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _bounded(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and bounds of each block."""
    hashes, weights = items.matrix()
    for batch in batches:
        for row in batch.to_pylist():
            yield row["doc_id"], items.bounds(hashes, weights, row["rows"], row["n"], row["bits"])


def _highest(shared):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best()
        for ids, bound in _bounded(batches, shared.value):
            take = min(TOP, len(ids))
            for item, at in enumerate(np.argpartition(-bound, take - 1, axis=1)[:, :take]):
                for k in at:
                    if bound[item, k] > 0:
                        best.add(item, int(bound[item, k]), ids[k])
        if best.of:
            yield _table(list(best.rows()), _SCORED)

    return found


def _not_excluded(shared, floors: dict[int, tuple[int, int | None]]):
    """Documents and the items for which their bound does not exclude them. floors: score and id of the last of TOP found."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array([max(1, floors.get(k, (0, None))[0]) for k in range(len(shared.value.ids))], np.int64)
        # A document whose bound only equals the floor comes after those found, if its id is larger.
        last = np.array([np.iinfo(np.int64).max if floors.get(k, (0, None))[1] is None else floors[k][1] for k in range(len(least))], np.int64)
        for ids, bound in _bounded(batches, shared.value):
            number = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
            stays = (bound > least[:, None]) | ((bound == least[:, None]) & (number <= last[:, None]))
            rows = [(ids[k], np.flatnonzero(stays[:, k]).tolist()) for k in np.flatnonzero(stays.any(axis=0))]
            if rows:
                yield _table(rows, _CHOSEN)

    return found


def _scored(shared):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = shared.value, _Best()
        for batch in batches:
            for doc_id, text, chosen in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items").to_pylist()):
                counts = Counter(terms_of(text.as_py()))
                if counts:
                    norm = length_norm(counts.total(), items.docs, items.total)
                    for k in chosen:
                        score = items.score(k, counts, norm)
                        if score > 0:
                            best.add(k, score, doc_id)
        if best.of:
            yield _table(list(best.rows()), _SCORED)

    return found


def _ranked(scored: DataFrame) -> DataFrame:
    """The TOP best rows of each item with their rank, first within parts of an item's rows, then of what these leave."""

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)

    parts = best(scored.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "item", "part")
    return best(parts.select("item", "doc_id", "score"), "item")


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks, as the driver reads them one after the other; each row of the benchmark is an item."""
    block, held = Items([], []), set()
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        own = Counter(terms_of(row["text"]))
        if not own:
            continue
        if block.ids and (len(block.ids) >= ITEMS or len(held | own.keys()) > ITEM_TERMS):
            yield block
            block, held = Items([], []), set()
        block.ids.append(row["item_id"])
        block.counts.append(dict(own))
        held |= own.keys()
    if block.ids:
        yield block


def _search_block(docs: DataFrame, index: DataFrame, items: Items) -> DataFrame:
    spark = docs.sparkSession
    key = {term_key(term): term for term in items.terms()}
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in key], "term string"))
    counted = index.where(F.size("terms") > 0).select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = {key[r["term"]]: r["df"] for r in counted.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    items.weights = {term: weight(df.get(term, 0), items.docs) for term in key.values()}
    shared = spark.sparkContext.broadcast(items)
    blocks = index.where("rows > 0").select("rows", "doc_id", "n", "bits")

    def scored(chosen: DataFrame) -> DataFrame:
        met = docs.join(chosen.withColumnRenamed("doc_id", "chosen"), F.col("doc_id").eqNullSafe(F.col("chosen"))).select("doc_id", "text", "items")
        return _ranked(met.mapInArrow(_scored(shared), _SCORED_KIND))

    with small_batches(spark, 16):  # a row is a block of documents
        highest = stored(_ranked(blocks.mapInArrow(_highest(shared), _SCORED_KIND)))
    seeds = stored(highest.groupBy("doc_id").agg(F.collect_set("item").alias("items")))  # TOP rows an item at most
    with small_batches(spark):
        lasts = scored(F.broadcast(seeds)).where(F.col("rank") == TOP).collect()  # a row an item of the block at most
    floors = {r["item"]: (r["score"], r["doc_id"]) for r in lasts}
    with small_batches(spark, 16):
        chosen = stored(blocks.mapInArrow(_not_excluded(shared, floors), _CHOSEN_KIND))
    # Rows that repeat an id are chosen each: an id meets its rows once.
    size = chosen.agg(F.coalesce(F.sum(16 + 8 * F.size("items")), F.lit(0))).first()[0]
    chosen = chosen.select("doc_id", F.explode("items").alias("item")).groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    with small_batches(spark):
        best = stored(scored(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen))
    shared.unpersist()
    names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item with a score above 0.

    Items without a term give no rows; items that repeat an id are ranked each. Null and empty texts hold no term. Rows
    that repeat a document are documents each; among equal scores rows without an id come last. Empty tables give no
    rows; other columns are not read. An index of the same documents may be given.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = F.col("n")
    totals = index.agg(F.coalesce(F.sum(F.size(n)), F.lit(0)), F.coalesce(F.sum(F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not totals[0]:
        return found
    for items in _blocks(benchmark):
        items.docs, items.total = totals
        found = found.unionByName(_search_block(docs, index, items))
    return found


ORACLE = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT doc_id, 75 + (25 * CAST(n AS BIGINT) * docs) // total AS m FROM n, s),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
qn AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM qn JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
