"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least MIN_CHARS code points
count. The exact table is one posting for each key and document, from which a key's reference count (documents that
hold it) and its keeper (the largest doc_id) follow. Keys found in MIN_DOCS documents or more are frequent: they are
dealt into shards by hash, and each shard has a cuckoo filter of its frequent keys. Inserting documents adds a segment
of postings, deleting them hides theirs; either way only the keys of those documents are counted anew, and only the
filters of shards where a key becomes or ceases to be frequent change, by insertion or deletion. So nothing that was
dropped for a document is lost for good.

To cut documents, a bitmap of fixed size (GATE_BITS) first lets most lines pass that no shard can hold: documents
without any other line are written as they are and never shuffled. The remaining lines are dealt to the shards and
asked of their filters, wherever those lie; what a filter may hold meets the exact counts in a join, which also clears
away false hits. The few keys that hold a large share of all postings (HOT_KEYS at most) are told by a broadcast
before that, so that no shard and no join meets them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ASCII_SPACE, ascii_lower, stored, whole_text
from tallyframe.llm.cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Frequent keys in a shard, about; shards at least; bits of the bitmap; keys that are broadcast, at most.
SHARD_KEYS, LEAST_SHARDS, GATE_BITS, HOT_KEYS = 32_768, 64, 1 << 26, 10_000
#: Bits that one row of the bitmap holds: fixed by Spark's bitmap functions.
BITMAP_BITS = 32_768
ADDED = ("n_lines", "n_dropped", "kept")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _digests(text: Column) -> Column:
    """For each line 128 bits of its key's SHA-256, null where the key is too short to count."""
    return F.transform(lines_of(text), lambda line: F.when(F.char_length(F.btrim(line, F.lit(ASCII_SPACE))) >= MIN_CHARS, F.substring(F.unhex(F.sha2(F.encode(_key(line), "UTF-8"), 256)), 1, 16)))


def _hash(digest: Column) -> Column:
    """64 bits of a digest, for shards, filters and the bitmap."""
    return F.xxhash64(digest)


def postings(docs: DataFrame) -> DataFrame:
    """key, doc_id: once for each counting key and row. Documents without an id count as one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.filter(_digests(whole_text()), lambda d: d.isNotNull()))).alias("key")).select("key", "doc_id")


def _counted(held: DataFrame) -> DataFrame:
    """key, docs, keeper of the frequent keys. Rows that repeat a document count once."""
    return held.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= MIN_DOCS)


class LineIndex:
    """The exact postings and the shards' filters of a set of documents. Every change gives a new index."""

    def __init__(self, held: DataFrame, frequent: DataFrame, filters: DataFrame, shards: int):
        self.held, self.frequent, self.filters, self.shards = held, frequent, filters, shards

    @classmethod
    def build(cls, docs: DataFrame, keep: bool = True) -> LineIndex:
        """keep: the postings are written, for changes to come; else they are made from docs again when asked for."""
        held = stored(postings(docs)) if keep else postings(docs)
        frequent = stored(_counted(held))
        shards = max(LEAST_SHARDS, -(-frequent.count() // SHARD_KEYS))
        made = frequent.select(cls._shard(shards).alias("shard"), _hash(F.col("key")).alias("hash")).groupBy("shard").applyInPandas(_made, "shard int, filter binary")
        return cls(held, frequent, stored(made), shards)

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod(F.shiftright(_hash(F.col("key")), 20), F.lit(shards)).cast("int")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents added: their postings are a new segment, their keys are counted anew."""
        added = stored(postings(docs))
        return self._changed(self.held.unionByName(added), stored(added.select("key").distinct()))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without these documents (by doc_id; one without an id is never deleted)."""
        ids = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
        changed = stored(self.held.join(ids, "doc_id", "left_semi").select("key").distinct())
        return self._changed(self.held.join(ids, "doc_id", "left_anti").select("key", "doc_id"), changed)

    def _changed(self, held: DataFrame, keys: DataFrame) -> LineIndex:
        """The index over `held`, which differs from the own postings in `keys` only."""
        new = stored(_counted(held.join(keys, "key", "left_semi")))
        old = self.frequent.join(keys, "key", "left_semi")
        frequent = stored(self.frequent.join(keys, "key", "left_anti").unionByName(new))
        shard, hashed = self._shard(self.shards).alias("shard"), _hash(F.col("key")).alias("hash")
        grown = new.join(old, "key", "left_anti").select(shard, hashed, F.lit(1).alias("sign"))
        changes = stored(grown.unionByName(old.join(new, "key", "left_anti").select(shard, hashed, F.lit(-1).alias("sign"))))
        touched = changes.select("shard").distinct()
        filters = stored(self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_updated, "shard int, filter binary"))
        full = filters.where("filter IS NULL").select("shard")
        again = frequent.select(shard, hashed).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_made, "shard int, filter binary")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(filters.where("filter IS NOT NULL")).unionByName(again)
        return LineIndex(held, frequent, stored(filters), self.shards)

    def _gate(self) -> np.ndarray:
        """A bitmap of the frequent keys' hashes: GATE_BITS bits, however many keys there are."""
        size = -(-GATE_BITS // BITMAP_BITS) * BITMAP_BITS
        at = F.pmod(_hash(F.col("key")), F.lit(size)) + 1
        parts = self.frequent.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        gate = np.zeros(size // 8, dtype=np.uint8)
        for row in parts.toLocalIterator():
            first = (row["part"] - 1) * BITMAP_BITS // 8
            gate[first : first + BITMAP_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
        return gate

    def _hot(self) -> DataFrame:
        """The keys that hold more than one in HOT_KEYS of the frequent keys' postings: fewer than HOT_KEYS."""
        total = self.frequent.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
        return F.broadcast(self.frequent.where(F.col("docs") > total / HOT_KEYS))

    def _asked(self, lines: DataFrame) -> DataFrame:
        """The lines that their shard's filter may hold. lines: row, doc_id, at, key."""
        dealt = lines.select(self._shard(self.shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "row", "doc_id", "at", "key", _hash(F.col("key")).alias("hash"))
        filters = self.filters.select("shard", "filter", *[F.lit(None).cast(kind).alias(name) for name, kind in (("row", "long"), ("doc_id", "long"), ("at", "int"), ("key", "binary"), ("hash", "long"))])
        # A shard's filter comes before its lines.
        together = dealt.unionByName(filters).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return together.mapInArrow(_held, "row long, doc_id long, at int, key binary")

    def cut(self, docs: DataFrame) -> DataFrame:
        """docs with n_lines, n_dropped and the kept text in `kept` (null stays null).

        A frequent key's lines stay only in its keeper. Null and empty texts are one empty line. Rows that repeat a
        document are cut alike; a document without an id is no frequent key's keeper. All other columns stay, and
        columns of docs by the names of the three are replaced.
        """
        gate = docs.sparkSession.sparkContext.broadcast(self._gate())

        @F.pandas_udf("array<int>")
        def passed(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in hashes:
                yield _passed(part, gate.value)

        digests = _digests(whole_text())
        hashes = F.transform("digests", lambda d: F.when(d.isNotNull(), _hash(d)).otherwise(F.lit(0)))
        marked = docs.select(F.struct(*docs.columns).alias("doc"), F.size(lines_of(whole_text())).cast("long").alias("lines"), digests.alias("digests")).withColumn("hits", passed(hashes))
        columns = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ADDED]
        clean = marked.where(F.size("hits") == 0).select(*columns, F.col("lines").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("doc.text").alias("kept"))
        hit = stored(marked.where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()))
        lines = hit.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), "digests", F.explode("hits").alias("at")).select("row", "doc_id", "at", F.col("digests")[F.col("at")].alias("key"))
        hot = self._hot()
        told = lines.join(hot, "key").unionByName(self._asked(lines.join(hot, "key", "left_anti")).join(self.frequent, "key").select("key", "row", "doc_id", "at", "docs", "keeper"))
        lost = told.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_list("at").alias("lost"))
        joined = hit.join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
        left = F.filter(F.transform(lines_of(whole_text("doc.text")), lambda line, i: F.when(~F.array_contains("lost", i), line)), lambda line: line.isNotNull())
        kept = F.when(F.size("lost") > 0, F.array_join(left, "\n")).otherwise(F.col("doc.text"))
        cut = joined.select(*columns, F.col("lines").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept"))
        return clean.unionByName(cut)


def _made(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter, of its frequent keys' hashes."""
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "filter": [CuckooFilter.of(rows["hash"].to_numpy()).to_bytes()]})


def _updated(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with keys inserted (sign 1) and deleted (-1); null if it must be made anew, larger."""
    raw: bytes | None = old["filter"].iloc[0] if len(old) else CuckooFilter(len(changes)).to_bytes()
    if len(changes):
        made = CuckooFilter.from_bytes(raw)
        made.delete(changes.loc[changes["sign"] < 0, "hash"].to_numpy())
        raw = made.to_bytes() if made.insert(changes.loc[changes["sign"] > 0, "hash"].to_numpy()) else None
    return pd.DataFrame({"shard": pd.Series([key[0]], dtype="int32"), "filter": [raw]})


def _passed(part: pd.Series, gate: np.ndarray) -> pd.Series:
    """For each document the places of its hashes (0: no counting line) whose bit is set."""
    sizes = part.map(len).to_numpy()
    flat = np.concatenate(part.to_list()) if len(part) else np.array([], dtype=np.int64)
    counting = np.flatnonzero(flat)
    bit = flat[counting].astype(np.int64) % (8 * len(gate))
    places = counting[(gate[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
    starts = np.cumsum(sizes) - sizes
    document = np.searchsorted(np.cumsum(sizes), places, side="right")
    within = (places - starts[document]).astype(np.int32)
    return pd.Series(np.split(within, np.searchsorted(document, np.arange(1, len(sizes)))) if len(sizes) else [], dtype=object)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that the filter before them may hold. Rows come sorted by shard, a shard's filter first."""
    shard, own = None, None
    for batch in batches:
        shards, filters = batch.column("shard").to_numpy(), batch.column("filter")
        hashes = batch.column("hash").fill_null(0).to_numpy()
        keep = np.zeros(batch.num_rows, dtype=bool)
        ends = np.flatnonzero(np.diff(shards)) + 1
        for first, end in zip([0, *ends.tolist()], [*ends.tolist(), len(shards)]):
            if first < end and shards[first] != shard:
                shard, own = shards[first], None
            if first < end and filters[first].is_valid:
                own = CuckooFilter.from_bytes(filters[first].as_py())
                first += 1
            if own is not None and first < end:
                keep[first:end] = own.holds(hashes[first:end])
        if keep.any():
            yield batch.select(["row", "doc_id", "at", "key"]).filter(pa.array(keep))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs cut by an index of themselves; see LineIndex.cut."""
    return LineIndex.build(docs, keep=False).cut(docs)


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
             translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
