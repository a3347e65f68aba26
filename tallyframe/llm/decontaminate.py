"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are read as words (lower-cased runs of ASCII letters and digits and of anything outside ASCII).
An item of m words may differ in `edits` = floor(0.2 m) word insertions, deletions or substitutions, a similarity of
0.8 or more. It is split into edits + 1 pieces: wherever it occurs within its budget, one piece at least stands
untouched. A document is searched for all pieces at once (one automaton over its words); around each piece hit the
item is verified by Myers' bit-parallel distance, one machine word or a long integer per item, against the stretch of
the document that can hold it.

The items are the stated query set. Their pieces are broadcast in blocks of at most ITEM_WORDS words, so that a
benchmark of any size only adds passes; documents are never shuffled.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored, whole_text

SIMILARITY = 0.8
#: Items shorter than this are looked for exactly: an edit would leave little of them.
SHORT = 5
#: Words of items that are broadcast together.
ITEM_WORDS = 2_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD) if not text.isascii() else text.lower())


def budget(m: int, similarity: float = SIMILARITY) -> int:
    """Word edits that an item of m words may have."""
    return 0 if m < SHORT else int(m * (1 - similarity) + 1e-9)


def pieces(m: int, edits: int) -> list[tuple[int, int]]:
    """First and end word of the edits + 1 pieces of an item, even to a word."""
    n = edits + 1
    return [(m * i // n, m * (i + 1) // n) for i in range(n)]


def myers(masks: dict[str, int], m: int, text: list[str], most: int) -> tuple[int, int] | None:
    """Least distance (and the end of its first occurrence) of a pattern to any stretch of text, if at most `most`.

    masks: for each word of the pattern the bits of its places. The text may begin and end anywhere for free.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best = full, 0, m, None
    for at, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, at)
    return best


@dataclass
class Items:
    """A block of test items: for each its words, budget and masks, and an automaton over all pieces."""

    ids: list[int]
    words: list[list[str]]
    similarity: float

    def __post_init__(self):
        self.edits = [budget(len(w), self.similarity) for w in self.words]
        self.masks = []
        at: dict[str, list[tuple[int, int, int]]] = {}
        for k, own in enumerate(self.words):
            masks: dict[str, int] = {}
            for i, word in enumerate(own):
                masks[word] = masks.get(word, 0) | 1 << i
            self.masks.append(masks)
            for first, end in pieces(len(own), self.edits[k]):
                if end > first:
                    at.setdefault(" " + " ".join(own[first:end]) + " ", []).append((k, first, end))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (piece.count(" ") - 1, places))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """item id, distance, edits, words and last word (from 0) of every item within its budget, the best place of each."""
        own = words_of(text)
        if not own or not len(self.automaton):
            return []
        joined = " " + " ".join(own) + " "
        tried: dict[int, list[tuple[int, int]]] = {}
        at, seen = 0, 0  # blanks up to a position of joined
        for end, (n, places) in self.automaton.iter(joined):
            at += joined.count(" ", seen, end + 1)
            seen = end + 1
            last = at - 1  # the word after the piece
            for k, first, _ in places:
                start = last - n - first  # of the item, without edits
                lo = max(0, start - self.edits[k])
                hi = min(len(own), start + len(self.words[k]) + self.edits[k])
                spans = tried.setdefault(k, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        found = []
        for k, spans in sorted(tried.items()):
            best = None
            for lo, hi in spans:
                hit = myers(self.masks[k], len(self.words[k]), own[lo:hi], self.edits[k])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1] - 1)
                if best and best[0] == 0:
                    break
            if best:
                found.append((self.ids[k], best[0], self.edits[k], len(self.words[k]), best[1]))
        return found


_loaded: dict[int, Items] = {}


def _items(key: int, ids: list, words: list, similarity: float) -> Items:
    """The worker's items, made once."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Items(ids, words, similarity)
    return _loaded[key]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[list[str]]]]:
    ids, words, size = [], [], 0
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        own = words_of(row["text"])
        if own:
            ids.append(row["item_id"])
            words.append(own)
            size += len(own)
        if size >= ITEM_WORDS:
            yield ids, words
            ids, words, size = [], [], 0
    if ids:
        yield ids, words


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, edits, similarity, last_word: each item that a document holds within its budget.

    One row for a document and item, with the item's least distance in the document and where that place ends. Null
    and empty texts hold nothing; an item without words is nowhere; items that repeat are found each; rows that repeat
    a document give their rows each. Empty tables give no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("text <> ''")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("edits", pa.int32()), ("n_words", pa.int32()), ("last_word", pa.int64())])
    kind = "doc_id long, item_id long, distance int, edits int, n_words int, last_word long"
    found, part = docs.sparkSession.createDataFrame([], kind), None
    context = docs.sparkSession.sparkContext
    for ids, words in _blocks(benchmark):
        # Blocks run one after the other: what an earlier one found is written before the next is broadcast.
        found = found if part is None else found.unionByName(stored(part))
        part = docs.mapInArrow(_matcher(secrets.randbits(62), context.broadcast((ids, words)), similarity, schema), kind)
    found = found if part is None else found.unionByName(part)
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("n_words")).select("doc_id", "item_id", "distance", "edits", "similarity", "last_word")


def _matcher(key: int, shared, similarity: float, schema: pa.Schema):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = shared.value
        items = _items(key, ids, words, similarity)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc, item, distance, edits, n, last) for item, distance, edits, n, last in items.matches(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return matched


def _filter(key: int, shared, similarity: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = shared.value
        items = _items(key, ids, words, similarity)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([not (t and items.matches(t)) for t in texts], pa.bool_()))

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item, with all their columns.

    Each row is judged by its own text, in the pass that reads it: ids may be null, repeated or absent, and nothing is
    shuffled. Null texts hold nothing and stay. Blocks of items filter one after the other, written in between.
    """
    context, kept = docs.sparkSession.sparkContext, docs
    for k, (ids, words) in enumerate(_blocks(benchmark)):
        kept = (stored(kept) if k else kept).mapInArrow(_filter(secrets.randbits(62), context.broadcast((ids, words)), similarity), docs.schema)
    return kept
