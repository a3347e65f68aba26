"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its word pairs and its pairs with one word skipped, hashed into 2**BITS slots; a slot
counts once in a text, however often it occurs. Every coordinate has its own learning rate, and the L1 term keeps all
but a few thousand weights at zero: only the others are broadcast.

The model is fitted on a bounded sample of labelled rows (about SAMPLE of each class, fewer if they have more than
SAMPLE_SLOTS features together, picked by the hash of the id), of which executors send distinct slots only. The bias is then moved from the sample's share of toxic rows to the share
among all labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of, stored, whole_text

BITS = 22
#: Bounds of the sample: labelled rows of each class, and their features together (four bytes each on the driver).
SAMPLE, SAMPLE_SLOTS = 4_000, 24_000_000
#: FTRL-proximal: rate, smoothing, L1, L2; passes over the sample; rows of the sample that a slot must occur in.
ALPHA, BETA, L1, L2, PASSES, LEAST_ROWS = 4.0, 1.0, 8.0, 0.01, 10, 2
_TRIM = b".,;:!?\"'()[]{}#$%&*-_"
_WORDS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Hasher:
    """Hashed features of texts; hashes of words that recur are kept in the worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= _WORDS:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word.strip(_TRIM) or word, 7)
        return h

    def features(self, text: str) -> np.ndarray:
        """Slots in text order of words, of pairs and of skip pairs: (3, words); -1 where a pair runs over the end."""
        words = text.encode("utf-8", "replace").lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            get, new = self.known.get, self._hash
            found = [h if h is not None else get(w) or new(w) for h, w in zip(found, words)]
        h = np.array(found, dtype=np.uint64)
        out = np.full((3, len(h)), -1, dtype=np.int32)
        shift = np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            out[0] = (h * _M1) >> shift
            out[1, :-1] = ((h[:-1] * _M2 + h[1:]) * _M1) >> shift
            out[2, :-2] = ((h[:-2] * _M3 + h[2:]) * _M1) >> shift
        return out


def fit(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero, of rows of distinct slots and a label. The last slot (2**BITS) is the bias."""
    n = (1 << BITS) + 1
    z, g2 = np.zeros(n), np.zeros(n)
    met = np.zeros(n, dtype=np.int64)
    for at, _ in rows:
        met[at] += 1
    rows = [(at[met[at] >= LEAST_ROWS], label) for at, label in rows]
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        limit = np.where(at == n - 1, 0.0, L1)
        return np.where(np.abs(part) <= limit, 0.0, -(part - np.sign(part) * limit) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    for _ in range(passes):
        rng.shuffle(order)
        for k in order:
            at, label = rows[k]
            at = np.append(at, n - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    at = np.flatnonzero((np.abs(z) > L1) | (np.arange(n) == n - 1))
    return at.astype(np.int32), weights(at)


def _sampled(labels: DataFrame, folds: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic of a bounded sample of the labels to learn from, and how many there are of each class."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id"), folds) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, SAMPLE / max(1, sizes.get(1, 0))).otherwise(SAMPLE / max(1, sizes.get(0, 0)))
    return stored(known.where(place < rate)), sizes


def train(docs: DataFrame, labels: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights; the last is the bias. docs: doc_id, text; labels: doc_id, toxic (the largest of a repeated id)."""
    sample, sizes = _sampled(labels, folds)

    @F.pandas_udf("array<int>")
    def slots(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for part in texts:
            yield pd.Series([distinct(hasher.features(t)) for t in part], dtype=object)

    held = stored(docs.join(sample, "doc_id").select("doc_id", slots(whole_text()).alias("slots"), "toxic"))
    together = held.agg(F.coalesce(F.sum(F.size("slots").cast("long")), F.lit(0))).first()[0]
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slots")), F.lit(1 << 30)) / float(1 << 30)
    got = held.where(place < SAMPLE_SLOTS / max(1, together)).toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), map(np.asarray, got.column("slots").to_numpy()), got.column("toxic").to_pylist()), key=lambda r: (r[0], len(r[1])))
    ones = sum(label for _, _, label in rows)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not ones or ones == len(rows):
        # One class only, or none: every text has that class's share.
        return np.array([1 << BITS], dtype=np.int32), np.array([35.0 if ones else -35.0])
    at, weights = fit([(slots.astype(np.int64), label) for _, slots, label in rows])
    weights[-1] += np.log(share / (1 - share)) - np.log(ones / (len(rows) - ones))
    return at, weights


def distinct(features: np.ndarray) -> np.ndarray:
    found = np.unique(features)
    return found[found >= 0]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, whatever other columns it has.

    Learns from labels whose id's crc32 modulo `folds` is not 0; a null label or id teaches nothing. Null and empty
    texts have no feature: their score is the bias alone. Repeated rows are scored each; without labels, or with one
    class only, every score is that class's (0 without any). An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights = shared.value
        dense = np.zeros((1 << BITS) + 1, dtype=np.float32)
        dense[at] = weights
        bias, hasher = float(weights[-1]), Hasher()
        dense[-1] = 0  # a pair that runs over the end has slot -1
        for part in texts:
            sums = []
            for text in part:
                slots = hasher.features(text).ravel()
                slots = np.unique(slots[dense[slots] != 0])
                sums.append(bias + float(dense[slots].sum(dtype=np.float64)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))), dtype="float64")

    out = docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), scored(whole_text()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
