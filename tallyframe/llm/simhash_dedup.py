"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Equal fingerprints are one class.
Classes are compared exactly: the 64 bits are cut into six blocks, and two fingerprints that differ in at most two
bits agree in at least four of them, so each class goes to the fifteen groups named by four blocks. A group's
fingerprints differ in the two other blocks alone, 22 bits at most, which bounds its size by construction whatever
the data. Within a group the fingerprints, sorted by their population count, are cut into tiles; tile pairs whose
population counts differ by more than the radius are skipped, and the rest are compared by numpy exclusive-or and bit
counts. A group reports a spanning forest of its links instead of all pairs; components are found over the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored, whole_text
from tallyframe.llm.components import components

SHINGLE, RADIUS, SEED, TILE = 3, 2, 42, 1024
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Hashes whose bits are counted at once.
PIECE = 1 << 15


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), PIECE):
        piece = hashes[i : i + PIECE]
        ones += np.unpackbits(piece.view(np.uint8).reshape(len(piece), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit majority of the shingles' hashes; zero for a text without words.

    Bytes split and lower-cased as such treat ASCII only, and no byte of a longer code point is ASCII.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return int(majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=n)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every document."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", of(whole_text()).alias("fp"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, by union-find over the pairs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def tile_links(fps: np.ndarray, pops: np.ndarray, radius: int = RADIUS, tile: int = TILE, met: Callable[[int, int], None] = lambda i, j: None) -> np.ndarray:
    """For each fingerprint (sorted by population count) the index of its component's first. Links: at most radius bits.

    met: told of every pair of tiles that is compared, by their first places.
    """
    n = len(fps)
    root = np.arange(n)
    for i in range(0, n, tile):
        a, last = fps[i : i + tile], pops[min(i + tile, n) - 1]
        for j in range(i, n, tile):
            if pops[j] - last > radius:
                break
            met(i, j)
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius
            x, y = np.nonzero(near)
            x, y = root[x + i], root[y + j]
            new = x != y
            if new.any():
                root = _roots(n, x[new], y[new])[root]
    return root


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every group. Batches come sorted by group and population count; a group may run over batches."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64())])
    left: list[np.ndarray] = []

    def links(rows: np.ndarray, out: list) -> None:
        fps = rows[:, 2].view(np.uint64)
        root = tile_links(fps, rows[:, 1])
        hung = np.flatnonzero(root != np.arange(len(root)))
        if len(hung):
            out.append(np.column_stack([rows[hung, 3], rows[root[hung], 3]]))

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list = []
        ends = np.flatnonzero(np.diff(rows[:, 0])) + 1
        starts, stops = np.concatenate([[0], ends]), np.concatenate([ends, [len(rows)]])
        for s, e in zip(starts.tolist(), stops.tolist()):
            if e - s > 1:
                links(rows[s:e], out)
        if out:
            both = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        if left and rows[-1, 0] == left[-1][-1, 0]:
            same = rows[:, 0] == rows[-1, 0]
            if same.all() and (left[0][0, 0] == rows[0, 0]):
                left.append(rows)
                continue
        rows = np.concatenate([*left, rows])
        cut = np.searchsorted(rows[:, 0], rows[-1, 0]) if (np.diff(rows[:, 0]) >= 0).all() else int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
        if cut:
            yield from done(rows[:cut])
        left = [rows[cut:]]
    if left:
        yield from done(np.concatenate(left))


def near_links(classes: DataFrame) -> DataFrame:
    """node, other: links between the names of classes whose fingerprints differ in at most two bits. classes: fp, rep."""
    fp = F.col("fp")
    groups = []
    for k, kept in enumerate(combinations(BLOCKS, 4)):
        mask = sum(((1 << width) - 1) << first for first, width in kept)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        groups.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask))))
    keyed = classes.select("rep", "fp", F.bit_count("fp").cast("long").alias("pop"), F.explode(F.array(*groups)).alias("key"))
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "pop", "fp").select("key", "pop", "fp", "rep")
    return sorted_rows.mapInArrow(_group_links, "node long, other long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, whatever other columns it has.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id keep their own
    fingerprint; a null doc_id is linked but names a component only if that has no other id. An empty table gives no
    rows.
    """
    marked = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # A class goes by its fingerprint, which it has whether or not its documents have ids.
    named = components(near_links(classes.select("fp", F.col("fp").alias("rep"))))
    labels = stored(classes.join(named, classes["fp"] == named["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stored(labels.join(least, "component").select("fp", "component_id"))
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
