"""Exact and near duplicates, leakage across splits, contamination and phrase audits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.functions.joins import join_null_safe
from tallyframe.plans.session import stored


def exact_keys(docs: DataFrame) -> DataFrame:
    """docs with `norm` and `key`, the SHA-256 of the normalised text."""
    # Never null, so that no join or filter works it out a second time to ask.
    return docs.withColumn("norm", T.normalize(F.col("text"))).withColumn("key", F.coalesce(F.sha2(F.encode("norm", "UTF-8"), 256), F.lit("")))


def dedup_exact(docs: DataFrame, pack: str) -> DataFrame:
    """doc_id, pack, key, keep_id: rows of a pack (null is one too) with the same normalised text point to the smallest id.

    Grouped, not windowed: a text that a third of all rows share is combined before the shuffle. The keys are written,
    so that texts are read and hashed once.
    """
    return dedup_exact_keyed(stored(exact_keys(docs).select("doc_id", pack, "key")), pack)


def dedup_exact_keyed(keyed: DataFrame, pack: str) -> DataFrame:
    """dedup_exact of rows that have their key."""
    keep = keyed.groupBy(F.col(pack).alias("in_pack"), F.col("key").alias("of_key")).agg(F.min("doc_id").alias("keep_id"))
    return keyed.join(keep, F.col(pack).eqNullSafe(F.col("in_pack")) & (F.col("key") == F.col("of_key"))).select("doc_id", pack, "key", "keep_id")


def dedup_summary(docs: DataFrame, pack: str) -> DataFrame:
    """pack, n_docs, n_distinct, n_duplicates of each pack by its normalised texts."""
    texts = exact_keys(docs).groupBy(pack, "key").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy(pack).agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"))


def _gram_rows(docs: DataFrame, columns: list[str], grams: Column, again: bool = False) -> DataFrame:
    """columns, n_grams and g: a row for each gram (64-bit hashes).

    Exploded outer and filtered after: an inner explode makes the optimizer build the grams once more to see whether
    there are any. again: the rows are used more than once, so texts are normalised once and their grams written.
    """
    hashed = docs.select(*columns, grams.alias("grams"))
    hashed = stored(hashed) if again else hashed
    return hashed.select(*columns, F.size("grams").alias("n_grams"), F.explode_outer("grams").alias("g")).where(F.col("g").isNotNull())


def keyed_sets(docs: DataFrame, columns: list[str], n: int = 4) -> DataFrame:
    """row, doc_id, columns, key (as of exact_keys), set, the distinct shingles as 64-bit hashes, and n, how many, of every document; written."""
    made = T.let(T.text_words(F.col("text")), lambda w: F.struct(F.sha2(F.encode(F.array_join(w, " "), "UTF-8"), 256).alias("key"), T.shingle_hashes(w, n).alias("set")))
    keyed = docs.select("doc_id", *columns, made.alias("made"))
    return stored(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns, "made.key", "made.set", F.size("made.set").alias("n")))


def _first_rows(keyed: DataFrame, own: list[str]) -> DataFrame:
    """row, rep: the row that stands for each distinct text with words of a value of `own`, and its smallest doc_id."""
    first = keyed.where("n > 0").groupBy(*own, "key").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("of_doc"), F.min("row").alias("any"))
    return first.select(F.coalesce("of_doc", "any").alias("row"), "rep")


def representatives(keyed: DataFrame, own: list[str]) -> DataFrame:
    """rep, own, set: one row for each distinct text with words of a value of `own`."""
    # Grouped without the sets: those of representatives are dealt once, by the number of their row.
    return keyed.join(_first_rows(keyed, own), "row").select("rep", *own, "set")


def shingle_sets(docs: DataFrame, pack: str, n: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """rep, pack, also, set: one row for each distinct normalised text of a pack (and of each `also`), its shingles as
    64-bit hashes. A text of at most n words is one shingle, one without words has no row."""
    return representatives(keyed_sets(docs, [pack, *also], n), [pack, *also])


def _size_classes(threshold: float, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each class, and the parts and the spare parts of pairs whose smaller set is of the class.

    The larger set of a similar pair is in the same class or the next one. Sets of at most m and m / t elements differ
    in m (1 - t) / t elements at most; with one part more than that and `spare` ones, 1 + spare parts are equal.
    """
    first = [1, 2]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, math.floor((first[-1] - 1) / threshold + 1e-9) + 1))
    starts = np.array(first, dtype=np.int64)
    differ = np.floor((starts[1:] - 1) * (1 - threshold) / threshold + 1e-9).astype(np.int64)
    spare = np.where(differ > 0, 1 + np.ceil(2 * (differ + 1) * np.exp(-starts[:-1] / (differ + 1))), 0).astype(np.int64)
    return starts, differ + 1 + spare, spare


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Elements of sets whose parts are worked out at once.
AT_ONCE = 2_000_000


def _parts(sets: DataFrame, threshold: float, largest: int, carried: list[str]) -> DataFrame:
    """row, n, carried, sig, prev: the parts of each set, of its own class and of the one below, as hashes.

    sets: row, n, pack_hash, set, carried. A part's hash is made of its elements, its place, its class and the pack.
    prev is the hash of the part before it, if that has a row too. Empty parts have rows only where a set has more than
    the spare ones: of two sets' equal parts, one is then still found.
    """
    starts, parts, spare = _size_classes(threshold, largest)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(whole.column("n").to_numpy().astype(np.int64))
            at = 0
            while at < whole.num_rows:
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                batch, at = whole.slice(at, upto - at), upto
                hashes = _mixed(batch.column("set").flatten().to_numpy().view(np.uint64))
                sizes, pack = batch.column("n").to_numpy().astype(np.int64), batch.column("pack_hash").to_numpy().view(np.uint64)
                own = np.searchsorted(starts, sizes, "right") - 1
                for step in (0, 1):
                    base = own - step
                    some = np.flatnonzero(base >= 0)
                    if not len(some):
                        continue
                    k, m = base[some], parts[base[some]]
                    begin = np.concatenate([[0], np.cumsum(m)])
                    # Elements of the sets that take part, each with the slot of its part.
                    which = np.full(len(sizes), -1, dtype=np.int64)
                    which[some] = np.arange(len(some))
                    owner = np.repeat(which, sizes)
                    inside = owner >= 0
                    owner, h = owner[inside], hashes[inside]
                    slot = begin[owner] + (h % m[owner].astype(np.uint64)).astype(np.int64)
                    count = np.bincount(slot, minlength=begin[-1])
                    order = np.argsort(slot, kind="stable")
                    total = np.zeros(begin[-1], dtype=np.uint64)
                    full = count > 0
                    if len(h):
                        runs = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                        with np.errstate(over="ignore"):
                            total[full] = np.add.reduceat(_mixed(h)[order], runs)
                    of_set = np.repeat(np.arange(len(some)), m)
                    place = np.arange(begin[-1]) - begin[of_set]
                    with np.errstate(over="ignore"):
                        sig = _mixed(total + _mixed(pack[some][of_set] + _mixed((k[of_set].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))))
                    empty = np.bincount(of_set[~full], minlength=len(some))
                    shown = full | (empty > spare[k])[of_set]
                    follows = np.concatenate([[False], shown[:-1]]) & (place > 0)
                    prev = pa.array(np.roll(sig, 1).view(np.int64)[shown], mask=~follows[shown])
                    back = pa.array(some[of_set[shown]])
                    taken = [batch.column(c).take(back) for c in ("row", "n", *carried)]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(sig.view(np.int64)[shown]), prev], names=["row", "n", *carried, "sig", "prev"])

    types = {f.name: f.dataType.simpleString() for f in sets.schema}
    kind = "row long, n int, " + "".join(f"{c} {types[c]}, " for c in carried) + "sig long, prev long"
    return sets.select("row", "n", "pack_hash", "set", *carried).mapInArrow(of, kind)


def _odd(hashes: np.ndarray) -> bytes:
    """A bitmap of a bit an element or more, a power of two: each is the parity of the number of elements that fall on it."""
    width = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Elements in which two sets differ, at least. The wider bitmap is folded: parities of a bit's halves add up."""
    x, y = (np.frombuffer(w, np.uint8) for w in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _left_by_bitmaps(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidates, row_a and row_b, whose bitmaps don't prove them apart: sets as similar as the threshold differ in
    (1 - t) / (1 + t) of their sizes' sum at most. Candidates carry bitmaps, a fiftieth of the sets; written."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("set").flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            odd = [_odd(hashes[e - n : e]) for e, n in zip(ends, batch.column("n").to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(odd, pa.binary())], names=["row", "n", "odd"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (1 - threshold) + 1e-6
            stay = [_differ(x, y) * (1 + threshold) <= m for x, y, m in zip(batch.column("odd_a").to_pylist(), batch.column("odd_b").to_pylist(), most.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row_a", "row_b")], names=["row_a", "row_b"]).filter(pa.array(stay, pa.bool_()))

    bits = stored(sets.select("row", "n", "set").mapInArrow(made, "row long, n int, odd binary"))
    side = lambda x: bits.select(*[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "odd")])
    return stored(candidates.join(side("a"), "row_a").join(side("b"), "row_b").mapInArrow(left, "row_a long, row_b long"))


def similar_pairs(sets: DataFrame, pack: str, threshold: float, apart: str | None = None) -> DataFrame:
    """pack, id_a < id_b, jaccard of all pairs at the threshold or more; of different values of `apart` only, if given
    (then also apart_a and apart_b). Written."""
    also = [apart] if apart else []
    n = F.size("set")
    sets = stored(sets.where(n > 0).select(F.monotonically_increasing_id().alias("row"), "rep", pack, *also, "set", n.alias("n")))
    return _pairs(sets, sets.select("row", "rep"), None, pack, threshold, apart)


def similar_texts(keyed: DataFrame, pack: str, threshold: float, apart: str | None = None) -> DataFrame:
    """similar_pairs of the distinct texts among rows of keyed_sets. Sets stay where they are written: what is dealt is
    numbers of rows, parts, and the sets of candidates."""
    firsts = stored(_first_rows(keyed, [pack, apart] if apart else [pack]))
    copies = stored(keyed.where("n > 0").select("row").join(firsts, "row", "left_anti"))
    return _pairs(keyed.where("n > 0"), firsts, copies, pack, threshold, apart)


def _pairs(sets: DataFrame, firsts: DataFrame, copies: DataFrame | None, pack: str, threshold: float, apart: str | None) -> DataFrame:
    """similar_pairs of sets: row, pack, apart, set, n, written; firsts: row, rep; copies: the other rows, if there are any.

    Elements are dealt to parts by their hash, one part more than two similar sets can have elements that differ: at
    least one part of both is equal, and pairs meet in those alone. A part of texts that are unlike is hardly ever
    equal (at 0.9 it holds eight shingles), so candidates are about as many as pairs, however common a shingle is. Of a
    run of equal parts the first makes the candidate. Texts that are half alike are candidates too, more of them the
    more texts there are: bitmaps prove most of them apart. The rest is verified once, by whole sets, of which only
    those of some candidate are dealt. Exact at any threshold; parts get small, and candidates many, below 0.8.
    """
    also = [apart] if apart else []
    largest = sets.agg(F.max("n")).first()[0] or 0
    parts = _parts(sets.withColumn("pack_hash", F.xxhash64(pack)), threshold, largest, also)
    # Not written: both sides of the join are the same shuffle.
    parts = parts.join(copies, "row", "left_anti") if copies is not None else parts
    side = lambda x: parts.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "prev", *also)])
    fits = (F.col("row_a") < F.col("row_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9) & F.coalesce(F.col("prev_a") != F.col("prev_b"), F.lit(True))
    fits = fits & (F.col(f"{apart}_a") != F.col(f"{apart}_b")) if apart else fits
    met = stored(side("a").join(side("b"), "sig").where(fits).select("row_a", "row_b").distinct())
    candidates = _left_by_bitmaps(met, sets, threshold)
    # Written, so that the join with the sets knows how few they are.
    wanted = stored(candidates.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct().join(firsts, "row"))
    own = stored(sets.select("row", pack, *also, "set").join(wanted, "row"))
    whole = lambda x: own.select(*[F.col(c).alias(f"{c}_{x}") for c in ("row", "rep", pack, *also, "set")])
    verified = candidates.join(whole("a"), "row_a").join(whole("b"), "row_b").where(F.col(f"{pack}_a").eqNullSafe(F.col(f"{pack}_b")) & (F.col("rep_a") != F.col("rep_b")))
    turned = F.col("rep_a") > F.col("rep_b")
    ends = [F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{name}_{x}") for c, name in (("rep", "id"), *((c, c) for c in also)) for x, y in ("ab", "ba")]
    found = verified.select(F.col(f"{pack}_a").alias(pack), *ends, T.jaccard(F.col("set_a"), F.col("set_b")).alias("jaccard"))
    return stored(found.where(F.col("jaccard") >= threshold))


def greedy_kept(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, status (kept, near_duplicate), keeper: first come, first kept, in order of `rank`."""
    decided = decided_nodes(nodes, pairs)
    alone = nodes.join(decided.select("id"), "id", "left_anti")
    return decided.unionByName(alone.select("id", F.lit("kept").alias("status"), F.lit(None).cast("long").alias("keeper")))


def decided_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """greedy_kept of the nodes that have an earlier one beside them or are one; all others are kept.

    A node is dropped if an earlier kept node is similar to it, whatever becomes of others. Each round keeps all undecided
    nodes without an undecided or kept earlier neighbour, then drops the neighbours of kept nodes; a few rounds suffice,
    also where all of a large group are similar, each written. The first kept neighbour is asked for once, in the end.
    nodes: id, rank (unique). pairs: id_a, id_b.
    """
    pairs = stored(pairs.select("id_a", "id_b"))
    linked = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    own = stored(nodes.select("id", "rank").join(linked, "id", "left_semi"))
    both = pairs.union(pairs.select("id_b", "id_a")).toDF("id", "other")
    ranked = both.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("rank").alias("other_rank")), "other")
    earlier = stored(ranked.where("other_rank < rank").select("id", "other", "other_rank"))
    state = stored(own.join(earlier.select("id").distinct().withColumn("linked", F.lit(True)), "id", "left").select("id", F.when(F.col("linked").isNull(), "kept").alias("status")))
    while not state.where("status IS NULL").isEmpty():
        seen = earlier.select("id", "other").join(state.where("status IS NULL").select("id"), "id", "left_semi").join(state.select(F.col("id").alias("other"), F.col("status").alias("other_status")), "other")
        about = seen.groupBy("id").agg(F.bool_or(F.col("other_status").eqNullSafe("kept")).alias("hit"), F.bool_or(F.col("other_status").isNull()).alias("open"))
        decided = F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("hit"), "near_duplicate").when(F.col("open"), None).otherwise("kept")
        state = stored(state.join(about, "id", "left").select("id", decided.alias("status")))
    kept = earlier.join(state.where("status = 'kept'").select(F.col("id").alias("other")), "other", "left_semi")
    first = kept.groupBy("id").agg(F.min_by("other", "other_rank").alias("keeper"))
    return stored(state.join(first, "id", "left").select("id", "status", "keeper"))


def split_of(doc_id: Column) -> Column:
    """train, calibration or locked_test by the hash of the id (80/10/10)."""
    share = T.hash_share(F.lit("split"), doc_id)
    return F.when(share < 8000, "train").when(share < 9000, "calibration").otherwise("locked_test")


def cross_split_pairs(docs: DataFrame, pack: str, threshold: float) -> DataFrame:
    """Similar pairs of different splits (`split` must be a column): texts are told apart by split before they pair."""
    return similar_texts(keyed_sets(docs, [pack, "split"]), pack, threshold, apart="split")


def shingle_contamination(docs: DataFrame, items: DataFrame, n: int = 8, share: float = 0.10) -> DataFrame:
    """doc_id, item_id, hits, ratio: for each document the item it shares most n-word grams with, if that is `share`
    of the document's or of the item's grams. Ties go to the smaller item id."""
    grams = T.gram_hashes(T.text_words(F.col("text")), n)
    i = stored(_gram_rows(items, ["item_id"], grams))
    sizes = i.select("item_id", F.col("n_grams").alias("n_item")).distinct()
    met = _gram_rows(docs, ["doc_id"], grams).withColumnRenamed("n_grams", "n_doc").join(i.select("item_id", "g"), "g")
    hits = met.groupBy("doc_id", "item_id", "n_doc").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "hits", "n_doc"), F.struct(F.col("hits"), -F.col("item_id"))).alias("b")).select("doc_id", "b.*")
    ratio = F.greatest(F.col("hits") / F.col("n_doc"), F.col("hits") / F.col("n_item"))
    return best.join(sizes, "item_id").select("doc_id", "item_id", "hits", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= share)


#: Capitalised word pairs, identifiers and numbers with a unit.
ENTITY = r"[A-Z][a-z]+ [A-Z][a-z]+|[A-Z]{2,}-[0-9]+|[a-z]+[A-Z][A-Za-z]+|[0-9]+ (?:kg|km|ms|MB|GB)"


def entities(c: Column, pattern: str = ENTITY) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda e: F.lower(e)))


def entity_contamination(docs: DataFrame, items: DataFrame, item_df: int = 3, corpus_share: float = 0.002, least: int = 3, pattern: str = ENTITY) -> DataFrame:
    """doc_id, item_id, shared: documents that share at least `least` rare entities with an item.

    Rare: in at most item_df items and in at most max(3, corpus_share * documents) documents.
    """
    e_docs, e_items = (t.select(k, F.explode(entities(F.col("text"), pattern)).alias("e")) for t, k in ((docs, "doc_id"), (items, "item_id")))
    rare_items = e_items.join(e_items.groupBy("e").count().where(F.col("count") <= item_df).select("e"), "e", "left_semi")
    most = max(3.0, corpus_share * docs.count())
    met = e_docs.join(rare_items.select("e").distinct(), "e", "left_semi")
    rare = met.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most).select("e")
    return met.join(rare, "e").join(rare_items, "e").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def phrase_coverage(docs: DataFrame, family: str, n: int = 5) -> DataFrame:
    """family, rows, coverage: mean share of an evaluation text's n-grams that some training text of its family has."""
    g = _gram_rows(docs, ["doc_id", family, "is_eval"], T.gram_hashes(T.text_words(F.col("text"), digits=False), n), again=True)
    seen = g.where("NOT is_eval").select(F.col(family).alias("in_family"), F.col("g").alias("known")).distinct().withColumn("seen", F.lit(1))
    asked = g.where("is_eval").join(seen, F.col(family).eqNullSafe(F.col("in_family")) & (F.col("g") == F.col("known")), "left")
    rows = asked.groupBy(family, "doc_id").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("share"))
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("share"), 6).alias("coverage"))


def boilerplate_share(docs: DataFrame, family: str, n: int = 5) -> DataFrame:
    """family, rows, share: mean share of a row's n-grams that max(3, 5 %) of the family's rows or more have."""
    g = _gram_rows(docs, ["doc_id", family], T.gram_hashes(T.text_words(F.col("text"), digits=False), n), again=True)
    rows = docs.groupBy(F.col(family).alias("in_family")).agg(F.count(F.lit(1)).alias("rows"))
    df = g.groupBy(family, "g").agg(F.count(F.lit(1)).alias("df")).join(rows, F.col(family).eqNullSafe(F.col("in_family"))).where(F.col("df") >= F.greatest(F.lit(3), F.floor(F.col("rows") * 0.05)))
    # Few by nature (a text of n words has n grams, each of these stands in many): written, so that the join knows how few.
    often = stored(df.select("in_family", F.col("g").alias("known"), F.lit(1).alias("often")))
    share = g.join(often, F.col(family).eqNullSafe(F.col("in_family")) & (F.col("g") == F.col("known")), "left").groupBy(family, "doc_id").agg(F.avg(F.coalesce("often", F.lit(0))).alias("share"))
    return share.groupBy(family).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("share"), 6).alias("share"))


def skeleton_audit(docs: DataFrame, family: str) -> DataFrame:
    """family, rows, texts, skeletons: distinct texts and distinct texts with their numbers masked."""
    return docs.groupBy(family).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("texts"),
        F.count_distinct(F.md5(F.encode(T.skeleton(F.col("text")), "UTF-8"))).alias("skeletons"),
    )


def isolation_report(docs: DataFrame, family: str) -> DataFrame:
    """family, splits, in_train, shared_keys: in how many splits a family stands and how many texts stand in several."""
    keyed = exact_keys(docs)
    shared = keyed.groupBy(family, "key").agg(F.count_distinct("split").alias("s")).where("s > 1").groupBy(family).agg(F.count(F.lit(1)).alias("shared_keys"))
    report = keyed.groupBy(family).agg(F.count_distinct("split").alias("splits"), F.bool_or(F.col("split") == "train").alias("in_train"))
    return join_null_safe(report, shared, [family], "left").select(family, "splits", "in_train", F.coalesce("shared_keys", F.lit(0)).alias("shared_keys"))


def token_set_matches(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, item_id, jaccard of token sets at the threshold or more.

    An item's tokens are ranked by how rare they are among documents; a match must share one of the rarest
    size - ceil(t * size) + 1, so only those meet the documents' tokens.
    """
    i = stored(items.select("item_id", F.array_distinct(T.text_words(F.col("text"))).alias("t")).where(F.size("t") > 0))
    sizes = i.agg(F.min(F.size("t")).alias("least"), F.max(F.size("t")).alias("most")).first()
    low, high = (sizes["least"] or 0) * threshold - 1e-9, (sizes["most"] or 0) / threshold + 1e-9
    # Texts that no item's size fits can't match. Exploded outer: a filter on the tokens would make them a second time.
    fitting = F.explode_outer(T.let(F.array_distinct(T.text_words(F.col("text"))), lambda t: F.when((F.size(t) > 0) & F.size(t).between(F.lit(low), F.lit(high)), F.array(t))))
    d = stored(docs.select("doc_id", fitting.alias("t")).where("t IS NOT NULL"))
    tokens = d.select("doc_id", F.size("t").alias("n_doc"), F.explode("t").alias("w"))
    own = i.select("item_id", F.explode("t").alias("w"))
    df = tokens.join(own.select("w").distinct(), "w", "left_semi").groupBy("w").count()
    ordered = own.join(df, "w", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "w"))).alias("o"))
    n = F.size("o")
    prefix = ordered.select("item_id", n.alias("n_item"), F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("x")).select("item_id", "n_item", "x.w")
    fits = F.least("n_doc", "n_item") >= F.greatest("n_doc", "n_item") * F.lit(threshold) - 1e-9
    near = tokens.join(prefix, "w").where(fits).select("doc_id", "item_id").distinct()
    both = near.join(d, "doc_id").join(i.select("item_id", F.col("t").alias("u")), "item_id")
    return both.select("doc_id", "item_id", T.jaccard(F.col("t"), F.col("u")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """label, id_a, id_b, cosine of pairs of a label at the threshold or more.

    Vectors are blocked by label; each label is further cut into blocks that are compared block against block, so that
    a label with many vectors is many tasks. Comparison is numpy matrix products.
    """
    import numpy as np
    import pandas as pd

    block = 512
    sized = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = vectors.join(sized, "label").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    spread = placed.select("vec_id", "label", "embedding", "block", F.explode(meets).alias("m")).select("vec_id", "label", "embedding", "block", "m.lo", "m.hi")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        v = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(v, axis=1)
        v = v / np.where(norms == 0, 1, norms)[:, None]
        ids, own = rows["vec_id"].to_numpy(), rows["block"].to_numpy()
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        x, y = np.nonzero(v[a] @ v[b].T >= threshold)
        first, second = ids[a[x]], ids[b[y]]
        keep = first != second if lo != hi else first < second
        cos = np.einsum("ij,ij->i", v[a[x]], v[b[y]])
        return pd.DataFrame({"label": rows["label"].iloc[0], "id_a": np.minimum(first, second)[keep], "id_b": np.maximum(first, second)[keep], "cosine": cos[keep].round(6)})

    return spread.groupBy("label", "lo", "hi").applyInPandas(compare, "label int, id_a long, id_b long, cosine double")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
