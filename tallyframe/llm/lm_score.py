"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie of order five, counted over all training documents. An order's unseen symbols share
its escape mass, estimated as the number of distinct symbols seen over that number plus the count (method C), and are
predicted one order lower with the symbols that the longer context has seen excluded. A text's score is the code
length of its lower-cased bytes and of an end mark, as a log10 probability.

The trie is kept whole, as one table for each order: a row is a context with its at most 256 symbols and what an
escape from it costs. A pretrained trie's prediction depends on a position's code alone (five bytes of context and the
byte itself), so it is worked out once for each distinct code. The HOT_CODES most frequent codes go to the tasks as a
hash table; that is a cache and decides nothing. The codes of a document that the cache lacks meet the orders' tables
in joins, longest context first.

Beside it stands a smoothed unigram score over words. Word counts are a table of any size too: the HOT_WORDS most
frequent words go to the tasks as a dictionary, and the few remaining words of each document meet the table in a join.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of, small_batches, stored, whole_text

ORDER, SMOOTHING = 5, 0.1
#: Bounds of what is broadcast (both are caches): codes, words, and the bytes beyond which a word goes by its digest.
HOT_CODES, HOT_WORDS, HOT_BYTES = 1 << 20, 100_000, 64
#: A byte that no UTF-8 text holds: stands before a text as its context and after it as its end.
MARK = b"\xff"
#: Positions that are scored and counted at once; words and codes a task holds before it sends some on.
SCORED, COUNTED, HELD_WORDS, HELD = 1 << 18, 1 << 20, 300_000, 500_000
#: Documents that are taken out of a batch at once.
DOCS = 500


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as codes, with the texts that they belong to and each one's number of codes.

    A long text is cut; every piece begins with the five bytes before it.
    """
    parts, owners, size = [], [], 0

    def codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        out = raw[: len(raw) - ORDER].astype(np.int64)
        for j in range(1, ORDER + 1):
            out <<= 8
            out |= raw[j : len(raw) - ORDER + j]
        lengths = np.array([len(p) - ORDER for p in parts])
        # The codes at a seam between pieces belong to neither.
        keep = np.ones(len(out), dtype=bool)
        seams = np.cumsum(lengths + ORDER)[:-1] - ORDER
        for j in range(ORDER):
            keep[seams + j] = False
        return out[keep], np.array(owners), lengths

    for k, text in enumerate(texts):
        whole = MARK * ORDER + text + MARK
        for i in range(0, len(whole) - ORDER, most):
            parts.append(whole[i : i + most + ORDER])
            owners.append(k)
            size += len(parts[-1]) - ORDER
            if size >= most:
                yield codes()
                parts, owners, size = [], [], 0
    if parts:
        yield codes()


def _merged(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.array([], dtype=np.int64)
    sums = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first) if len(codes) else counts
    return codes[first], sums.astype(np.int64)


_COUNTED = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words and of the codes of training texts, combined within the task."""
    words: Counter = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def word_rows(out: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.nulls(len(out), pa.int64()), pa.array(out.values(), pa.int64())], schema=_COUNTED)

    def code_rows() -> pa.RecordBatch:
        codes, counts = parts[0]
        return pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.array(codes), pa.array(counts)], schema=_COUNTED)

    def joined() -> list[tuple[np.ndarray, np.ndarray]]:
        return [_merged(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]

    for batch in _few(batches):
        texts = [t.encode("utf-8", "replace").lower() for t in batch.column(0).to_pylist()]
        for text in texts:
            words.update(text.split())
        parts += [_merged(codes) for codes, _, _ in _pieces(texts, COUNTED)]
        if sum(len(c) for c, _ in parts) > 2 * HELD:
            parts = joined()
        if len(words) > HELD_WORDS:
            # Rare words go first: those met often gain from staying.
            often = Counter({w: n for w, n in words.items() if n > 2})
            often = often if len(often) < HELD_WORDS // 2 else Counter()
            yield word_rows({w: n for w, n in words.items() if w not in often})
            words = often
        if len(parts) == 1 and len(parts[0][0]) > HELD:
            yield code_rows()
            parts = []
    if words:
        yield word_rows(words)
    if parts:
        parts = joined()
        yield code_rows()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to DOCS rows, so that few texts stand in Python at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, DOCS):
            yield whole.slice(i, DOCS)


def _suffix(context: Column, order: int) -> Column:
    """The last `order` bytes of a context."""
    return context.bitwiseAND((1 << 8 * order) - 1)


def trie_levels(codes: DataFrame) -> list[DataFrame]:
    """For the orders 0 to ORDER: context, symbols (symbol, n), total, distinct, mass, fresh. codes: code, n.

    mass and fresh: with this context's symbols excluded, the counts and distinct symbols of its suffix together, and
    those distinct symbols alone. A context has at most 256 symbols, and a suffix at most 256 contexts.
    """
    levels: list[DataFrame] = []
    own = [codes]
    for order in range(ORDER - 1, -1, -1):
        own.append(stored(own[-1].groupBy(_suffix(F.col("code"), order + 1).alias("code")).agg(F.sum("n").alias("n"))))
    for order, counted in enumerate(reversed(own)):
        at = counted.select(F.shiftright("code", 8).alias("context"), F.struct(F.col("code").bitwiseAND(255).cast("int").alias("symbol"), "n").alias("seen"))
        level = at.groupBy("context").agg(F.collect_list("seen").alias("symbols"), F.sum("seen.n").alias("total"), F.count(F.lit(1)).alias("distinct"))
        if order:
            below = levels[-1].select(F.col("context").alias("suffix"), F.col("symbols").alias("wider"), F.col("total").alias("total_below"), F.col("distinct").alias("distinct_below"))
            seen = F.transform("symbols", lambda s: s["symbol"])
            excluded = F.aggregate("wider", F.lit(0).cast("long"), lambda a, w: a + F.when(F.array_contains(seen, w["symbol"]), w["n"]).otherwise(F.lit(0)))
            fresh = F.col("distinct_below") - F.col("distinct")
            level = level.withColumn("suffix", _suffix(F.col("context"), order - 1)).join(F.broadcast(below) if order <= 2 else below, "suffix")
            level = level.select("context", "symbols", "total", "distinct", (F.col("total_below") - excluded + fresh).alias("mass"), fresh.alias("fresh"))
        else:
            level = level.withColumns({"mass": F.lit(None).cast("long"), "fresh": F.lit(None).cast("long")})
        levels.append(stored(level))
    return levels


def predictions(asked: DataFrame, levels: list[DataFrame], alphabet: int) -> DataFrame:
    """code, log: the trie's log10 prediction of every asked code. asked: code, once each; alphabet: distinct bytes seen.

    From order to order only the codes go on whose symbol the context has not seen.
    """
    symbol = F.col("code").bitwiseAND(255)
    state = asked.withColumns({"so_far": F.lit(None).cast("double"), "mass": F.lit(None).cast("long"), "fresh": F.lit(None).cast("long")})
    told = []
    for order in range(ORDER, -1, -1):
        level = levels[order].select(F.col("context").alias("at"), "symbols", "total", "distinct", F.col("mass").alias("mass_below"), F.col("fresh").alias("fresh_below"))
        # By construction there are at most 256 contexts of order one, and one of order zero.
        met = state.withColumn("ask", _suffix(F.shiftright("code", 8), order)).join(F.broadcast(level) if order <= 1 else level, F.col("ask") == F.col("at"), "left")
        n = F.get(F.filter("symbols", lambda s: s["symbol"] == symbol), 0)["n"]
        first, found = F.col("so_far").isNull(), F.col("at").isNotNull()
        here = F.when(first, F.log10(n / (F.col("total") + F.col("distinct")))).otherwise(F.col("so_far") + F.log10(n / F.col("mass")))
        escape = F.when(first, F.log10(F.col("distinct") / (F.col("total") + F.col("distinct")))).otherwise(F.col("so_far") + F.when(F.col("fresh") > 0, F.log10(F.col("fresh") / F.col("mass"))).otherwise(0.0))
        met = stored(met.select(
            "code", F.when(n.isNotNull(), here).alias("log"), F.when(found, escape).otherwise(F.col("so_far")).alias("so_far"),
            F.when(found, F.col("mass_below")).otherwise(F.col("mass")).alias("mass"), F.when(found, F.col("fresh_below")).otherwise(F.col("fresh")).alias("fresh"),
        ))
        told.append(met.where("log IS NOT NULL").select("code", "log"))
        state = met.where("log IS NULL").drop("log")
    told.append(state.select("code", (F.coalesce("so_far", F.lit(0.0)) - F.log10(F.lit(float(256 - alphabet)))).alias("log")))
    return reduce(DataFrame.unionByName, told)


class CodeTable:
    """log10 predictions by code, in open addressing."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 3))))
        size = 1 << self.bits
        self.codes, self.logs = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.float32)
        left, at = np.arange(len(codes)), self._start(codes)
        self.steps = 0
        while len(left):
            free = self.codes[at] == -1
            self.codes[at[free]] = codes[left[free]]
            put = self.codes[at] == codes[left]
            self.logs[at[put]] = logs[left[put]]
            left, at = left[~put], (at[~put] + 1) & (size - 1)
            self.steps += 1

    def _start(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs (0 where there is none) and the places of the codes that are not in the table."""
        at = self._start(codes)
        held = self.codes[at]
        logs = np.where(held == codes, self.logs[at], np.float32(0))
        open_ = np.flatnonzero((held != codes) & (held != -1))
        missed = [np.flatnonzero(held == -1)]
        at = at[open_]
        for _ in range(1, self.steps + 1):
            if not len(open_):
                break
            at = (at + 1) & (len(self.codes) - 1)
            held, own = self.codes[at], codes[open_]
            found = held == own
            logs[open_[found]] = self.logs[at[found]]
            missed.append(open_[held == -1])
            on = ~found & (held != -1)
            open_, at = open_[on], at[on]
        return logs, np.sort(np.concatenate([*missed, open_]))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's sum over the codes in the table; for the others text, code and how often, in order of the texts."""
        sums, rest = np.zeros(len(texts)), []
        for codes, owners, lengths in _pieces(texts, SCORED):
            logs, missed = self.find(codes)
            ends = np.cumsum(lengths)
            np.add.at(sums, owners, np.add.reduceat(logs.astype(np.float64), ends - lengths))
            rest.append((owners[np.searchsorted(ends, missed, side="right")], codes[missed]))
        owner, code = (np.concatenate(x) for x in zip(*rest)) if rest else (np.array([], dtype=np.int64),) * 2
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.array([], dtype=np.int64)
        return sums, owner[first], code[first], np.diff(np.append(first, len(code)))


_tables: dict[int, tuple[CodeTable, dict, dict]] = {}


def _table(key: int, shared) -> tuple[CodeTable, dict, dict]:
    """The worker's tables, made once of what was broadcast."""
    if key not in _tables:
        codes, logs, words, long = shared.value
        _tables.clear()
        _tables[key] = CodeTable(codes, logs), words, long
    return _tables[key]


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, at most `most`; n is told apart to a quarter of a power of two."""
    step = F.floor(F.log2("n") * 4)
    total, least = 0, 1 << 20
    for at, entries in sorted(((r[0], r[1]) for r in counted.groupBy(step.alias("at")).count().collect()), reverse=True):
        total += entries
        if total > most:
            break
        least = at
    return counted.where(step >= least)


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("base_hot", pa.float64()),
    ("score_hot", pa.float64()), ("rare", pa.list_(pa.binary())), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def lm_score(docs: DataFrame, folds: int = 10, hot_codes: int = HOT_CODES, hot_words: int = HOT_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    Learns from the documents whose id's crc32 modulo `folds` is not 0 (a null id: from it too). Null counts as the
    empty text: one token, the end. Without training documents every word is unknown and each byte has 1/256.
    Repeated rows are learnt from and scored each; an empty table gives no rows; other columns are not read.
    `hot_codes`, `hot_words` and `hot_bytes` bound what is broadcast and change no score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), whole_text().alias("text"))
    counted = docs.where("NOT held_out").select("text").mapInArrow(_counted, "word binary, code long, n long")
    with small_batches(docs.sparkSession):
        counts = stored(counted.groupBy("word", "code").agg(F.sum("n").alias("n")))
    words = counts.where("word IS NOT NULL").select("word", "n")
    training = docs.where("NOT held_out").count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, vocabulary = total + training, distinct + (training > 0)
    scale = tokens + SMOOTHING * (vocabulary + 1)

    levels = trie_levels(counts.where("code IS NOT NULL").select("code", "n"))
    alphabet = levels[0].agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    seen = levels[ORDER].select("context", (F.col("total") + F.col("distinct")).alias("mass"), F.explode("symbols").alias("s"))
    top = _frequent(seen.select(F.shiftleft("context", 8).bitwiseOR(F.col("s.symbol")).alias("code"), F.col("s.n").alias("n"), "mass"), hot_codes)
    hot = top.select("code", F.log10(F.col("n") / F.col("mass")).cast("float").alias("log")).toArrow()
    short, long = {}, {}
    log_of = F.log10((F.col("n") + SMOOTHING) / scale)
    for r in _frequent(words, hot_words).select(F.when(F.octet_length("word") <= hot_bytes, F.col("word")).alias("word"), F.when(F.octet_length("word") > hot_bytes, F.unhex(F.md5("word"))).alias("digest"), log_of.alias("log")).toLocalIterator():
        (short if r["digest"] is None else long)[bytes(r["word"] if r["digest"] is None else r["digest"])] = r["log"]
    model = docs.sparkSession.sparkContext.broadcast((hot.column("code").to_numpy(), hot.column("log").to_numpy(), short, long))

    key = secrets.randbits(62)
    end = float(np.log10((training + SMOOTHING) / scale))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, short, long = _table(key, model)
        get = short.get
        for batch in _few(batches):
            texts = [t.encode("utf-8", "replace").lower() for t in batch.column("text").to_pylist()]
            n, known, base, rare = [], [], [], []
            for text in texts:
                own = text.split()
                values = list(map(get, own))
                missed = []
                if None in values:
                    for i, word in enumerate(own):
                        if values[i] is None:
                            if len(word) > hot_bytes:
                                values[i] = long.get(md5(word).digest())
                            if values[i] is None:
                                missed.append(word)
                n.append(len(own) + 1)
                known.append(len(own) - len(missed) + (training > 0))
                base.append(end + sum(v for v in values if v is not None))
                rare.append(missed)
            sums, owner, code, times = table.score(texts)
            offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (code, times)]
            columns = [batch.column("doc_id"), batch.column("held_out"), [len(t) for t in texts], n, known, base, sums, rare, *lists]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCORED)], schema=_SCORED)

    kind = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_hot long, base_hot double, score_hot double, rare array<binary>, codes array<long>, times array<long>"
    with small_batches(docs.sparkSession):
        rows = stored(docs.mapInArrow(scored, kind).withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / scale)
    missed = rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("m")).select("row", F.col("m.codes").alias("code"), F.col("m.times").alias("times"))
    told = predictions(missed.select("code").distinct(), levels, alphabet)
    # Both kinds of rest meet their row together.
    rest = met.select("row", log.alias("base"), F.col("n").isNotNull().cast("long").alias("known"), F.lit(0.0).alias("score")).unionByName(
        missed.join(told, "code").select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("log") * F.col("times")).alias("score"))
    )
    rest = rest.groupBy("row").agg(F.sum("base").alias("base_rest"), F.sum("known").alias("n_rest"), F.sum("score").alias("score_rest"))
    score = F.col("score_hot") + F.coalesce("score_rest", F.lit(0.0))
    return rows.drop("rare", "codes", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
