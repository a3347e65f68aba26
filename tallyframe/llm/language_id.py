"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW positions; every window is read from both sides by a small GRU,
every position gets a distribution over the languages from the two states there, and a document's distribution is the
mean over all its positions. Whole texts are read. The gates are piecewise linear, which keeps a position to a few
passes over short vectors; the network is trained by backpropagation through time with Adam.

It is fitted on a bounded sample: about SAMPLE_DOCS labelled documents of each language, picked by the hash of the id.
Their whole texts are cut into windows; each training step draws documents, and of each document a window. The weights
(a few kilobytes) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of, whole_text

HIDDEN, WINDOW = 8, 32
#: Bound of the sample: documents of a language.
SAMPLE_DOCS = 300
STEPS, BATCH, RATE = 500, 256, 0.01
#: Windows that are run together.
TOGETHER = 4096
UNKNOWN = "und"


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * 0.25 + 0.5, 0, 1)


def _run(table: np.ndarray, inner: np.ndarray, bytes_: np.ndarray, backward: bool) -> np.ndarray:
    """States of one direction at every position: (positions, windows, hidden). bytes_: (positions, windows)."""
    n, b, h = *bytes_.shape, inner.shape[0]
    states, state = np.empty((n, b, h), dtype=np.float32), np.zeros((b, h), dtype=np.float32)
    for t in range(n - 1, -1, -1) if backward else range(n):
        x, u = table[bytes_[t]], state @ inner
        gates = x[:, : 2 * h] + u[:, : 2 * h]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        fresh = u[:, 2 * h :]
        fresh *= gates[:, h:]
        fresh += x[:, 2 * h :]
        np.clip(fresh, -1, 1, out=fresh)
        # state = fresh + update * (state - fresh)
        state = state - fresh
        state *= gates[:, :h]
        state += fresh
        states[t] = state
    return states


class Network:
    """Weights by name; `languages` names the outputs."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng, c = np.random.default_rng(seed), len(languages)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.languages = languages
        self.weights = {
            "in_f": draw(256, 3 * hidden, s=0.5), "in_b": draw(256, 3 * hidden, s=0.5), "re_f": draw(hidden, 3 * hidden, s=0.3), "re_b": draw(hidden, 3 * hidden, s=0.3),
            "out_f": draw(hidden, c, s=0.3), "out_b": draw(hidden, c, s=0.3), "bias": np.zeros(c, dtype=np.float32),
        }

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(positions, windows, languages) of windows given as (positions, windows) bytes."""
        w = self.weights
        logits = _run(w["in_f"], w["re_f"], windows, False) @ w["out_f"]
        logits += _run(w["in_b"], w["re_b"], windows, True) @ w["out_b"]
        logits += w["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        w, (n, b) = self.weights, windows.shape
        states = {"f": _run(w["in_f"], w["re_f"], windows, False), "b": _run(w["in_b"], w["re_b"], windows, True)}
        logits = states["f"] @ w["out_f"] + states["b"] @ w["out_b"] + w["bias"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(b), labels] -= 1
        p /= n * b
        found = {"bias": p.sum((0, 1))}
        for side in "fb":
            found |= self._back(side, windows, states[side], p)
        return found

    def _back(self, side: str, windows: np.ndarray, states: np.ndarray, dlogits: np.ndarray) -> dict[str, np.ndarray]:
        table, inner, out = (self.weights[f"{k}_{side}"] for k in ("in", "re", "out"))
        (n, b), h = windows.shape, inner.shape[0]
        dtable, dinner = np.zeros_like(table), np.zeros_like(inner)
        dout = states.reshape(-1, h).T @ dlogits.reshape(n * b, -1)
        carried = np.zeros((b, h), dtype=np.float32)
        order = list(range(n)) if side == "f" else list(range(n - 1, -1, -1))
        for k in range(n - 1, -1, -1):
            t = order[k]
            before = states[order[k - 1]] if k else np.zeros((b, h), dtype=np.float32)
            x, u = table[windows[t]], before @ inner
            raw = (x[:, : 2 * h] + u[:, : 2 * h]) * 0.25 + 0.5
            gates = np.clip(raw, 0, 1)
            update, reset = gates[:, :h], gates[:, h:]
            pre = x[:, 2 * h :] + reset * u[:, 2 * h :]
            fresh = np.clip(pre, -1, 1)
            d = carried + dlogits[t] @ out.T
            dfresh = d * (1 - update) * (np.abs(pre) < 1)
            dgates = np.concatenate([d * (before - fresh), dfresh * u[:, 2 * h :]], axis=1) * 0.25 * ((raw > 0) & (raw < 1))
            du = np.concatenate([dgates, dfresh * reset], axis=1)
            dx = np.concatenate([dgates, dfresh], axis=1)
            np.add.at(dtable, windows[t], dx)
            dinner += before.T @ du
            carried = d * update + du @ inner.T
        return {f"in_{side}": dtable, f"re_{side}": dinner, f"out_{side}": dout}

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 2) -> None:
        """Adam over windows of the texts, in batches in which every language has the same share."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        # A text that is shorter than a window is repeated until it fills one.
        raw = [t * (WINDOW // len(t) + 1) if len(t) < WINDOW else t for t in texts]
        joined, sizes = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(t) for t in raw])
        begins = np.cumsum(sizes) - sizes
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(own, max(1, batch // len(by))) for own in by])
            at = begins[rows] + (rng.random(len(rows)) * (sizes[rows] - WINDOW + 1)).astype(np.int64)
            slow = rate * (1 if step < steps * 0.6 else 0.2)
            for k, g in self.gradients(joined[at[None, :] + np.arange(WINDOW)[:, None]], labels[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
            self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all positions of each text's distributions (zeros for an empty text)."""
        sums = np.zeros((len(texts), len(self.languages)))
        part: list[bytes] = []
        owners: list[int] = []

        def run() -> None:
            raw = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, WINDOW)
            owner = np.repeat(owners, [len(t) // WINDOW for t in part])
            short = np.array([len(texts[k]) for k in owners])
            for i in range(0, len(raw), TOGETHER):
                p = self.probabilities(np.ascontiguousarray(raw[i : i + TOGETHER].T))
                own = owner[i : i + TOGETHER]
                np.add.at(sums, own, p.sum(0))
                # A text's last window is filled up: what stands beyond its end doesn't count.
                ends = np.cumsum([len(t) // WINDOW for t in part]) - 1
                for k in np.flatnonzero((ends >= i) & (ends < i + TOGETHER)):
                    spare = short[k] % WINDOW
                    if spare:
                        sums[owners[k]] -= p[spare:, ends[k] - i].sum(0)

        for k, text in enumerate(texts):
            if text:
                part.append(text + b"\0" * (-len(text) % WINDOW))
                owners.append(k)
            if part and (sum(map(len, part[-1:])) + len(part) * WINDOW >= TOGETHER * WINDOW or len(part) >= 256 or k == len(texts) - 1):
                run()
                part, owners = [], []
        if part:
            run()
        return sums / np.maximum([[len(t)] for t in texts], 1)


def sample_texts(docs: DataFrame) -> pd.DataFrame:
    """lang, text of a bounded sample of the labelled documents (columns doc_id, text, lang)."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return pd.DataFrame({"lang": [], "text": []})
    # One entry a language: looked up in the row, so that no text is shuffled to its language's rate.
    rate = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(SAMPLE_DOCS / r["count"]))]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(place < rate).select("doc_id", "lang", "text").toPandas().sort_values(["lang", "doc_id", "text"])


def train(docs: DataFrame) -> Network | None:
    """A network of the languages that docs have; None if docs have no label."""
    sample = sample_texts(docs)
    if not len(sample):
        return None
    languages = sorted(sample["lang"].unique())
    network = Network(languages)
    network.fit([t.encode("utf-8", "replace") for t in sample["text"]], np.array([languages.index(x) for x in sample["lang"]]))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score (the pooled probability of that language, 0 to 1).

    Null texts and texts without a letter are `und` with score 0, and so is every text if there is no network. Ties
    go to the language that comes first by name; repeated rows are judged each; an empty table gives no rows. All
    other columns stay, and columns of docs by those two names are replaced.
    """
    if network is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((network.languages, network.weights))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, weights = shared.value
        own = Network(names)
        own.weights = weights
        for part in texts:
            mean = own.pooled([t.encode("utf-8", "replace") for t in part])
            best = mean.argmax(1) if len(mean) else np.array([], dtype=int)
            yield pd.DataFrame({"lang_pred": np.array(names, dtype=object)[best], "score": np.clip(mean[np.arange(len(mean)), best], 0, 1)})

    known = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    out = docs.select(F.struct(*docs.columns).alias("doc"), judged(whole_text()).alias("judged"), known.alias("known"))
    return out.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")],
        F.when(F.col("known"), F.col("judged.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), F.col("judged.score")).otherwise(0.0).alias("score"),
    )


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns where crc32 of the id modulo folds isn't held_out.

    A document without an id is in fold 1. See `identify` for nulls and ties.
    """
    docs = docs.select("doc_id", "text", "lang", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"))
    network = train(docs.where("NOT held_out"))
    return identify(docs.drop("lang"), network).select("doc_id", "held_out", "lang_pred", "score")
