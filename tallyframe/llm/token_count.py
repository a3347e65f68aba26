"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens, whose lengths depend on nothing else. Tier one is a compact table
of frequent pre-tokens and their lengths, broadcast once; tier two is a cache in each worker that encodes what the
table lacks. Pre-tokens never leave the task that cut them: the count adds no shuffle.

The table is fitted on a bounded sample of documents (TABLE_DOCS, picked by the hash of the id) and only saves time:
with any table, or none, the counts are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import whole_text

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Documents, at most about, whose pre-tokens the table is fitted on; entries of the table; entries of a worker's cache.
TABLE_DOCS, TABLE_SIZE, CACHE_SIZE = 2_000, 50_000, 400_000
#: Fixed value: how a byte-level tokenizer cuts a text before its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these code points only are cut by PRE_TOKEN; others, where Unicode versions may differ, by the tokenizer's
#: own pre-tokenizer. Either way the pieces take the look-up.
PLAIN = r"[\x00-ɏͰ-ϿЀ-ԯ‐-‧‰-⁞₠-₿←-⇿∀-⋿一-龥ぁ-ゖァ-ヺ가-힣]*"

_worker: dict = {}


def _load(path: str):
    """The worker's tokenizer, loaded once."""
    if path not in _worker:
        from tokenizers import Tokenizer

        _worker[path] = Tokenizer.from_file(path)
        _worker[path].no_truncation()
        _worker[path].no_padding()
    return _worker[path]


def _length(tokenizer, text: str) -> int:
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


class Counting:
    """Counts tokens of texts in one worker."""

    def __init__(self, path: str, table: dict[str, int], cache_size: int = CACHE_SIZE):
        self.tokenizer, self.table, self.cache, self.cache_size = _load(path), table, {}, cache_size
        self.encoded = 0
        self.find, self.plain = regex.compile(PRE_TOKEN).findall, regex.compile(PLAIN).fullmatch
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # A tokenizer that rewrites texts or takes blanks into its added tokens is left to the library.
        self.whole = self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.special = [t.content for t in added]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if added else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if self.plain(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.whole:
            return _length(self.tokenizer, text)
        if not any(s in text for s in self.special):
            return self._looked_up(text)
        # An added token inside a text is one token, and what stands beside it is cut by itself.
        parts = self.split(text)
        return len(parts) - 1 + sum(self._looked_up(part) for part in parts if part)

    def _looked_up(self, text: str) -> int:
        table, cache, total = self.table.get, self.cache, 0
        misses = []
        for piece, n in zip(pieces := self.pieces(text), map(table, pieces)):
            if n is None:
                misses.append(piece)
            else:
                total += n
        for piece in misses:
            n = cache.get(piece)
            if n is None:
                if len(cache) >= self.cache_size:
                    cache.clear()
                n = cache[piece] = _length(self.tokenizer, piece)
                self.encoded += 1
            total += n
        return total


def fit_table(docs: DataFrame, path: str, table_docs: int = TABLE_DOCS, size: int = TABLE_SIZE) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample and their token counts; each task sends its own counts only."""
    rows = docs.count()
    every = max(1, rows // table_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(whole_text().alias("text"))
    find = regex.compile(PRE_TOKEN).findall

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(find(text))
        top = seen.most_common(size)
        yield pd.DataFrame({"piece": pd.Series([p for p, _ in top], dtype=object), "n": pd.Series([n for _, n in top], dtype="int64")})

    total: Counter = Counter()
    for row in sample.mapInPandas(counted, "piece string, n long").toLocalIterator():
        total[row["piece"]] += row["n"]
    tokenizer = _load(path)
    return {piece: _length(tokenizer, piece) for piece, _ in islice(total.most_common(), size)}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, table: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, whatever other columns it has.

    No begin, end or other special token is added; special strings inside a text count as the library takes them.
    Null counts as the empty text: no bytes, no tokens. Repeated rows are counted each; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    table = fit_table(docs, path) if table is None else table
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counting = Counting(path, shared.value)
        for part in texts:
            yield pd.Series([counting.count(text) for text in part], dtype="int64")

    text = whole_text()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
