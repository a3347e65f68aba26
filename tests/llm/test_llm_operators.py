"""Each operator on small odd inputs and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import components, cuckoo, decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, mixture, simhash_dedup, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, rank int"
LONG = " ".join(f"word{i % 977} the" for i in range(20_000))
TEXTS = [
    (1, "The quick fox.\nThis line is long enough to count.\nMIT License"), (2, None), (3, ""), (4, "   \n\t"), (5, "The quick fox.\nThis line is long enough to count.\nmit license"),
    (6, "THE QUICK FOX.\nthis line is long enough to count.  \nEnd"), (7, LONG), (7, LONG), (8, "Ünïcödé ÉCOLE\nThis line is long enough to count."), (None, "no id\nThis line is long enough to count."),
    (9, "123 456"), (10, "apache license apache license"), (11, "a b c d e f g h i j k l m n o p"), (12, "a b c d e f g h i j k l m n o p"), (13, "Licensed under the Apache License, Version 2.0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "a"][k % 4], 0, 1, 0.5, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_license_scan(docs, empty):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(TEXTS) and license_scan.license_scan(empty).count() == 0
    for row in got:
        text = next(t for i, t in TEXTS if i == row.doc_id)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        at = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE if words[i : i + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_license_containment(spark):
    rows = [(1, "SPDX-License-Identifier: GPL-2.0-only"), (2, "GNU Lesser General Public License"), (3, "see creativecommons.org/licenses/by-sa/4.0 and CC-BY-4.0"), (4, "mit license " * 500)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score, got[1].n_found) == ("gpl", 1.0, 1)
    assert (got[2].labels, got[2].base_labels, got[2].n_found) == ("gpl,lgpl", "gpl", 1)
    assert got[3].labels == "cc-by,cc-by-sa" and (got[4].n_base, got[4].first_word, got[4].last_word) == (500, 0, 998)


def test_token_count(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_count.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(20, "a<|endoftext|>b"), (21, "漢字 \u0085 😀 é  x"), (22, "don't  \n\n stop")], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), odd):
        for row in token_count.count_tokens(table, path).join(table, "doc_id").collect():
            assert row.n_tokens == len(tokenizer.encode(row.text or "", add_special_tokens=False).ids) and row.n_bytes == len((row.text or "").encode())
    assert token_count.count_tokens(empty, path).count() == 0
    small = token_count.Counting(path, {" the": 1}, cache_size=2)
    assert small.count(LONG[:2000]) == len(tokenizer.encode(LONG[:2000], add_special_tokens=False).ids)


def test_token_count_looks_up_any_script(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_count.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    random.seed(8)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "7", "\u00e9", "e\u0301", "\U0001f600", "\u200b", "\u6f22", "\u0301", "!", "\u0085", "\u3000", "<|endoftext|>", "<|end", "\U0001f468\u200d\U0001f469", "\u0e01\u0e34"]
    counting = token_count.Counting(path, {})
    for _ in range(400):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 30)))
        assert counting.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    # A text with an emoji meets the table like any other: nothing is encoded anew.
    again = "one \U0001f600 two e\u0301 <|endoftext|> three"
    known = token_count.Counting(path, dict.fromkeys([p for part in again.split("<|endoftext|>") for p in counting.pieces(part)], 1))
    assert known.count(again) == len(counting.pieces(again.split("<")[0])) + 1 + len(counting.pieces(again.split(">")[1])) and known.encoded == 0


def test_mixture(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 40) if i % 11 else None, None if i % 13 == 0 else f"s{min(i % 5, 2)}") for i in range(600)] + [(5, "w w w", "s1")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixture.mix(table, shards=4).collect()]
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {**{s: 3.0 * sizes[s] for s in capped}, **share}
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
    again = [r.asDict() for r in mixture.mix(table.repartition(7), shards=4).collect()]
    key = lambda r: (r["doc_id"], str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    for r in got:
        assert sum(p.words for p in r["pieces"]) == r["taken"] and all(0 <= p.shard < 4 and 0 <= p.start and p.start + p.words <= r["size"] for p in r["pieces"])
        # No word of a document is drawn more often than there are epochs, nor twice in one draw.
        assert max(Counter(w for p in r["pieces"] for w in range(p.start, p.start + p.words)).values(), default=0) <= 3
    assert mixture.mix(docs).count() == len(TEXTS) and mixture.mix(empty).count() == 0


def test_mixture_shards_hold_what_the_leaves_say(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixture, "LEAST_BLOCK_WORDS", 8)
    rows = [(i, "w " * (i % 30), ["a", "b", None][min(i % 7, 2)]) for i in range(500)]
    sizes = spark.createDataFrame([(i, s, len(t.split()), k) for k, (i, t, s) in enumerate(rows)], "doc_id long, source string, size long, row long")
    plan = mixture.plan_blocks(mixture.source_targets(sizes), 5)
    drawn = mixture.draw_blocks(plan).collect()
    for own in plan.collect():
        mine = [d for d in drawn if d.source == own.source]
        assert sorted(d.draw for d in mine) == list(range(own.blocks)) and sum(d.words for d in mine) == own.quota == round(own.target)
        assert [sum(d.shard <= k for d in mine) for k in range(5)] == own.ends
        # A block is drawn once in an epoch at most, and but for the last draw and a source's last block it is whole.
        assert len({(d.epoch, d.block) for d in mine}) == len(mine)
        assert all(d.words == 8 for d in mine if d.block < own.whole and d.draw < own.blocks - 1)
        partial = [d.block for d in sorted(mine, key=lambda d: d.draw) if d.epoch == own.epochs]
        assert len(partial) < 6 or partial != sorted(partial)
    mixed = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=5)
    held = Counter()
    for r in mixed.selectExpr("source", "inline(pieces)").collect():
        held[r.source, r.draw] += r.words
    assert held == Counter({(d.source, d.draw): d.words for d in drawn})
    mixture.write_shards(mixed, str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.shard: r.n for r in written.groupBy("shard").sum("words").withColumnRenamed("sum(words)", "n").collect()} == {k: sum(d.words for d in drawn if d.shard == k) for k in range(5)}
    places = {}
    for r in written.collect():
        places.setdefault((r.source, r.draw), []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_mixture_refuses_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixture.mix(spark.createDataFrame([(i, "w", str(i)) for i in range(3)], "doc_id long, text string, source string"))


def test_hypergeometric_tree(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 5), ("z", 0)], "source string, blocks long")
    got = {r.source: r.ends for r in mixture.splitting_tree(quotas, 8).collect()}
    assert {s: e[-1] for s, e in got.items()} == {"a": 100, "b": 37, None: 5, "z": 0} and all(e == sorted(e) and len(e) == 8 for e in got.values())
    total = np.sum([np.diff([0, *e]) for e in got.values()], axis=0)
    assert total.max() - total.min() <= 2


def test_simhash(docs, empty):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash_dedup.simhash_components(docs).collect()
    assert len(got) == len(TEXTS) and simhash_dedup.simhash_components(empty).count() == 0
    by = {}
    for row in got:
        assert row.fingerprint in {f"{brute(t):016x}" for i, t in TEXTS if i == row.doc_id}
        by.setdefault(row.fingerprint, set()).add(row.component_id)
    assert all(len(c) == 1 for c in by.values()) and by["0" * 16] == {2}


def test_simhash_links_documents_without_ids(spark):
    words = [f"w{i}" for i in range(400)]
    other = [*words[:200], "changed", *words[201:]]
    rows = [(None, " ".join(words)), (None, " ".join(other)), (7, " ".join(words[:150])), (None, "quite another text here")]
    got = {r.text: r for r in simhash_dedup.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text")).withColumnRenamed("fingerprint", "text").collect()}
    assert len(got) == 4 and {r.component_id for r in got.values()} <= {None, 7}
    fps = spark.createDataFrame([(1, 5), (3, 9)], "fp long, rep long")
    assert simhash_dedup.near_links(fps).collect() and not simhash_dedup.near_links(fps.limit(0)).collect()


def test_tiles_are_skipped_by_population_count():
    """Of the tile pairs of a large group most are skipped, and no link is lost."""
    rng = np.random.default_rng(3)
    free = rng.permutation(1 << 18)[:20_000].astype(np.uint64)
    fps = free[np.lexsort((free, np.bitwise_count(free)))]
    compared = []
    roots = simhash_dedup.tile_links(fps, np.bitwise_count(fps).astype(np.int64), radius=1, tile=256, met=lambda i, j: compared.append((i, j)))
    tiles = -(-len(fps) // 256)
    assert len(compared) < 0.6 * tiles * (tiles + 1) / 2
    place = {int(f): k for k, f in enumerate(fps)}
    pairs = [(k, place[n]) for k, f in enumerate(fps.tolist()) for b in range(18) if (n := f ^ (1 << b)) in place]
    assert all(roots[a] == roots[b] for a, b in pairs)
    brute = simhash_dedup._roots(len(fps), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert len(set(brute.tolist())) == len(set(roots.tolist()))


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [base]
    for _ in range(6):
        flips.append(flips[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    fps = np.unique(np.concatenate([*flips, np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    ids = rng.permutation(len(fps))
    table = spark.createDataFrame([(int(i), int(np.int64(f.view(np.int64)))) for i, f in zip(ids, fps)], "rep long, fp long").select("fp", "rep")
    got = {r.node: r.component for r in components.components(simhash_dedup.near_links(table)).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            root[find(i)] = find(int(j))
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), 1 << 60), int(ids[i]))
    assert all(got.get(int(ids[i]), int(ids[i])) == least[find(i)] for i in range(len(fps)))
    order = np.lexsort((fps, np.bitwise_count(fps)))
    tiles = simhash_dedup.tile_links(fps[order], np.bitwise_count(fps[order]).astype(np.int64), tile=16)
    assert len(set(tiles.tolist())) == len(least)


def test_chain_components(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (200, 100), (100, 200)], "node long, other long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 200: 100}
    assert components.components(links.limit(0)).count() == 0


def _brute_ppm(train, order=lm_score.ORDER):
    """Predictions by the definition: escape by method C, symbols of longer contexts excluded."""
    counts = [{} for _ in range(order + 1)]
    for t in train:
        b = lm_score.MARK * order + t + lm_score.MARK
        for i in range(order, len(b)):
            for k in range(order + 1):
                own = counts[k].setdefault(b[i - k : i], Counter())
                own[b[i]] += 1

    def at(b, i):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts[k].get(b[i - k : i], {}).items() if s not in excluded}
            if own:
                t, d = sum(own.values()), len(own)
                if b[i] in own:
                    return p * own[b[i]] / (t + d)
                p, excluded = p * d / (t + d), excluded | set(own)
        return p / (256 - len(excluded))

    def score(text):
        b = lm_score.MARK * order + text + lm_score.MARK
        return sum(math.log10(at(b, i)) for i in range(order, len(b)))

    return score, counts


def _trains(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


@pytest.mark.parametrize("hot_codes,hot_words,hot_bytes", [(50, 3, 4), (0, 0, 64), (1 << 20, 100_000, 64)])
def test_lm_score(spark, docs, empty, hot_codes, hot_words, hot_bytes):
    got = lm_score.lm_score(docs, hot_codes=hot_codes, hot_words=hot_words, hot_bytes=hot_bytes).collect()
    tokens = lambda t: (t or "").encode().lower().split()
    own_texts = [(t or "").encode().lower() for i, t in TEXTS if _trains(i)]
    train, n = Counter(w for t in own_texts for w in t.split()), len(own_texts)
    train[None] = n
    total, v = sum(train.values()), len(train)
    ppm, _ = _brute_ppm(own_texts)
    assert len(got) == len(TEXTS)
    for row in got:
        text = next(t for i, t in TEXTS if i == row.doc_id)
        own = [*tokens(text), None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (v + 1))) for w in own)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(train[w] > 0 for w in own), total)
        assert abs(row.base_score - base) < 1e-6 * max(1, abs(base))
        if len(text or "") < 1000:
            assert abs(row.score - ppm((text or "").encode().lower())) < 1e-3


def test_lm_score_keeps_every_context(spark, empty):
    random.seed(3)
    texts = [(i, "".join(random.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(1500))) for i in range(60)] + [(100, ""), (101, None), (102, "zq\u00e9 \U0001f600 ab")]
    ppm, counts = _brute_ppm([(t or "").encode() for i, t in texts if _trains(i)])
    assert min(map(len, counts[4:])) > 24_576
    got = lm_score.lm_score(spark.createDataFrame(texts, "doc_id long, text string"), hot_codes=5_000).collect()
    for row in got:
        assert abs(row.score - ppm((dict(texts)[row.doc_id] or "").encode())) < 2e-3
    assert lm_score.lm_score(empty).count() == 0


def test_lm_score_without_training(spark):
    held = next(i for i in range(100) if not _trains(i))
    row = lm_score.lm_score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert abs(row.score - 3 * math.log10(1 / 256)) < 1e-5 and (row.n_known, row.train_tokens) == (0, 0)


def test_code_pieces():
    texts = [b"", b"abcdefghijk", b"x", b"a" * 37]
    whole = [c.tolist() for c, _, _ in lm_score._pieces(texts, 1 << 20)][0]
    cut, sizes = [], Counter()
    for codes, owners, lengths in lm_score._pieces(texts, 4):
        cut += codes.tolist()
        for k, n in zip(owners.tolist(), lengths.tolist()):
            sizes[k] += n
    assert cut == whole and [sizes[k] for k in range(4)] == [len(t) + 1 for t in texts]


def test_decontaminate(spark, docs, empty):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [[random.choice(vocabulary) for _ in range(random.randint(1, 40))] for _ in range(60)]
    texts = []
    for own in items:
        t = list(own)
        for _ in range(random.randint(0, 9)):
            t[random.randrange(len(t))] = random.choice(vocabulary)
        texts.append([random.choice(vocabulary) for _ in range(20)] + t + [random.choice(vocabulary) for _ in range(20)])

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i] + [0] * len(t)
            for j, y in enumerate(t, 1):
                new[j] = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            row = new
        return min(row)

    table = spark.createDataFrame([(k, " ".join(t).upper() + "!") for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, ", ".join(t)) for k, t in enumerate(items)] + [(900, None), (901, "..")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(table, bench).collect()}
    expected = {(d, i): x for d, t in enumerate(texts) for i, p in enumerate(items) if (x := distance(p, t)) <= decontaminate.budget(len(p))}
    assert got == expected and len(got) > 20
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == len(TEXTS)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: F.substring(F.sha2(F.encode(norm, "UTF-8"), 256), 1, 1)])
def test_exact_dedup(spark, docs, tmp_path, monkeypatch, digest):
    """Also with a digest that texts share, and with groups that are dealt out by a salt."""
    monkeypatch.setattr(exact_dedup, "PIECE_ROWS", 2)
    path = str(tmp_path / "d.parquet")
    docs.repartition(3).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, digest=digest).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(TEXTS)
    for row in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == row.text_sha256 and row.doc_id in g)
        keep = max((i for i in own if i is not None), default=None)
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(own), row.doc_id == keep)


def test_exact_dedup_resumes(spark, docs, empty, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    docs.where("doc_id < 6").write.parquet(path)
    exact_dedup.update_state(spark, path, state)
    docs.where("doc_id >= 6").write.mode("append").parquet(path)
    got = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, state).collect()}
    assert got[hashlib.sha256(b"").hexdigest()] == (3, 2)
    nothing = str(tmp_path / "e.parquet")
    empty.write.parquet(nothing)
    assert exact_dedup.exact_dedup(spark, nothing).count() == 0


def _lines(rows):
    """doc_id -> kept text, by the contract."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    lost = {k: max(i for i in v if i is not None) for k, v in holders.items() if len(v) >= 3}
    return [(i, [line for line in (t or "").split("\n") if lost.get(key(line), i) == i]) for i, t in rows]


def _lined(spark, n=150):
    """Documents of which each holds lines of many others; ids from -3 on, one without."""
    random.seed(5)
    say = lambda k: f"this is the line number {k} of the book"
    rows = [(i, "\n".join(say(random.choice([random.randint(0, 9), random.randint(0, 200), 5000 + (i or -9)])) for _ in range(6))) for i in [None, *range(-3, n)]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def _cut(index, table):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.kept or "") for r in index.cut(table).collect()))


def _expected(rows):
    return sorted((i is not None, i or 0, "\n".join(kept)) for i, kept in _lines(rows))


def test_line_dedup(docs, empty):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.kept or "", r.n_lines) for r in line_dedup.dedup_lines(docs).collect()))
    assert got == sorted((i is not None, i or 0, "\n".join(kept), len((next(t for j, t in TEXTS if j == i) or "").split("\n"))) for i, kept in _lines(TEXTS))
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("gate,hot,keys", [(8, 3, 4), (64, 1 << 40, 2), (1 << 26, 10_000, 32_768)])
def test_line_dedup_by_shards(spark, monkeypatch, gate, hot, keys):
    """The same with a bitmap that lets all lines through, with or without broadcast keys, with shards of a few bytes."""
    rows, table = _lined(spark)
    for name, value in (("GATE_BITS", gate), ("HOT_KEYS", hot), ("SHARD_KEYS", keys), ("LEAST_SHARDS", 3)):
        monkeypatch.setattr(line_dedup, name, value)
    index = line_dedup.LineIndex.build(table)
    assert keys > 100 or index.shards > 10
    if gate == 8:
        monkeypatch.setattr(index, "_gate", lambda: np.full(8, 255, dtype=np.uint8))
    assert _cut(index, table) == _expected(rows)


def test_line_dedup_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 2)
    rows, table = _lined(spark, 60)
    index = line_dedup.LineIndex.build(table.where("doc_id IS NULL OR doc_id < 40"))
    before = {r.shard: bytes(r.filter) for r in index.filters.collect()}
    grown = index.insert(table.where("doc_id = 40"))
    after = {r.shard: bytes(r.filter) for r in grown.filters.collect()}
    assert sum(before.get(k) != v for k, v in after.items()) < len(after)  # one document leaves other shards alone
    grown = grown.insert(table.where("doc_id > 40"))
    assert _cut(grown, table) == _expected(rows)
    shrunk = grown.delete(table.where("doc_id % 3 = 0"))
    left = [(i, t) for i, t in rows if i is None or i % 3]
    assert _cut(shrunk, table.where("doc_id IS NULL OR doc_id % 3 <> 0")) == _expected(left)
    assert _cut(shrunk.insert(table.where("doc_id % 3 = 0")), table) == _expected(rows)


def test_line_dedup_remakes_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 1)
    rows, table = _lined(spark, 200)
    index = line_dedup.LineIndex.build(table.where("doc_id < 6")).insert(table.where("doc_id IS NULL OR doc_id >= 6"))
    assert _cut(index, table) == _expected(rows)


def test_line_dedup_keeps_columns(spark):
    rows, table = _lined(spark, 20)
    odd = table.selectExpr("doc_id", "text", "1 AS lines", "2 AS hits", "'x' AS kept", "3 AS n_lines", "4 AS `__row`", "5 AS row", "6 AS doc")
    out = line_dedup.dedup_lines(odd)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lines", "hits", "__row", "row", "doc", "n_lines", "n_dropped", "kept"])
    assert {(r.lines, r.hits, r["__row"], r.row, r.doc) for r in out.collect()} == {(1, 2, 4, 5, 6)}


def test_cuckoo_filter():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    made = cuckoo.CuckooFilter.from_bytes(cuckoo.CuckooFilter.of(hashes[:10_000]).to_bytes())
    assert made.holds(hashes[:10_000]).all() and made.holds(hashes[10_000:]).mean() < 0.01
    made.delete(hashes[:5_000])
    assert made.holds(hashes[5_000:10_000]).all() and made.holds(hashes[:5_000]).mean() < 0.01


def test_language_id(spark, docs, empty):
    random.seed(4)
    kinds = {"xx": ["thor", "anding", "whe"], "yy": ["ción", "ñada", "llo"], "zz": ["schü", "keit", "ung"]}
    rows = [(i, " ".join(random.choice(kinds[k]) for _ in range(random.randint(3, 60))), k) for i in range(600) for k in [sorted(kinds)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(table).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i, _, _ in rows) and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    odd = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[9].lang_pred == "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert language_id.language_id(empty).count() == 0


def test_language_id_replaces_its_columns(spark, docs):
    table = docs.selectExpr("doc_id", "text", "lang", "7 AS score", "8 AS judged", "9 AS known", "'q' AS lang_pred", "1 AS doc")
    out = language_id.identify(table, language_id.Network(["a", "b"]))
    assert sorted(out.columns) == sorted(table.columns) and {(r.judged, r.known, r.doc) for r in out.collect()} == {(8, 9, 1)} and {r.lang_pred for r in out.collect()} <= {"a", "b", "und"}
    assert set(language_id.identify(table, None).toPandas()["lang_pred"]) == {"und"}


def test_pooling_against_a_plain_loop():
    """Every position of whole texts counts once, whatever texts stand beside it."""
    rng = np.random.default_rng(7)
    network = language_id.Network(["a", "b", "c"], seed=3)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (0, 1, 31, 32, 33, 700, 5, 64, 200_000, 0, 3)] + [b"xy"] * 600
    got = network.pooled(texts)
    for text, mean in list(zip(texts, got))[:14]:
        sums = np.zeros(3)
        for i in range(0, len(text), language_id.WINDOW):
            own = np.frombuffer(text[i : i + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), dtype=np.uint8)[:, None]
            sums += network.probabilities(own)[: len(text) - i, 0].sum(0)
        assert np.allclose(mean, sums / max(1, len(text)), atol=1e-4)
    assert np.allclose(got[11:], got[11])


def test_gru_gradients():
    network = language_id.Network(["a", "b"], hidden=3, seed=5)
    network.weights = {k: v.astype(np.float64) * 0.5 for k, v in network.weights.items()}
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(97, 100, (5, 4)), np.array([0, 1, 1, 0])

    def loss():
        p = network.probabilities(windows)
        return -np.log(p[:, np.arange(4), labels]).mean()

    found = network.gradients(windows, labels)
    for name, at in (("re_f", (0, 1)), ("re_b", (1, 7)), ("in_f", (98, 8)), ("out_b", (2, 1)), ("bias", (0,))):
        kept = network.weights[name][at]
        network.weights[name][at] = kept + 1e-2
        up = loss()
        network.weights[name][at] = kept - 1e-2
        slope = (up - loss()) / 2e-2
        network.weights[name][at] = kept
        assert abs(slope - found[name][at]) < 2e-3 + 0.05 * abs(slope)


def test_toxicity(spark, docs, empty):
    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(800):
        own = [random.choice(words) for _ in range(random.randint(20, 200))]
        for _ in range(2 * (i % 4 == 0)):
            own.insert(random.randrange(len(own)), random.choice(["Bad,", "awful", "NASTY!"]))
        rows.append((i, " ".join(own)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97 and all(got[i].held_out for i in held)
    assert toxicity.toxicity(docs, labels).count() == len(TEXTS) and toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {1 / (1 + math.exp(35))}


def test_ftrl_against_the_update_rule():
    """The fitted weights are those of the per-coordinate rule applied one row and coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 12)) if k % 3 else np.array([1, 2, 3]), int(k % 3 == 0)) for k in range(120)]
    at, weights = toxicity.fit([(a.astype(np.int64), y) for a, y in rows], passes=2, seed=9)
    bias, z, g2 = 1 << toxicity.BITS, Counter(), Counter()

    def weight(i):
        limit = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= limit:
            return 0.0
        return -(z[i] - math.copysign(limit, z[i])) / ((toxicity.BETA + math.sqrt(g2[i])) / toxicity.ALPHA + toxicity.L2)

    met = Counter(i for a, _ in rows for i in a.tolist())
    order, draw = np.arange(len(rows)), np.random.default_rng(9)
    for _ in range(2):
        draw.shuffle(order)
        for k in order:
            own = [i for i in rows[k][0].tolist() if met[i] >= toxicity.LEAST_ROWS] + [bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in own:
                sigma = (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                g2[i] += g * g
    expected = {i: weight(i) for i in [*range(40), bias] if weight(i) or i == bias}
    assert set(at.tolist()) == set(expected) and all(abs(w - expected[i]) < 1e-9 for i, w in zip(at.tolist(), weights))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_SLOTS", 4_000)
    rows = [(i, f"word{i % 7} " * 3 + ("vile " if i % 2 else "kind ") + f"other{i}") for i in range(1500)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == 1500 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.97


def test_decontaminate_judges_rows_not_ids(spark, monkeypatch):
    """A leak without an id goes, a clean row that shares a leak's id stays, in one block of items and in several."""
    item, other = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(20))
    rows = [(None, f"x {item} y", 1), (None, "clean", 2), (5, f"{other}", 3), (5, "clean too", 4), (6, None, 5), (7, "", 6), (8, item.upper().replace(" ", ", "), 7), (9, " ".join(item.split()[:10]), 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (1, item)], "item_id long, text string")
    for words in (2_000_000, 5):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
        got = decontaminate.decontaminate(table, bench)
        assert got.columns == table.columns and sorted(r.item_id for r in got.collect()) == [2, 4, 5, 6, 8]
        assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(table, bench).collect()) == [(0, 1), (0, 1), (5, 2), (8, 1), (8, 1)]
    assert decontaminate.decontaminate(table, bench.where("item_id > 9")).count() == len(rows)
    assert decontaminate.decontaminate(table.where("item_id > 9"), bench).count() == 0
