"""Filter audit, personal data and lexical search against brute force: nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit, lexical_search, pii, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, rank int, found string, kept string, n long"
SAY = ["the", "of", "The", "Zebra", "naïve", "漢字", "a", "b", "cc", "0x7f", "#tag", "1", "x&y", "ÉCOLE", " ", "\u0085"]


@pytest.fixture(scope="module")
def rows():
    random.seed(13)
    texts = [None, "", " \n\t", "one", "ONE", "A" * 300, "w " * 250, "word " * 40_000, " ".join(random.choice(SAY[:6]) for _ in range(400)), "\x00 \x0b x \x1c y"]
    texts += [" ".join(random.choice(SAY) + random.choice(["", "", str(random.randint(0, 60))]) for _ in range(random.choice([3, 30, 199, 200, 260]))) for _ in range(90)]
    texts += [random.choice(texts) for _ in range(40)]
    out = [(random.choice([None, k, k, k, k, k // 2, -k]), t, "en", random.choice([None, "", "a", "b", "b", "b"]), 0, "mine", k, "mine", "mine", 5) for k, t in enumerate(texts)]
    return out + out[20:24]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- filter audit


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    told = []
    for i, t, _, source, *_ in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        told.append((source or "", {x for x in "ABCDE" if fails[x]}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, bad, *_ in told:
            for x in order:
                if x in bad:
                    shapley[part, x] += 1
                    break
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in told}:
            own = [d for d in told if d[0] == part]
            for step, x in enumerate(order, 1):
                left = [d for d in own if not d[1] & set(order[: step - 1])]
                gone = [d for d in left if x in d[1]]
                out[part, order, step] = (len(left) - len(gone), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), shapley[part, x])
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, rows, docs, empty):
    labels = [(i, random.choice([None, 0, 1]), random.choice([None, 0, 1])) for i in range(-10, 100, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in filter_audit.filter_audit(docs, table).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.filter_audit(empty, table).count() == 0
    without = filter_audit.filter_audit(docs, table.where("doc_id > 1000")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(without) == (0, 0)


def test_matrix(spark, rows, docs, monkeypatch):
    """Shards hold each document's words under the dictionary's numbers, with a hash that collides all the time too."""
    monkeypatch.setattr(filter_audit, "SHARD_DOCS", 7)
    given = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    for number in (filter_audit.number_of, lambda w: len(w) % 3):
        shards, dictionary = filter_audit.document_term_matrix(given, number)
        named = {r.number: bytes(r.word) for r in dictionary.collect()}
        assert len(named) == dictionary.count() == len({w for _, t, *_ in rows for w in words(t)})
        got = Counter()
        for s in shards.collect():
            for k, doc in enumerate(s.doc_id):
                entries = range(s.indptr[k], s.indptr[k + 1])
                got[doc, s.part[k], frozenset((named[s.numbers[s.local[e]]], s.counts[e]) for e in entries)] += 1
        want = Counter()
        for i, t, _, source, *_ in rows:
            want[i, source or "", frozenset((filter_audit._key(w.encode()), n) for w, n in Counter(words(t)).items())] += 1
        assert got == want


# -- personal data

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    good = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, t) if good[k](m[0]))


def test_plain_identifiers():
    random.seed(2)
    parts = ["a", "b1", "@", ".", "-", " ", "+", "7", "12", "255", "300", "_", "%", "(", ")", "é", "4111111111111111", " at ", " dot ", "[.]", "four ", "о", "​", "\n", "١"]
    for _ in range(20_000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 40)))
        assert pii.identifiers(t) == brute_pii(t)
        found = pii.find(t)
        assert [(s, k, e) for s, k, e, plain, _ in found if plain] == brute_pii(t) and all(0 <= s < e <= len(t) for s, _, e, *_ in found)


DISGUISED = [
    ("mail {} now", "john.doe [at] example [dot] com", "email", "john.doe@example.com"), ("{}. Then", "john dot smith at mail dot example dot co dot uk", "email", "john.smith@mail.example.co.uk"),
    ("to {}", "jоhn@exаmple.com", "email", "john@example.com"), ("to {}!", "j​ohn@exam­ple.com", "email", "john@example.com"), ("{}", "user＠example．com", "email", "user@example.com"),
    ("ask {}", "john_at_example_dot_com", "email", "john@example.com"), ("{}, please", "joe(at)example(dot)org", "email", "joe@example.org"), ("x {} y", "c@d dot com", "email", "c@d.com"), ("by {}", "𝐣𝐨𝐞@𝐞𝐱.org", "email", "joe@ex.org"),
    ("call {} please", "plus four four two zero seven nine four six zero nine five eight", "phone", "+442079460958"), ("or {}", "+1 (4l5) 555-I2l2", "phone", "+1 (415) 555-1212"), ("{}", "＋４４ ２０ ７９４６ ０９５８", "phone", "+44 20 7946 0958"),
    ("ip {} end", "one nine two dot one six eight dot zero dot one", "ip", "192.168.0.1"), ("on {} and", "192[.]168[.]0[.]1", "ip", "192.168.0.1"), ("on {}", "10 dot 0 dot 0 dot 7", "ip", "10.0.0.7"), ("on {}.", "١٩٢.١٦٨.٠.١", "ip", "192.168.0.1"),
    ("card {}", "four one one one, one one one one one one one one one one one one", "card", "4111111111111111"), ("card {}", "４１１１ １１１１ １１１１ １１１１", "card", "4111 1111 1111 1111"), ("card: {};", "4O12 8888 8888 1881", "card", "4012 8888 8888 1881"),
    ("card {}", "four triple one double one triple one triple one triple one one", "card", "4111111111111111"),
]


def test_disguised_identifiers_with_their_places():
    for around, hidden, kind, form in DISGUISED:
        before = "Ünï — " + around.split("{}")[0]
        text = before + hidden + around.split("{}")[1] + " 漢字 one day at noon."
        found = [(s, e, pii.KINDS[k], f) for s, k, e, plain, f in pii.find(text) if not plain]
        assert (len(before), len(before) + len(hidden), kind, form) in found, (text, found)
        assert len(found) == 1 or kind == "email" and "@" in hidden


def test_clean_texts_are_left_alone():
    for text in ("We meet at noon. Dot the i at the end.", "One or two of the three, at most four.", "look at one dot two", "Version 1. 2. 3. 4 of the list", "nine one one", "Ещё один текст о погоде, на 5 страницах.", "point one, point two", "at 10 dot", "[at] [dot]", "x @ y"):
        assert pii.find(text) == []


def test_odd_texts_take_linear_time():
    for odd in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, " at " * 50_000, "x-dot-" * 40_000 + "!", "four " * 40_000, "a-dot-a" * 30_000 + " , @x", "@a-dot-" * 30_000, "(((" * 60_000, "a at b dot " * 20_000, "​" * 200_000):
        began = time.time()
        pii.find(odd)
        assert time.time() - began < 5, odd[:12]


def test_pii_table(rows, docs, empty):
    got = pii.pii(docs).collect()
    assert len(got) == len(rows) and pii.pii(empty).count() == 0
    want = Counter()
    for i, t, *_ in rows:
        base = brute_pii(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want[(i, *(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_pii_spans(spark):
    text = "a@b.com, joe (at) ex (dot) org and +1 415 555 1212 and 10.0.0.1"
    r = pii.pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    joe, phone, ip = text.index("joe"), text.index("+1"), text.index("10.0")
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_disguised) == (1, 1, 0, 1, 1)
    assert r.spans == f"email:0:7,email:{joe}:{joe + 21},phone:{phone}:{phone + 15},ip:{ip}:{ip + 8}"
    assert r.base_sha256 == hashlib.sha256(f"email:0:7,phone:{phone}:{phone + 15},ip:{ip}:{ip + 8}".encode()).hexdigest()


# -- lexical search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(rows, items):
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows if terms(t)]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for k, (item, text) in enumerate(items):
        scored = []
        for i, c in docs:
            m = 100 - 25 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:20], 1)]
    return sorted(out, key=repr)


def items_of(rows):
    random.seed(5)
    texts = [None, "", "...", "absent words only", "the", "Zebra zebra ÉCOLE", "漢字 7f 0x7f", "A" * 300 + " w"] + [" ".join(random.choices(terms(t), k=12)) for _, t, *_ in rows[10:60:5] if terms(t)]
    return [(random.choice([k, k, 3, None]), t) for k, t in enumerate(texts)]


def test_search(spark, rows, docs, empty):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, bench).collect()), key=repr)
    assert got == brute_search(rows, items) and len(got) > 100
    assert lexical_search.search(empty, bench).count() == 0 and lexical_search.search(docs, bench.where("item_id > 9999")).count() == 0


def test_search_by_other_ways(spark, rows, docs, monkeypatch):
    """Items in small blocks, candidates that meet their documents in a shuffle."""
    for name, value in (("ITEMS", 4), ("ITEM_TERMS", 20), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(lexical_search, name, value)
    items = items_of(rows)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute_search(rows, items)


@pytest.mark.parametrize("small", [{}, {"BLOCK_DOCS": 3, "BITS": 1, "HASHES": 2, "CHUNK": 5, "HELD_TERMS": 10}])
def test_bounds_hold(rows, monkeypatch, small):
    """Every bound is the exact score or more, however few bits there are; with enough, documents far below are told apart."""
    for name, value in small.items():
        monkeypatch.setattr(lexical_search, name, value)
    own = [(i, t) for i, t, *_ in rows if terms(t)]
    counted = [Counter(terms(t)) for _, t in own]
    df = Counter(w for c in counted for w in c)
    asked = [dict(Counter(terms(t))) for _, t in items_of(rows) if terms(t)]
    items = lexical_search.Items(list(range(len(asked))), asked, len(own), sum(c.total() for c in counted))
    items.weights = {w: lexical_search.weight(df[w], len(own)) for w in items.terms()}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(own))), "text": [t for _, t in own]})
    pruned = 0
    for made in lexical_search._indexed(iter([batch])):
        for row in made.to_pylist():
            if not row["rows"]:
                continue
            bound = items.bounds(*items.matrix(), row["rows"], row["n"], row["bits"])
            for j, doc in enumerate(row["doc_id"]):
                norm = lexical_search.length_norm(row["n"][j], items.docs, items.total)
                exact = np.array([items.score(k, counted[doc], norm) for k in range(len(asked))])
                assert (bound[:, j] >= exact).all()
                pruned += int((bound[:, j] == 0).sum())
    assert small or pruned > 20


def test_queries_are_registered():
    assert {"op11_filter_audit", "op12_pii", "op13_lexical_search"} <= set(queries.QUERIES)
