"""No rule's match is lost to the keyword gate."""

import random
import re
import time
from re import _parser

import pytest

from tallyframe.llm import license_rules, license_scan


def samples(tree):
    """Texts that the pattern matches: every alternative, option and listed character at least once."""
    options = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            options.append([chr(arg)])
        elif name == "IN":
            options.append(["q"] if str(arg[0][0]) == "CATEGORY" else [chr(c) for kind, v in arg for c in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v])])
        elif name == "ANY":
            options.append(["q"])
        elif name == "BRANCH":
            options.append([s for branch in arg[1] for s in samples(branch)])
        elif name == "SUBPATTERN":
            options.append(samples(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            options.append([*([""] if arg[0] == 0 else []), *samples(arg[2])])
        else:
            assert name == "ASSERT_NOT", name
    base = [o[0] for o in options]
    return ["".join(base)] + ["".join([*base[:k], s, *base[k + 1 :]]) for k, o in enumerate(options) for s in o[1:]]


def matched():
    for priority, label, keyword, regex in license_rules.rules():
        for text in dict.fromkeys(samples(_parser.parse(regex))):
            if re.fullmatch(regex, text):
                yield priority, label, keyword, regex, text


def test_every_match_holds_its_keyword():
    found = list(matched())
    assert {f[3] for f in found} == {r[3] for r in license_rules.rules()} and len(found) > 500
    for _, _, keyword, regex, text in found:
        words = text.split()
        assert any(w.startswith(k[:-1]) if k[-1] == "*" else w == k for k in keyword.split("/") for w in words), (keyword, regex, text)


def test_every_alternative_is_found(spark):
    found = list(matched())
    rows = license_scan.license_scan(spark.createDataFrame([(i, f[4]) for i, f in enumerate(found)], "doc_id long, text string")).collect()
    assert len(rows) == len(found)
    # A match can only be suppressed by one of the same or a higher priority.
    assert [found[r.doc_id] for r in rows if r.n_found < 1 or r.score < license_scan.SCORES[found[r.doc_id][0] - 1]] == []


@pytest.mark.parametrize("text, labels, score", [("released under the MIT", "mit", 0.9), ("Distributed under the GPL v3", "gpl", 0.9), ("published under LGPL", "lgpl", 0.9), ("GNU GPL3", "gpl", 0.75), ("licensed and released under the MIT", "mit", 0.9)])
def test_verbs(spark, text, labels, score):
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score, row.n_found) == (labels, score, 1)


def brute(text):
    """labels, n_found and score by the definition: every rule is run, every pair of matches compared."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    norm = " ".join(re.findall(license_scan.WORD.lower(), low(text)))
    hits = []
    for number, (priority, label, _, regex) in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<![^ ])(?:{regex})(?![^ ])", norm):
            start = norm.count(" ", 0, m.start())
            hits.append((start, -(start + m[0].count(" ")), priority, number, label))
    hits.sort()
    left = [h for k, h in enumerate(hits) if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:k])]
    base = {label for phrase, label in license_rules.BASE if f" {phrase} " in f" {norm} "}
    return ",".join(sorted({h[4] for h in left} | base)), len(left), max((license_scan.SCORES[h[2] - 1] for h in left), default=0.0)


def test_against_every_rule_on_every_pair(spark):
    random.seed(12)
    found = [f[4] for f in matched()]
    texts = [" ".join(random.choice([random.choice(found), "some other words", "license"]) for _ in range(random.randint(1, 8))).title() for _ in range(300)]
    for row in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (row.labels, row.n_found, row.score) == brute(texts[row.doc_id]), texts[row.doc_id]


def test_hundreds_of_hand_written_rules():
    rules = license_rules.rules()
    assert sum(p > 1 for p, _, _, _ in rules) > 200 and len({r[3] for r in rules if r[0] > 1}) > 200


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        table = spark.createDataFrame([(1, "mit license here " * n)], "doc_id long, text string")
        begun = time.time()
        row = license_scan.license_scan(table).first()
        assert (row.n_base, row.last_word) == (n, 3 * (n - 1))
        return time.time() - begun

    seconds(100)
    few, many = seconds(4_000), seconds(64_000)
    assert many < 16 * max(few, 1.0)
