"""Two caps in order against the loop that they stand for."""

import math
import random

from pyspark.sql import functions as F

from tallyframe.operators import assembly, balanced


def loop(rows, n, labels, slack, share, oversample):
    cap, easy_cap = math.ceil(n / labels * slack - 1e-9), math.ceil(n * share - 1e-9) if n >= 20 else n
    counts, easy_kept, seen, out, over = {}, 0, set(), [], []
    for at, key, label, easy, fact in rows[: n * oversample if oversample else None]:
        if len(out) >= n:
            break
        if fact in seen:
            continue
        seen.add(fact)
        if counts.get(label, 0) < cap and not (easy and easy_kept >= easy_cap):
            counts[label] = counts.get(label, 0) + 1
            easy_kept += bool(easy)
            out.append(key)
        else:
            over.append(key)
    return [(k, "kept") for k in out] + [(k, "filled") for k in over[: n - len(out)]]


def test_same_rows_as_the_loop(spark, monkeypatch):
    monkeypatch.setattr(assembly, "BUCKETS", 16)
    random.seed(11)
    rows, wanted, told = [], [], {}
    for s, (n, size, easy, labels) in enumerate([(40, 300, 0.9, "ab"), (60, 200, 0.5, "abcde"), (12, 100, 0.8, "abc"), (50, 60, 0.7, "aab"), (30, 30, 1.0, "a"), (25, 400, 0.02, "aaaab"), (20, 0, 0, "a"), (33, 500, 0.6, "abcd")]):
        split = None if s == 1 else f"s{s}"
        own = sorted((random.randrange(150), s * 1000 + k, random.choice([*labels, None]) if s != 4 else "a", random.choice([True, None]) if random.random() < easy else False, random.randrange(size * 3)) for k in range(size))
        wanted.append((split, n))
        told[split] = own
        rows += [(split, *r) for r in own]
    rows += [("other", 1, 99_000 + k, "a", False, k) for k in range(20)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "split string, at long, key long, label string, easy boolean, fact long").repartition(7)
    for slack, share, oversample in ((1.6, 0.4, None), (1.0, 0.1, 3), (3.0, 0.9, 1)):
        got = balanced.balanced_sample(frame, "split", "label", F.col("easy"), F.col("fact"), F.col("at"), "key", spark.createDataFrame(wanted, "split string, n long"), 3, slack, share, oversample).collect()
        for split, n in wanted:
            assert sorted((r.key, r.why) for r in got if r.split == split) == sorted(loop(told[split], n, 3, slack, share, oversample)), (split, slack)
        assert {r.split for r in got} <= {s for s, _ in wanted}
