"""Leaks against brute force on planted passages; alignment against full dynamic programming."""

import random

import numpy as np

from quarrystone.llm.leaks import align, codes_of, leaks

rng = random.Random(9)
VOCAB = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def grams(t):
    w = t.lower().replace(",", " ").replace("\n", " ").split()
    return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}


def test_leaks(spark):
    items = [(i, text(40)) for i in range(20)] + [(99, "too short"), (98, None), (None, text(30)), (97, "")]
    docs = []
    for d in range(60):
        t, i = text(80), d % 20
        w = items[i][1].split()
        if d % 3 == 0:
            t += "\n" + ", ".join(w[5:17]).upper() + " " + text(10)  # 12 words, other marks and case
        elif d % 3 == 1:
            t += " " + " ".join(w[5:16]) + " " + text(10)  # 11 words only
        docs.append((d, t, "x"))
    altered = list(items[3][1])
    for k in (30, 90, 150):
        altered[k] = "#"[:0] + "q"
    docs += [(100, text(20) + " " + "".join(altered), "x"), (101, None, "x"), (102, "", "x"), (103, "a" * 50_000, "x"), (None, items[0][1], "x")] + docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = leaks(df, it).collect()
    want = {(d, i) for d, t, _ in docs if t and d is not None for i, u in items if u and i is not None and grams(t) & grams(u)}
    assert {(r.doc_id, r.item_id) for r in got if r.equal_run} == want
    assert (100, 3) in {(r.doc_id, r.item_id) for r in got} and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def full(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), h[i - 1, j] - 2, h[i, j - 1] - 2)
    return h.max()


def test_alignment_in_a_wide_band_is_the_full_one():
    for _ in range(30):
        b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        a = b[: rng.randint(0, 25)] + rng.choice(["", "x", "ab"]) + b[rng.randint(0, 20) :]
        (length, edits), = align([(codes_of(a), codes_of(b), 0)], 40)
        assert 2 * edits <= length - full(a, b) <= 3 * edits
