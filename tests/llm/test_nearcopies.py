"""Near copies against brute force; buckets dealt into blocks lose nothing; components against union-find."""

import random

import numpy as np
import pyarrow as pa

from quarrystone.llm.nearcopies import _buckets, _sketch, candidates, components, group_rows, label_occurrences, pair_rows, plan, similar_classes
from quarrystone.llm.q_nearcopies import QUERIES

rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def edit(words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return w


def shingles(t):
    w = t.lower().replace(",", " ").split()
    return None if len(w) < 30 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def corpus():
    rows = []
    for g in range(25):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(40, 90))]
        for v in range(5):
            rows.append((f"g{g}v{v}", " ".join(edit(base, v)), "x"))
        rows.append((f"g{g}moved", " ".join(base[25:] + base[:25]), "x"))
        rows.append((f"g{g}same", ", ".join(base).upper(), "x"))
    hot = [rng.choice(VOCAB) for _ in range(200)]
    rows += [(f"hot{i}", " ".join(edit(hot, 1)), "x") for i in range(30)] + [(f"copy{i}", " ".join(hot), "x") for i in range(20)]
    rows += [("short", "a b c", "x"), ("nul", None, "x"), ("emp", "", "x"), (None, " ".join(hot), "x"), ("rep", " ".join(["same"] * 50), "x"), ("rep2", " ".join(["same"] * 60), "x")]
    return rows + rows[:30]


def test_pairs_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "chunk_id string, raw_content string, rep string")
    s = {k: shingles(t) for k, t, _ in rows if k and t}
    s = {k: v for k, v in s.items() if v}
    keys = sorted(s)
    true = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    member, found = similar_classes(df)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in pair_rows(member, found).collect()}
    assert got <= true and len(got) >= 0.99 * len(true)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in keys}
    groups = {r.chunk_id: r.group_id for r in group_rows(member, found).collect()}
    assert groups == {k: g for k, g in want.items() if list(want.values()).count(g) > 1}
    small = {tuple(r) for r in candidates(df, "chunk_id", "raw_content", 30, len(rows), block=4).collect()}
    assert small == {tuple(r) for r in candidates(df, "chunk_id", "raw_content", 30, len(rows)).collect()}


def test_buckets_stream(spark):
    keys = np.repeat(np.arange(40, dtype="i8"), [1, 2, 3, 30] * 10)
    reps = np.arange(len(keys), dtype="i8")
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps), pa.array(np.zeros(len(keys), "i8"))], names=["key", "rep", "sig"])
    for step in (1, 7, 1000):
        out = pa.Table.from_batches(_buckets(5, 0)(whole.slice(i, step) for i in range(0, len(keys), step))).to_pydict()
        pairs = {(a, b) for f, a, b in zip(out["large"], out["a"], out["b"]) if not f}
        large = [(k, a) for f, a, k in zip(out["large"], out["a"], out["key"]) if f]
        assert pairs == {(i, j) for i in reps for j in reps if i < j and keys[i] == keys[j] and (keys == keys[i]).sum() <= 5}
        assert sorted(large) == [(k, r) for k, r in zip(keys, reps) if (keys == k).sum() > 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (50, 51)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {7: 3, 3: 3, 9: 3, 50: 50, 51: 50}


def test_small_rules(spark):
    h = np.array([5, 5, 6, 5], "u8")
    assert len(set(label_occurrences(h, np.array([0, 0, 0, 0])).tolist())) == 4
    assert plan(10)[0] == 3 and plan(10**9)[0] > 3
    df = spark.createDataFrame([], "chunk_id string, raw_content string")
    m, f = similar_classes(df)
    assert pair_rows(m, f).count() == 0 and group_rows(m, f).count() == 0


def test_no_candidate_is_lost_after_the_keys(spark):
    """Every true pair that shares a key is found."""
    local, rows = random.Random(11), []
    for g in range(2000):
        base = [local.choice(VOCAB) for _ in range(60)]
        other = list(base)  # in-place edits that leave little more than the threshold
        for i in local.sample(range(60), 5):
            other[i] = local.choice(VOCAB)
        rows += [(f"a{g}", " ".join(base)), (f"b{g}", " ".join(other))]
    df = spark.createDataFrame(rows, "chunk_id string, raw_content string")
    s = {k: shingles(t) for k, t in rows}
    true = {(f"a{g}", f"b{g}") for g in range(2000) if len(s[f"a{g}"] & s[f"b{g}"]) >= 0.6 * len(s[f"a{g}"] | s[f"b{g}"])}
    picks, tables = plan(len(rows))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["chunk_id", "text"])
    t = pa.Table.from_batches(_sketch(30, picks, tables)(iter([batch]))).to_pydict()
    keys, order = {}, list(dict.fromkeys(t["rep"]))
    for k, r in zip(t["key"], t["rep"]):
        keys.setdefault(r, set()).add(k)
    of = {rows[i][0]: keys[r] for i, r in enumerate(order)}
    meet = {p for p in true if of[p[0]] & of[p[1]]}
    got = {(r.chunk_id_a, r.chunk_id_b) for r in pair_rows(*similar_classes(df)).collect()}
    assert len(order) == len(rows) and len(meet) > 500 and got == meet


def test_aligned_share(spark):
    base = [rng.choice(VOCAB) for _ in range(80)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:40] + ["zzz"] + base[41:])), ("c", " ".join(base[40:] + base[:40])), ("d", ", ".join(base))]
    df = spark.createDataFrame(rows, "chunk_id string, raw_content string")
    got = {(r.chunk_id_a, r.chunk_id_b): r.aligned for r in pair_rows(*similar_classes(df, aligned=True)).collect()}
    assert got["a", "b"] == 79 / 80 and got["a", "d"] == 1 and got["a", "c"] < 0.1  # moved out of the band
    assert "p4_pairs" in QUERIES
