"""Orphan references against brute force: case and blanks, time, deletion, nulls, repeats, hot keys, empty tables."""

import random
from datetime import datetime, timedelta

from quarrystone.operators import references as R

REF = "rid string, fk string, at timestamp, extra string, key string"
TGT = "id string, recorded_at timestamp, deleted_at timestamp, key string"
T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, refs, tgts, **kw):
    r = R.references(spark.createDataFrame(refs, REF), "t", "fk", "rid", "at", "x")
    v = R.targets(spark.createDataFrame(tgts, TGT), "x", "id")
    return r, R.orphans(r, v, **kw)


def brute(refs, tgts):
    n = lambda s: None if s is None else s.strip().lower()
    out = set()
    for rid, fk, at, *_ in refs:
        if n(fk) in (None, "", "unknown"):
            continue
        if not any(n(i) == n(fk) and a is not None and at is not None and a <= at and (d is None or d > at) for i, a, d, _ in tgts):
            out.add(rid)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    ids = ["A", "b ", " c", "D", "hot"]
    tgts = [(rng.choice([*ids, None]), day(rng.choice([None, *range(9)])), day(rng.choice([None, None, *range(12)])), "x") for _ in range(25)]
    refs = [(f"r{i}", rng.choice(["a", "B", "C ", "d", "HOT", "nil", "", None, " Unknown "]), day(rng.choice([None, *range(12)])), "e", "k") for i in range(200)]
    refs += [(f"h{i}", "hot", day(i % 12), "e", "k") for i in range(100)] + refs[:20]
    tgts += tgts[:5]
    for kw in ({}, {"hot_share": 0.0, "salts": 3}):
        r, o = run(spark, refs, tgts, **kw)
        got = [x.record_id for x in o.collect()]
        assert sorted(got) == sorted(brute(refs, tgts))
    rep = R.orphan_report(r, o).collect()
    assert sum(x.n_orphans for x in rep) == len(got)
    assert any(x.month is None for x in rep)


def test_empty(spark):
    r, o = run(spark, [], [])
    assert o.count() == 0 and R.orphan_report(r, o).count() == 0
    r, o = run(spark, [("r", "a", day(1), None, None)], [])
    assert [x.record_id for x in o.collect()] == ["r"]
