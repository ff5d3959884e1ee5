"""State machines, stop conditions, torn markers: against plain Python; and that batches do not matter."""

import random

from pyspark.sql import functions as F

from quarrystone.operators import states
from quarrystone.streaming import jobs

ORDER = {s: i for i, s in enumerate(states.QUERY_STATES)} | {s: len(states.QUERY_STATES) for s in states.QUERY_ENDS}


def walk(names):
    now, steps = -1, []
    for s in names:
        if ORDER.get(s, -1) > now:
            now = ORDER[s]
            steps.append(s)
    return steps


def machine_events():
    rng = random.Random(3)
    names = [*ORDER, "NO_SUCH_STATE", None]
    return [(j, e, rng.choice(names)) for e, j in enumerate(rng.choices(range(12), k=150))]


def test_transitions_and_rows(spark):
    rows = machine_events()
    df = spark.createDataFrame(rows, "job_id long, event_id long, state string")
    moved = states.transitions(df, "job_id", "state", "event_id")
    got = {}
    for r in moved.collect():
        got.setdefault(r.job_id, {})[r.step] = r.state
    want = {j: walk([s for k, _, s in rows if k == j]) for j in {r[0] for r in rows}}
    assert {j: [v[i] for i in sorted(v)] for j, v in got.items()} == {j: w for j, w in want.items() if w}
    last = {r.job_id: r for r in states.last_row(moved, "job_id", "state", "event_id", "RUNNING", states.QUERY_ENDS).collect()}
    assert {j: (r.state, r.n_steps, r.completed_at is not None) for j, r in last.items()} == {j: (w[-1], len(w), w[-1] in states.QUERY_ENDS) for j, w in want.items() if w}
    assert states.transitions(df.limit(0), "job_id", "state", "event_id").count() == 0


def test_stream_machine_over_batches(spark, tmp_path):
    rows = machine_events()
    for lo in range(0, 150, 50):
        spark.createDataFrame(rows[lo : lo + 50], "job_id long, event_id long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    s = jobs.event_stream(spark, str(tmp_path), "events", 3)  # all files in one batch, then one file a batch
    for n, stream in enumerate((s, jobs.event_stream(spark, str(tmp_path), "events"))):
        got = {r.job_id: (r.state, r.n_steps) for r in jobs.run_to_table(jobs.job_machine(stream), f"{tmp_path}/out{n}", "update", "job_id").collect()}
        want = {j: walk([x for k, _, x in rows if k == j]) for j in {r[0] for r in rows}}
        assert got == {j: (w[-1] if w else "", len(w)) for j, w in want.items()}


def test_stop_conditions(spark):
    e = spark.createDataFrame([(1, 1, 1, 30), (1, 2, 2, 30), (1, 3, 3, 90), (2, 4, 1, 10), (2, 5, 2, 10), (3, 6, 1, None), (4, 7, 1, 60), (4, 8, 2, 1)], "job long, id long, at int, cost int")
    c = spark.createDataFrame([(2, 2), (4, 9)], "job long, cancelled_at int")
    got = {r.job: (r.id, r.reason) for r in states.stop_conditions(e, c, "job", "at", "id", F.coalesce("cost", F.lit(0)), F.lit(1), 60, 100).collect()}
    assert got == {1: (3, "BUDGET_EXCEEDED"), 2: (5, "CANCELLED"), 4: (8, "BUDGET_EXCEEDED")}  # the limit itself is within


def test_until_end(spark):
    e = spark.createDataFrame([(1, 1, "RUNNING"), (1, 2, "FAILED"), (1, 3, "RUNNING"), (1, 4, "COMPLETED"), (2, 5, None), (2, 6, "RUNNING")], "job long, id long, state string")
    assert sorted(r.id for r in states.until_end(e, "job", "state", states.QUERY_ENDS, "id").collect()) == [1, 2, 5, 6]


KNOWN = "pqac-01234567-89ab-cdef-0123-456789abcdef"
WRONG = "pqac-ffffffff-89ab-cdef-0123-456789abcdef"


def test_what_is_held_back():
    for text in ("abc", "pqac-zz", "p q", "", KNOWN + " x", "pqac-0123 and so on"):
        assert jobs.held_back(text) == len(text)
    for n in range(1, len(KNOWN)):
        assert jobs.held_back("text " + KNOWN[:n]) == 5
    assert jobs.filtered(f"a {KNOWN} b {WRONG} c", {KNOWN}) == f"a {KNOWN} b  c"


def test_torn_markers_over_batches(spark, tmp_path):
    rng, texts = random.Random(8), {}
    rows = []
    for j in range(12):
        texts[f"j{j}"] = text = f"see {KNOWN}{WRONG}, then pqac-0{WRONG[:20]} {WRONG} end pq" + WRONG[: j * 3]
        at = sorted({0, len(text), *(rng.randrange(1, len(text)) for _ in range(25))})
        rows += [(f"j{j}", i, text[a:b], [KNOWN], b == len(text)) for i, (a, b) in enumerate(zip(at, at[1:]))]
    for lo, hi in ((0, 6), (6, 13), (13, 99)):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, "job_id string, seq long, token string, known array<string>, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/tokens.parquet")
    out = jobs.run_to_table(jobs.token_filter(jobs.event_stream(spark, str(tmp_path), "tokens")), f"{tmp_path}/run").collect()
    got = {}
    for r in sorted(out, key=lambda r: r.seq):
        got[r.job_id] = got.get(r.job_id, "") + r.piece
    assert got == {j: jobs.filtered(t, {KNOWN}) for j, t in texts.items()}
