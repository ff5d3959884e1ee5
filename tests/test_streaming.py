"""Streams over small folders: exactly once, folds over several batches, dead letters."""

import time
from datetime import datetime


from quarrystone.plans.models import stream_enqueue_once
from quarrystone.streaming import jobs


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 24), i % 3, "error" if i % 5 == 0 else "view") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:10], "event_id long, ts timestamp, user_id long, event_type string")
    df.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    s = jobs.event_stream(spark, str(tmp_path), "events")
    got = {r.job_id: (r.state, r.n_events, r.n_errors) for r in jobs.run_to_table(jobs.job_states(s), f"{tmp_path}/a", "update", "job_id").collect()}
    both = rows + rows[:10]
    for u in range(3):
        mine = [r for r in both if r[2] == u]
        assert got[u] == (max(mine)[3], len(mine), sum(r[3] == "error" for r in mine))
    once = jobs.run_to_table(jobs.enqueue_once(s, "event_id", "ts", "30 days").select("event_id"), f"{tmp_path}/b")
    assert sorted(r.event_id for r in once.collect()) == list(range(40))


def test_split_dead(spark):
    retry, dead = jobs.split_dead(spark.createDataFrame([(1, 2), (2, 3), (3, None)], "j long, attempt int"))
    assert sorted(r.j for r in retry.collect()) == [1, 3] and [(r.j, r.reason) for r in dead.collect()] == [(2, "max_retries")]


def test_enqueue_once_keeps_rows_of_files_read_out_of_order(spark, tmp_path):
    for n, month in enumerate((3, 1, 2)):  # read in the order in which they were written
        rows = [(10 * n + i, datetime(2024, month, 1 + i), "view") for i in range(5)]
        spark.createDataFrame(rows + rows[:2], "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)
    got = [r.event_id for r in stream_enqueue_once(spark, str(tmp_path)).collect()]
    assert sorted(got) == [10 * n + i for n in range(3) for i in range(5)]
