"""State machines of jobs: which events move a job on, when it stops, and what its row says in the end.

A machine is an ordered list of states. An event moves a job to a later state only; a terminal state is never left. So the state of
a job is the first terminal one, or else the latest reached, and folds over any split of the events agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The states of query jobs and of ingest jobs in order, and those that end a job.
QUERY_STATES = ["QUEUED", "RUNNING", "MAP_PHASE", "REDUCE_PHASE", "SYNTHESIS"]
QUERY_ENDS = ["COMPLETED", "FAILED", "CANCELLED", "BUDGET_EXCEEDED"]
INGEST_STATES = ["QUEUED", "PARSING", "CHUNKING", "FEATURE_EXTRACTION", "INDEXING"]
INGEST_ENDS = ["COMPLETED", "FAILED"]


def place(state: Column, states: list[str], ends: list[str]) -> Column:
    """The place of a state in its machine; all terminal ones share the last."""
    out = F.when(state.isin(ends), len(states))
    for i, s in enumerate(states):
        out = out.when(state == s, i)
    return out


def transitions(events: DataFrame, job: str, state: str, *order: str, states: list[str] = QUERY_STATES, ends: list[str] = QUERY_ENDS) -> DataFrame:
    """The events that move a job, with ``step`` from 1; unknown states and steps back or beyond the end are left out."""
    w = W.partitionBy(job).orderBy(*order)
    before = F.max("_at").over(w.rowsBetween(W.unboundedPreceding, -1))
    e = events.withColumn("_at", place(F.col(state), states, ends)).filter("_at is not null").withColumn("_before", before)
    moved = e.filter(F.col("_before").isNull() | (F.col("_at") > F.col("_before"))).drop("_before")
    return moved.withColumn("step", F.row_number().over(w)).drop("_at")


def last_row(moved: DataFrame, job: str, state: str, at: str, start: str, ends: list[str]) -> DataFrame:
    """(job, state, n_steps, started_at, completed_at): the first ``start`` state starts a job, a terminal one completes it."""
    return moved.groupBy(job).agg(
        F.max_by(state, "step").alias("state"),
        F.count("*").alias("n_steps"),
        F.min(F.when(F.col(state) == start, F.col(at))).alias("started_at"),
        F.min(F.when(F.col(state).isin(ends), F.col(at))).alias("completed_at"),
    )


def stop_conditions(events: DataFrame, cancelled: DataFrame, job: str, at: str, ident: str, cost: Column, tokens: Column, most_cost: float, most_tokens: float) -> DataFrame:
    """(job, ident, reason) of the first event at which a job must stop: a cancellation (job, cancelled_at) is in force, or the running
    cost or the running tokens are beyond their limit."""
    w = W.partitionBy(job).orderBy(at, ident).rowsBetween(W.unboundedPreceding, 0)
    e = events.withColumn("_cost", F.sum(cost).over(w)).withColumn("_tokens", F.sum(tokens).over(w)).join(cancelled, job, "left")
    off = F.when(F.col("cancelled_at") <= F.col(at), "CANCELLED").when((F.col("_cost") > most_cost) | (F.col("_tokens") > most_tokens), "BUDGET_EXCEEDED")
    stop = e.withColumn("reason", off).filter("reason is not null")
    return stop.groupBy(job).agg(F.min_by(F.struct(F.col(ident).alias("i"), "reason"), F.struct(at, ident)).alias("s")).select(job, F.col("s.i").alias(ident), "s.reason")


def until_end(events: DataFrame, job: str, state: str, ends: list[str], *order: str) -> DataFrame:
    """The events of a job up to its first terminal one, that one included."""
    w = W.partitionBy(job).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    over = F.max(F.when(F.col(state).isin(ends), 1).otherwise(0)).over(w)
    return events.withColumn("_over", over).filter("coalesce(_over, 0) = 0").drop("_over")
