"""Structured Streaming over job events: counts, idempotent enqueueing, state machines, token filter, dead letters.

Offsets and commits of the checkpoint take the place of a consumer group; a batch that is replayed writes the same
files again, keyed by batch, so results are exactly once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..functions.scalars import MARKER
from ..operators.states import QUERY_ENDS, QUERY_STATES

def event_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def enqueue_once(events: DataFrame, key: str, at: str, delay: str | None = "10 minutes") -> DataFrame:
    """Each key once within the lateness bound: repeated deliveries are dropped, and the state is too. Rows later than the
    bound are lost; without one (None) nothing is, in whatever order files are read, and the state holds every key."""
    if delay is None:
        return events.dropDuplicates([key])
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def job_states(events: DataFrame, key: str = "user_id", kind: str = "event_type", order: str = "event_id") -> DataFrame:
    """(job_id, state, n_events, n_errors) after each batch; the state of a job is that of its latest event."""

    def fold(ident, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, name, n, errors = state.get if state.exists else (-1, "", 0, 0)
        for p in parts:
            n += len(p)
            errors += int((p[kind] == "error").sum())
            top = p.loc[p[order].idxmax()]
            if int(top[order]) > last:
                last, name = int(top[order]), str(top[kind])
        state.update((last, name, n, errors))
        yield pd.DataFrame({"job_id": [ident[0]], "state": [name], "n_events": [n], "n_errors": [errors]})

    return (
        events.select(key, kind, order)
        .groupBy(key)
        .applyInPandasWithState(fold, "job_id long, state string, n_events long, n_errors long", "last long, name string, n long, errors long", "update", GroupStateTimeout.NoTimeout)
    )


def job_machine(events: DataFrame, key: str = "job_id", state: str = "state", order: str = "event_id", states: list[str] = QUERY_STATES, ends: list[str] = QUERY_ENDS) -> DataFrame:
    """(job_id, state, n_steps) after each batch: an event moves a job to a later state only, and a terminal one is never left.
    The state that is kept is the job's place, its name and its number of steps."""
    at = {s: i for i, s in enumerate(states)} | {s: len(states) for s in ends}

    def fold(ident, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, name, steps = held.get if held.exists else (-1, "", 0)
        for s in pd.concat(list(parts)).sort_values(order)[state]:
            if at.get(s, -1) > now:
                now, name, steps = at[s], s, steps + 1
        held.update((now, name, steps))
        yield pd.DataFrame({"job_id": [ident[0]], "state": [name], "n_steps": [steps]})

    return (
        events.select(key, state, order)
        .groupBy(key)
        .applyInPandasWithState(fold, "job_id long, state string, n_steps long", "now long, name string, steps long", "update", GroupStateTimeout.NoTimeout)
    )


#: Characters of a marker from its first one, and a marker or the beginning of one at the end of a text.
MARKER_CHARS = 41
WHOLE = re.compile(MARKER)
OPEN_END = re.compile("(?:" + "|".join(re.escape("pqac-"[:n]) for n in range(5, 0, -1)) + r")[0-9a-f-]*$")


def filtered(text: str, known: set[str]) -> str:
    return WHOLE.sub(lambda m: m.group() if m.group() in known else "", text)


def held_back(text: str) -> int:
    """Where the part of a text begins that may be a marker still to be completed; its length if there is none."""
    m = OPEN_END.search(text, max(0, len(text) - MARKER_CHARS + 1))
    return m.start() if m else len(text)


def token_filter(tokens: DataFrame) -> DataFrame:
    """(job_id, seq, piece) of a stream of tokens (job_id, seq, token, known, last): markers of unknown citations are taken out, however they
    are torn over tokens and batches. What may be the beginning of a marker waits in the state; the last token releases it.
    ``known`` are the job's citations. Batches bring a job's tokens in order of seq."""

    def fold(ident, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait, out = state.get[0] if state.exists else "", []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            text = filtered(wait + r.token, set(r.known))
            cut = len(text) if r.last else held_back(text)
            if cut:
                out.append((ident[0], r.seq, text[:cut]))
            wait = text[cut:]
        state.update((wait,))
        yield pd.DataFrame(out, columns=["job_id", "seq", "piece"])

    return tokens.groupBy("job_id").applyInPandasWithState(fold, "job_id string, seq long, piece string", "wait string", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs over all that is there and returns the written table; with ``key`` the latest row of each key.

    Every batch goes to a folder of its own number, overwritten if the batch is replayed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:09d}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = stream.sparkSession.read.schema(stream.schema.add("_batch", IntegerType())).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    if key:
        out = out.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "_batch").alias("_r")).select(key, "_r.*")
    return out.drop("_batch")


def split_dead(batch: DataFrame, attempts: str = "attempt", most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(to retry, dead letters) of a batch, each dead one with its reason."""
    dead = F.coalesce(F.col(attempts), F.lit(0)) >= most
    return batch.filter(~dead), batch.filter(dead).withColumn("reason", F.lit("max_retries"))
