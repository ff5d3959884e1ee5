"""Queries of jobs: state machines, stop conditions, streams, relays, telemetry; with their SQL.

Events of a user are those of a job: a signup queues it, a view runs it, a click is its map phase, a purchase completes it, an
error fails it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import states
from ..session import checkpoint_dir
from ..sources.tables import table
from ..streaming import jobs

STATE_OF = {"signup": "QUEUED", "view": "RUNNING", "click": "MAP_PHASE", "purchase": "COMPLETED", "error": "FAILED"}


def job_events(e: DataFrame) -> DataFrame:
    """(job_id, event_id, ts, state, value) of events."""
    name = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])[F.col("event_type")]
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", name.alias("state"), "value")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return job_events(table(spark, sf, "events"))


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return states.transitions(_events(spark, sf), "job_id", "state", "event_id").select("job_id", "event_id", "state", F.col("step").cast("long").alias("step"))


def job_rows(spark: SparkSession, sf: str) -> DataFrame:
    """State, start, end, errors and retries of every job."""
    e = _events(spark, sf)
    last = states.last_row(states.transitions(e, "job_id", "state", "event_id"), "job_id", "state", "event_id", "RUNNING", states.QUERY_ENDS)
    errors = e.groupBy("job_id").agg(F.count_if(F.col("state") == "FAILED").alias("retry_count"), F.max(F.when(F.col("state") == "FAILED", F.col("event_id"))).alias("last_error"))
    return last.join(errors, "job_id")


def stream_job_machine(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_to_table(jobs.job_machine(job_events(jobs.event_stream(spark, sf, "events"))), _folder(spark, "stream"), "update", "job_id")


def ingest_job_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest jobs as the states they went through: queued at creation, parsing at the start, their status at the end."""
    j = table(spark, sf, "ingestion_jobs").select("job_id", "status", "created_at", "started_at", "completed_at").distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.col(at).alias("at"), state.alias("state")) for i, (at, state) in enumerate((("created_at", F.lit("QUEUED")), ("started_at", F.lit("PARSING")), ("completed_at", F.col("status"))))])
    e = j.select("job_id", F.explode(steps).alias("e")).select("job_id", "e.*").filter("at is not null")
    moved = states.transitions(e, "job_id", "state", "at", "i", states=states.INGEST_STATES, ends=states.INGEST_ENDS)
    r = states.last_row(moved, "job_id", "state", "at", "PARSING", states.INGEST_ENDS)
    return r.select("job_id", "state", "n_steps", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"))


def _cancelled(spark: SparkSession, sf: str) -> DataFrame:
    """Cancellation flags: the events whose id is divisible by 50 cancel their job."""
    return table(spark, sf, "events").filter("event_id % 50 = 0").groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("cancelled_at"))


def job_stops(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0))
    return states.stop_conditions(_events(spark, sf), _cancelled(spark, sf), "job_id", "ts", "event_id", cents, F.lit(1000), 50_000, 60_000)


def job_stop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return job_stops(spark, sf).groupBy("reason").agg(F.count("*").alias("n_jobs"))


def cancellation_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The flag of every job, after it was written and read back."""
    path = _folder(spark, "flags")
    _cancelled(spark, sf).write.mode("overwrite").parquet(path)
    all_jobs = table(spark, sf, "events").select(F.col("user_id").alias("job_id")).distinct()
    return all_jobs.join(spark.read.parquet(path), "job_id", "left").select("job_id", F.col("cancelled_at").isNotNull().alias("cancelled"))


def sse_relay(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a job's events until its first terminal one."""
    e = states.until_end(_events(spark, sf), "job_id", "state", states.QUERY_ENDS, "event_id")
    name = F.when(F.col("state") == "COMPLETED", "completed").when(F.col("state") == "FAILED", "failed").otherwise("status")
    return e.select("event_id", S.sse_frame(name, F.struct("job_id", "state")).alias("frame"))


def stream_no_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A subscription to one in ten jobs: events from before it are not seen."""
    at = table(spark, sf, "events").agg(F.percentile_disc(F.col("event_id"), 0.5) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by event_id)")).first()[0]
    e = job_events(jobs.event_stream(spark, sf, "events")).filter((F.col("event_id") > at) & (F.col("job_id") % 10 == 3))
    return jobs.run_to_table(e.select("event_id", "job_id", "state"), _folder(spark, "stream"))


def stream_ingest_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest messages: those without a document are malformed and dropped, each job is queued once."""
    j = jobs.event_stream(spark, sf, "ingestion_jobs").filter("document_id <> ''")
    return jobs.run_to_table(jobs.enqueue_once(j.select("job_id", "document_id"), "job_id", "", None).select("job_id", F.lit("QUEUED").alias("status")), _folder(spark, "stream"))


def stream_publish(spark: SparkSession, sf: str) -> DataFrame:
    """State events appended to a table of frames, batch by batch."""
    e = job_events(jobs.event_stream(spark, sf, "events"))
    return jobs.run_to_table(e.select("event_id", F.to_json(F.struct("job_id", "state")).alias("message")), _folder(spark, "stream"))


def stream_token_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Cited spans with their marker and an invented one, as tokens of seven characters, so that markers are torn."""
    c = table(spark, sf, "citation_references").groupBy("pqac_id").agg(F.min("text_span").alias("span"), F.min(F.lower(F.trim("chunk_id"))).alias("chunk_id"))
    c = c.join(table(spark, sf, "chunks").select("chunk_id").distinct().withColumn("ok", F.lit(True)), "chunk_id", "left")
    text = F.concat_ws(" ", "span", "chunk_id", F.lit("pqac-00000000-0000-0000-0000-000000000000"), F.lit("end"))
    n = F.ceil(F.length("text") / 7).cast("int")
    t = c.select("pqac_id", text.alias("text"), F.when(F.col("ok"), F.array("chunk_id")).otherwise(F.array().cast("array<string>")).alias("known"))
    t = t.select("pqac_id", "text", "known", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("seq"))
    t = t.select(F.col("pqac_id").alias("job_id"), F.col("seq").cast("long").alias("seq"), F.expr("substring(text, seq * 7 - 6, 7)").alias("token"), "known", (F.col("seq") == F.col("n")).alias("last"))
    path = _folder(spark, "tokens")
    for half in (False, True):  # a job's tokens come in two files, the later ones in a later file
        t.filter((F.col("seq") > 3) == half).repartition("job_id").write.mode("append").parquet(f"{path}/tokens.parquet")
    stream = jobs.event_stream(spark, path, "tokens", 4).select("job_id", "seq", "token", "known", "last")
    out = jobs.run_to_table(jobs.token_filter(stream), f"{path}/run")
    parts = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return out.groupBy(F.col("job_id").alias("pqac_id")).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))


def elapsed_ms(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "ingestion_jobs").select("job_id", "created_at", "started_at", "completed_at").distinct()
    ms = lambda a, b: F.coalesce(F.unix_micros(b) - F.unix_micros(a), F.lit(-1))
    return j.select("job_id", ms("created_at", "started_at").alias("waited_us"), ms("started_at", "completed_at").alias("ran_us"))


def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a trace per job: its root, and a child for each phase that has run."""
    j = table(spark, sf, "ingestion_jobs").select("job_id", "created_at", "started_at", "completed_at").distinct()
    spans = [("job", "", "created_at", "completed_at"), ("wait", "job", "created_at", "started_at"), ("run", "job", "started_at", "completed_at")]
    ident = lambda name: F.substring(F.md5(F.concat("job_id", F.lit("/" + name))), 1, 16)
    rows = [F.struct(F.lit(n).alias("name"), ident(n).alias("span_id"), (ident(p) if p else F.lit("")).alias("parent_id"), (F.unix_micros(b) - F.unix_micros(a)).alias("us")) for n, p, a, b in spans]
    return j.select(F.md5("job_id").alias("trace_id"), F.explode(F.array(*rows)).alias("s")).select("trace_id", "s.*").filter("us is not null")


_FUNCTIONS = [job_transitions, job_rows, stream_job_machine, ingest_job_machine, job_stops, job_stop_counts, cancellation_flags, sse_relay, stream_no_replay, stream_ingest_enqueue, stream_publish, stream_token_filter, elapsed_ms, trace_spans]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items()) + " END"
_EVENTS = f"""e AS (SELECT user_id AS job_id, event_id, ts, {_CASE} AS state, value, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 5 END AS place FROM events)"""
_MOVED = _EVENTS + """, b AS (SELECT *, max(place) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS step FROM b WHERE before IS NULL OR place > before)"""
_STOPS = _EVENTS + """, c AS (SELECT user_id AS job_id, min(ts) AS cancelled_at FROM events WHERE event_id % 50 = 0 GROUP BY 1),
r AS (SELECT e.*, cancelled_at, sum(coalesce(round(value * 100)::BIGINT, 0)) OVER w AS cost, 1000 * count(*) OVER w AS tokens FROM e LEFT JOIN c USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN cancelled_at <= ts THEN 'CANCELLED' WHEN cost > 50000 OR tokens > 60000 THEN 'BUDGET_EXCEEDED' END AS reason FROM r),
f AS (SELECT job_id, event_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM s WHERE reason IS NOT NULL) WHERE n = 1)"""
SQL = {
    "job_transitions": f"WITH {_MOVED} SELECT job_id, event_id, state, step FROM m",
    "job_rows": f"""WITH {_MOVED}, l AS (SELECT job_id, arg_max(state, step) AS state, count(*) AS n_steps, min(event_id) FILTER (state = 'RUNNING') AS started_at, min(event_id) FILTER (place = 5) AS completed_at FROM m GROUP BY job_id),
x AS (SELECT job_id, count(*) FILTER (state = 'FAILED') AS retry_count, max(event_id) FILTER (state = 'FAILED') AS last_error FROM e GROUP BY job_id) SELECT * FROM l JOIN x USING (job_id)""",
    "stream_job_machine": f"WITH {_MOVED} SELECT job_id, arg_max(state, step) AS state, count(*) AS n_steps FROM m GROUP BY job_id",
    "ingest_job_machine": """WITH j AS (SELECT DISTINCT job_id, status, created_at, started_at, completed_at FROM ingestion_jobs), e AS (
  SELECT job_id, created_at AS t, 0 AS i, 'QUEUED' AS state FROM j UNION ALL SELECT job_id, started_at, 1, 'PARSING' FROM j UNION ALL SELECT job_id, completed_at, 2, status FROM j
), k AS (SELECT *, CASE state WHEN 'QUEUED' THEN 0 WHEN 'PARSING' THEN 1 WHEN 'CHUNKING' THEN 2 WHEN 'FEATURE_EXTRACTION' THEN 3 WHEN 'INDEXING' THEN 4 WHEN 'COMPLETED' THEN 5 WHEN 'FAILED' THEN 5 END AS place FROM e WHERE t IS NOT NULL),
b AS (SELECT *, max(place) OVER (PARTITION BY job_id ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k WHERE place IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, i) AS step FROM b WHERE before IS NULL OR place > before)
SELECT job_id, arg_max(state, step) AS state, count(*) AS n_steps, epoch_us(min(t) FILTER (state = 'PARSING')) AS started_us, epoch_us(min(t) FILTER (place = 5)) AS completed_us FROM m GROUP BY job_id""",
    "job_stops": f"WITH {_STOPS} SELECT * FROM f",
    "job_stop_counts": f"WITH {_STOPS} SELECT reason, count(*) AS n_jobs FROM f GROUP BY reason",
    "cancellation_flags": "SELECT user_id AS job_id, count(*) FILTER (event_id % 50 = 0) > 0 AS cancelled FROM events GROUP BY user_id",
    "sse_relay": f"""WITH {_EVENTS}, o AS (SELECT *, coalesce(max(CASE WHEN place = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM e)
SELECT event_id, 'event: ' || CASE state WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE 'status' END || chr(10) || 'data: {{"job_id":' || job_id || ',"state":"' || state || '"}}' || chr(10) || chr(10) AS frame FROM o WHERE over = 0""",
    "stream_no_replay": f"WITH {_EVENTS} SELECT event_id, job_id, state FROM e WHERE job_id % 10 = 3 AND event_id > (SELECT quantile_disc(event_id, 0.5) FROM events)",
    "stream_ingest_enqueue": "SELECT DISTINCT job_id, 'QUEUED' AS status FROM ingestion_jobs WHERE document_id <> ''",
    "stream_publish": f"""WITH {_EVENTS} SELECT event_id, '{{"job_id":' || job_id || ',"state":"' || state || '"}}' AS message FROM e""",
    "stream_token_filter": """WITH k AS (SELECT DISTINCT chunk_id FROM chunks), x AS (SELECT pqac_id, min(text_span) AS span, min(lower(trim(chunk_id))) AS chunk_id FROM citation_references GROUP BY pqac_id)
SELECT x.pqac_id, concat_ws(' ', x.span, CASE WHEN k.chunk_id IS NULL THEN regexp_replace(x.chunk_id, 'pqac-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '', 'g') ELSE k.chunk_id END, '', 'end') AS text
FROM x LEFT JOIN k ON x.chunk_id = k.chunk_id""",
    "elapsed_ms": "SELECT DISTINCT job_id, coalesce(epoch_us(started_at) - epoch_us(created_at), -1) AS waited_us, coalesce(epoch_us(completed_at) - epoch_us(started_at), -1) AS ran_us FROM ingestion_jobs",
    "trace_spans": """WITH j AS (SELECT DISTINCT job_id, created_at, started_at, completed_at FROM ingestion_jobs)
SELECT * FROM (SELECT md5(job_id) AS trace_id, 'job' AS name, substr(md5(job_id || '/job'), 1, 16) AS span_id, '' AS parent_id, epoch_us(completed_at) - epoch_us(created_at) AS us FROM j
UNION ALL SELECT md5(job_id), 'wait', substr(md5(job_id || '/wait'), 1, 16), substr(md5(job_id || '/job'), 1, 16), epoch_us(started_at) - epoch_us(created_at) FROM j
UNION ALL SELECT md5(job_id), 'run', substr(md5(job_id || '/run'), 1, 16), substr(md5(job_id || '/job'), 1, 16), epoch_us(completed_at) - epoch_us(started_at) FROM j) WHERE us IS NOT NULL""",
}
