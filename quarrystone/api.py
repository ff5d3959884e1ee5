"""A service without a server: what its endpoints do, as functions from tables to tables.

A service keeps its tables under one folder, shared by all executors. Requests are tables too: one row or millions alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import states, upserts
from .sources.schemas import bootstrap

QUEUE = "job_id string, query string, mode string"
CANCELLATIONS = "job_id string, cancelled_at timestamp"
EVENTS = "job_id string, seq long, state string"


class Service:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def start(self) -> Service:
        """Makes the tables that are missing; what is there stays."""
        bootstrap(self.spark, self.root)
        for name, schema in (("queue", QUEUE), ("cancellations", CANCELLATIONS), ("events", EVENTS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _append(self, df: DataFrame, name: str) -> None:
        df.select(*self.read(name).columns).write.mode("append").parquet(f"{self.root}/{name}")

    def enqueue(self, requests: DataFrame, mode: str = "deep") -> DataFrame:
        """Queues (query) requests, each query and mode once, and returns (job_id, state) of them; the id is made of the request."""
        r = requests.select("query").distinct().withColumn("mode", F.lit(mode))
        r = r.withColumn("job_id", S.name_uuid(F.concat_ws("|", F.coalesce("query", F.lit("")), "mode")))
        self._append(r.join(self.read("queue").select("job_id"), "job_id", "left_anti"), "queue")
        return r.select("job_id", "query", F.lit("QUEUED").alias("state"))

    def cancel(self, jobs: DataFrame, at) -> None:
        """Sets the flag of (job_id) rows that are queued; a flag that is set stays."""
        known = jobs.select("job_id").distinct().join(self.read("queue").select("job_id"), "job_id", "left_semi")
        self._append(known.join(self.read("cancellations").select("job_id"), "job_id", "left_anti").withColumn("cancelled_at", F.lit(at).cast("timestamp")), "cancellations")

    def publish(self, events: DataFrame) -> None:
        self._append(events, "events")

    def job_states(self) -> DataFrame:
        """(job_id, state) of every queued job: the last state that its events led to; a flag cancels a job that has not ended."""
        moved = states.transitions(self.read("events"), "job_id", "state", "seq")
        last = moved.groupBy("job_id").agg(F.max_by("state", "step").alias("state"))
        j = self.read("queue").select("job_id").join(last, "job_id", "left").join(self.read("cancellations"), "job_id", "left")
        state = F.coalesce("state", F.lit("QUEUED"))
        return j.select("job_id", F.when(F.col("cancelled_at").isNotNull() & ~state.isin(states.QUERY_ENDS), "CANCELLED").otherwise(state).alias("state"))

    def job_events(self, job_id: str) -> DataFrame:
        """The frames of a job in order, until its end."""
        e = states.until_end(self.read("events").filter(F.col("job_id") == job_id), "job_id", "state", states.QUERY_ENDS, "seq")
        name = F.when(F.col("state") == "COMPLETED", "completed").when(F.col("state").isin(states.QUERY_ENDS), "failed").otherwise("status")
        return e.select("seq", S.sse_frame(name, F.struct("job_id", "state")).alias("frame"))

    def ingest(self, files: DataFrame, at) -> DataFrame:
        """Queues (document_id, file_path) rows, one or a batch; a file that is queued already is not queued again."""
        f = files.select("document_id", "file_path").distinct().withColumn("job_id", S.name_uuid(F.concat_ws("|", "document_id", "file_path")))
        given = {"status": F.lit("QUEUED"), "created_at": F.lit(at).cast("timestamp"), "retry_count": F.lit(0)}
        rows = f.select("job_id", "document_id", *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in self.read("ingestion_jobs").dtypes if n not in ("job_id", "document_id")])
        self._append(rows.join(self.read("ingestion_jobs").select("job_id"), "job_id", "left_anti"), "ingestion_jobs")
        return f.select("job_id", "document_id")

    def citation(self, pqac_id: str) -> DataFrame:
        """The citation, with the defaults of what is missing in it; no row if there is none."""
        c = self.read("citation_references").filter(F.col("pqac_id") == pqac_id)
        filled = {"document_version": F.coalesce(F.nullif("document_version", F.lit(0)), F.lit(1)), "document_hash": F.coalesce("document_hash", F.lit("")), "citation_confidence": F.coalesce(F.nullif("citation_confidence", F.lit(0.0)), F.lit(0.95))}
        return c.withColumns(filled)

    def document(self, document_id: str) -> DataFrame:
        return upserts.last_wins(self.read("document_metadata").filter(F.col("document_id") == document_id), "document_id", "version", "title", "pdf_url")
