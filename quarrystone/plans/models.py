"""Queries of provider-backed operators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import providers as P
from ..operators import summaries
from ..session import checkpoint_dir
from ..sources.tables import table
from ..streaming import jobs
from .documents import _C, chunk_rows, chunks
from .search import points


def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", P.call(P.hashed_embedding(), "array<float>", "text").alias("embedding"))


def propositions(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(spark, sf, "doc_id", "raw_content").select("chunk_id", "doc_id", F.explode(P.call(P.triples, "array<string>", "raw_content")).alias("t"))
    part = F.split("t", "\t")
    return c.select("chunk_id", "doc_id", part[0].alias("subject"), part[1].alias("predicate"), part[2].alias("object"), F.concat_ws(" ", part).alias("proposition")).distinct()


def hype_questions(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, "raw_content").select("chunk_id", P.call(P.questions, "array<string>", "raw_content").alias("questions")).distinct()


def decompose_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items").select("item_id", P.call(P.subqueries, "array<string>", "text").alias("parts"))
    return q.select("item_id", F.posexplode("parts").alias("part_no", "part"))


def evidence_map(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence in cited chunks for each citation's span; citations without any are left out."""
    c = table(spark, sf, "citation_references").select("pqac_id", "text_span", F.lower(F.trim("chunk_id")).alias("chunk_id")).filter("text_span is not null").distinct()
    j = c.join(chunks(spark, sf, "raw_content"), "chunk_id")
    return j.select("pqac_id", "chunk_id", P.call(P.best_evidence, "string", "text_span", "raw_content").alias("evidence")).filter("evidence <> 'NO_EVIDENCE'")


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    v = points(spark, sf).filter("collection = 'primary_v2' and chunk_id <> ''").groupBy("chunk_id").agg(F.min_by("vec", "id").alias("vec"))
    return v.join(chunks(spark, sf, "doc_id", "raw_content"), "chunk_id").select("doc_id", F.col("chunk_id").alias("node_id"), F.col("raw_content").alias("text"), "vec")


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.clusters(_leaves(spark, sf)).groupBy("doc_id", "cluster").agg(F.count("*").alias("n_nodes"))


def summary_levels(spark: SparkSession, sf: str) -> DataFrame:
    t = summaries.summary_tree(_leaves(spark, sf))
    return t.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum(F.size("children")).alias("n_children"))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.event_stream(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return jobs.run_to_table(s, _folder(spark), "update", "event_type")


def stream_job_states(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_to_table(jobs.job_states(jobs.event_stream(spark, sf, "events")), _folder(spark), "update", "job_id")


def stream_enqueue_once(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.event_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_to_table(jobs.enqueue_once(e, "event_id", "ts", None).select("event_id", "event_type"), _folder(spark))


QUERIES = {f.__name__: f for f in (embed_texts, propositions, hype_questions, decompose_queries, evidence_map, kmeans_clusters, summary_levels, stream_counts, stream_job_states, stream_enqueue_once)}
_SENTENCES = "regexp_extract_all(coalesce(raw_content, ''), '[^.?!]+[.?!]?')"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_VERBS = ", ".join(f"'{v}'" for v in sorted(P.VERBS))
SQL = {
    "hype_questions": f"""WITH {_C} SELECT chunk_id, list_transform(list_filter({_SENTENCES}, lambda x: trim(x, ' .?!' || chr(10)) <> '')[1:3], lambda x: 'What about ' || lower(trim(x, ' .?!')) || '?') AS questions FROM c""",
    "propositions": rf"""WITH {_C}, s AS (SELECT chunk_id, doc_id, unnest({_SENTENCES}) AS s FROM c),
w AS (SELECT chunk_id, doc_id, list_filter(string_split_regex(trim(s, ' .?!' || chr(10) || chr(9)), '[\s\p{{Z}}\x0b\x1c-\x1f]+'), lambda x: x <> '') AS w FROM s),
v AS (SELECT *, list_min(list_filter(range(2, len(w) + 1), lambda i: list_contains([{_VERBS}], lower(w[i])))) AS at_ FROM w)
SELECT DISTINCT chunk_id, doc_id, array_to_string(w[1:at_ - 1], ' ') AS subject, w[at_] AS predicate, array_to_string(w[at_ + 1:], ' ') AS object, array_to_string(w, ' ') AS proposition FROM v WHERE at_ < len(w)""",
    "decompose_queries": rf"""WITH l AS (SELECT item_id, list_concat([coalesce(text, '')], list_filter(list_transform(string_split_regex(coalesce(text, ''), '[;?]|, and '), lambda x: {_STRIP.format('x')}), lambda x: len(list_filter(string_split_regex(x, '[\s\p{{Z}}]+'), lambda w: w <> '')) > 3)) AS l FROM eval_items),
d AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS l FROM l)
SELECT item_id, unnest(range(len(l)))::INT AS part_no, unnest(l) AS part FROM d""",
    "evidence_map": rf"""WITH {_C}, x AS (SELECT DISTINCT pqac_id, text_span, lower(trim(chunk_id)) AS chunk_id FROM citation_references WHERE text_span IS NOT NULL),
j AS (SELECT x.pqac_id, x.chunk_id, list_distinct(regexp_extract_all(lower(x.text_span), '[\p{{L}}\p{{N}}]+')) AS want, {_SENTENCES} AS s FROM x JOIN c ON x.chunk_id = c.chunk_id),
u AS (SELECT pqac_id, chunk_id, want, unnest(range(len(s))) AS i, unnest(s) AS s FROM j),
n AS (SELECT *, len(list_intersect(want, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')))) AS n FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY pqac_id, chunk_id, want ORDER BY n DESC, i) AS k FROM n WHERE n > 0)
SELECT pqac_id, chunk_id, {_STRIP.format('s')} AS evidence FROM b WHERE k = 1""",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_job_states": "SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id",
    "stream_enqueue_once": "SELECT DISTINCT event_id, event_type FROM events",
}
