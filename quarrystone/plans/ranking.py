"""Queries of reranking, trees, rendered contexts and ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_text
from ..operators import lookup, ranking, retrieval
from ..sources.tables import table
from . import search
from .documents import _C, _WORDS, chunk_rows, chunks

KINDS = ["signup", "error", "click", "view", "purchase"]


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best texts of each question by BM25, in the order of common words, five of them."""
    q = table(spark, sf, "eval_items").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c = retrieval.bm25_topk(q, d, k=20).join(d.select(F.col("id").alias("item_id"), "text"), "item_id")
    c = c.join(q.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id").drop("score")
    return ranking.rerank(c, 5).select("query_id", "item_id", "score", "rank")


def text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(spark, sf, "expanded_content", "raw_content", "document_type", "parties")
    return c.select("chunk_id", F.md5(first_text(F.col("expanded_content"), F.col("raw_content"), F.col("document_type"), F.col("parties"))).alias("text_hash")).distinct()


def numbered_context(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc_id", "split_idx", "source_file", "raw_content")
    return ranking.numbered_context(c, "doc_id", "split_idx", "source_file", "raw_content").select("doc_id", "n_rows", F.md5("context").alias("context_hash"))


def parent_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors of chunks in a tree of fives over their places in the document, the document as root."""
    c = chunks(spark, sf, "doc_id", "split_idx")
    level = lambda n: F.concat_ws("/", "doc_id", F.lit(str(n)), F.floor(F.col("split_idx") / 5**n).cast("string"))
    edges = [c.select(level(n).alias("node"), level(n + 1).alias("parent")).distinct() for n in range(3)]
    edges.append(c.select(level(3).alias("node"), F.col("doc_id").alias("parent")).distinct())
    e = edges[0]
    for x in edges[1:]:
        e = e.unionByName(x)
    return ranking.ancestors(e)


def metadata_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Type, jurisdiction and court named in the head of a chunk, and whether one of its parties stands there."""
    c, text = chunk_rows(spark, sf, "raw_content", "parties"), F.col("raw_content")
    court = F.nullif(F.regexp_extract(F.substring(text, 1, 3000), r"\b([A-Z][a-z]+ Court)\b", 1), F.lit(""))
    party = F.coalesce(F.exists("parties", lambda x: F.contains(F.substring(text, 1, 3000), x)), F.lit(False))
    types, places = (ranking.first_alias(text, r) for r in (lookup.DOCUMENT_TYPES, lookup.JURISDICTIONS))
    return c.select("chunk_id", types.alias("document_type_id"), places.alias("jurisdiction_id"), court.alias("court"), party.alias("names_party")).distinct()


def phase_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Hundredths of value by job and kind of event."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    p = e.groupBy(F.col("user_id").alias("job_id")).pivot("event_type", KINDS).agg(F.sum("cents"))
    return p.select("job_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in KINDS])


def response_envelope(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "ingestion_jobs").select("job_id", "document_id").distinct()
    ids = [F.md5(F.concat(F.lit(k), "job_id")).alias(f"{k}_id") for k in ("request", "trace", "parent")]
    return j.select("job_id", F.to_json(F.struct(*ids, "job_id", F.struct(F.coalesce("document_id", F.lit("")).alias("document_id")).alias("data"), F.when(F.col("document_id").isNull(), "no document").alias("error"))).alias("body"))


QUERIES = {f.__name__: f for f in (rerank_topk, text_fallback, numbered_context, parent_closure, metadata_extract, phase_ledger, response_envelope)}
_ALIAS = lambda r: "CASE " + " ".join(f"WHEN regexp_matches(lower(substr(raw_content, 1, 3000)), '{ranking.whole_words(n)}') THEN '{k}'" for k, n in r.items()) + " END"
SQL = {
    "rerank_topk": "WITH b AS (" + search.SQL["bm25_topk"].replace("rank <= 5", "rank <= 20") + f"""), w AS (
  SELECT b.query_id, b.item_id, b.rank AS r, list_distinct({_WORDS.format('q.text')}) AS x, list_distinct({_WORDS.format("coalesce(d.text, '')")}) AS y
  FROM b JOIN documents d ON d.doc_id = b.item_id JOIN eval_items q ON q.item_id = b.query_id
), s AS (SELECT query_id, item_id, r, CASE WHEN least(len(x), len(y)) > 0 THEN round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) ELSE 0 END::DOUBLE AS score FROM w)
SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM s) WHERE rank <= 5""",
    "text_fallback": f"WITH {_C} SELECT chunk_id, md5(coalesce(nullif(expanded_content, ''), nullif(raw_content, ''), nullif(document_type, ''), array_to_string(parties, ' '), '')) AS text_hash FROM c",
    "numbered_context": f"""WITH {_C}, k AS (SELECT *, sum(coalesce(len({_WORDS.format('raw_content')}) * 2, 0) + 20) OVER (PARTITION BY doc_id ORDER BY split_idx) AS running FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY split_idx) AS i FROM k WHERE running <= 6000)
SELECT doc_id, count(*) AS n_rows, md5(string_agg('[' || i || '] (Source: ' || coalesce(nullif(source_file, ''), 'UNKNOWN') || '): ' || coalesce(raw_content, '') || chr(10) || chr(10), '' ORDER BY i)) AS context_hash FROM n GROUP BY doc_id""",
    "parent_closure": f"""WITH RECURSIVE {_C}, e AS (
  SELECT DISTINCT doc_id || '/0/' || split_idx AS node, doc_id || '/1/' || split_idx // 5 AS parent FROM c
  UNION SELECT DISTINCT doc_id || '/1/' || split_idx // 5, doc_id || '/2/' || split_idx // 25 FROM c
  UNION SELECT DISTINCT doc_id || '/2/' || split_idx // 25, doc_id || '/3/' || split_idx // 125 FROM c
  UNION SELECT DISTINCT doc_id || '/3/' || split_idx // 125, doc_id FROM c
), a AS (SELECT node, parent AS ancestor, 1::BIGINT AS distance FROM e UNION ALL SELECT a.node, e.parent, a.distance + 1 FROM a JOIN e ON a.ancestor = e.node)
SELECT * FROM a""",
    "metadata_extract": rf"""WITH {_C} SELECT chunk_id, {_ALIAS(lookup.DOCUMENT_TYPES)} AS document_type_id, {_ALIAS(lookup.JURISDICTIONS)} AS jurisdiction_id,
  nullif(regexp_extract(substr(raw_content, 1, 3000), '\b([A-Z][a-z]+ Court)\b', 1), '') AS court,
  coalesce(len(list_filter(parties, lambda x: contains(substr(raw_content, 1, 3000), x))) > 0, false) AS names_party FROM c""",
    "phase_ledger": "SELECT user_id AS job_id, " + ", ".join(f"coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = '{k}'), 0)::BIGINT AS {k}" for k in KINDS) + " FROM events GROUP BY user_id",
    "response_envelope": """SELECT DISTINCT job_id, '{"request_id":"' || md5('request' || job_id) || '","trace_id":"' || md5('trace' || job_id) || '","parent_id":"' || md5('parent' || job_id) || '","job_id":"' || job_id
  || '","data":{"document_id":"' || coalesce(document_id, '') || '"}' || CASE WHEN document_id IS NULL THEN ',"error":"no document"' ELSE '' END || '}' AS body FROM ingestion_jobs""",
}
