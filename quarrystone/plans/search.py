"""Search, fusion and evaluation queries over the data folder, with their SQL.

Queries of a search are the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import calibrated, decoding
from ..operators import evaluation, fusion, manysearch, retrieval
from ..operators.lookup import trust
from ..operators.windows import claim_windows
from ..session import cut_lineage
from ..sources.tables import table

COLLECTIONS = {"PRIMARY": "primary_v2", "B": "hype_v2", "C": "propositions_v2", "A": "clusters_v2"}


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(e.filter(F.col("id") % 100 == 0), e, same=True)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("id"), "text")
    return retrieval.bm25_topk(q, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The term statistics of the index: texts that hold a term, and its occurrences."""
    p = retrieval.postings(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_occurrences"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Usable points, repeated rows removed."""
    v = table(spark, sf, "vector_points").filter((F.size("vector") == 64) & F.exists("vector", lambda x: x != 0))
    return v.select(F.col("point_no").alias("id"), F.col("vector").alias("vec"), "collection", "chunk_id", "doc_id").dropDuplicates(["id"])


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): the title of the document of each query's point."""
    title = table(spark, sf, "document_metadata").filter("title <> ''").groupBy(F.col("document_id").alias("doc_id")).agg(F.min("title").alias("text"))
    return points(spark, sf).filter(F.col("id") % 100 == 0).select("id", "doc_id").join(title, "doc_id").select("id", "text")


LISTS = "query_id long, path string, rank int, item_id string, payload string"


def dense_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of every collection; hits without a chunk keep their rank. The payload is the point."""
    v = points(spark, sf)
    hits = retrieval.dense_topk(v.filter(F.col("id") % 100 == 0), v.filter(F.col("collection").isin(list(COLLECTIONS.values()))), same=True, list_column="collection")
    path = F.create_map(*[F.lit(x) for path, name in COLLECTIONS.items() for x in (name, path)])[F.col("collection")]
    hits = hits.select("query_id", path.alias("path"), "rank", F.col("item_id").alias("point"))
    hits = hits.join(v.select(F.col("id").alias("point"), F.nullif(F.col("chunk_id"), F.lit("")).alias("item_id")), "point", "left")
    return hits.select("query_id", "path", "rank", "item_id", F.col("point").cast("string").alias("payload"))


def text_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Path D: the chunks that the titles find by BM25. The payload is the document."""
    c = table(spark, sf, "chunks")
    hits = manysearch.bm25_many(query_texts(spark, sf), c.select(F.col("chunk_id").alias("id"), F.col("raw_content").alias("text")))
    hits = hits.join(c.select(F.col("chunk_id").alias("item_id"), F.col("doc_id").alias("payload")).distinct(), "item_id")
    return hits.select("query_id", F.lit("D").alias("path"), "rank", "item_id", "payload")


def path_lists(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, path, rank, item_id, payload) of the five paths; a path that cannot be planned has no rows."""
    return fusion.isolated(spark, lambda: text_lists(spark, sf), LISTS).unionByName(fusion.isolated(spark, lambda: dense_lists(spark, sf), LISTS))


def multi_path_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return path_lists(spark, sf).select("query_id", "path", "rank", "item_id", "payload")


def paths_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by path where the table of one path and a column of another are missing."""
    broken = [lambda: spark.read.parquet(f"{sf}/no_such_index.parquet"), lambda: dense_lists(spark, sf).select("no_such_column")]
    lists = fusion.isolated(spark, lambda: dense_lists(spark, sf), LISTS)
    for build in broken:
        lists = lists.unionByName(fusion.isolated(spark, build, LISTS))
    return lists.groupBy("path").agg(F.count("*").alias("n_hits"))


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(path_lists(spark, sf), payload="payload")


def rrf_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The general form with another constant: a path whose name stands in the sources so far is not appended."""
    f = fusion.reciprocal_rank_fusion(path_lists(spark, sf), k=10)
    return f.select("query_id", "item_id", "score", fusion.appended(F.split("sources", ",")).alias("sources"), "rank")


def rrf_top(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(path_lists(spark, sf), top_n=8, payload="payload")


def confidence_features(spark: SparkSession, sf: str) -> DataFrame:
    f = evaluation.path_features(rrf_fuse(spark, sf))
    c = f.withColumn("confidence", F.round(calibrated(F.col("top1"), F.col("spread"), F.col("agreement")), 6))
    return c.withColumn("_d", decoding(F.col("confidence"))).select("*", "_d.temperature", "_d.top_p").drop("_d")


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    fused = cut_lineage(rrf_fuse(spark, sf).select("query_id", "item_id", "rank"))
    relevant, counts = relevance(spark, sf, fused)
    return evaluation.retrieval_metrics(fused, relevant, counts=counts)


def relevance(spark: SparkSession, sf: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of found (query_id, item_id) those that are relevant, and (query_id, n), the number of all relevant items. An item is
    relevant if its chunk is of the document of the query's point. A document's items are not listed for each of its queries, since
    a large one has many of both."""
    v = points(spark, sf)
    of = v.select("doc_id", F.col("chunk_id").alias("item_id")).filter("item_id <> ''").distinct()
    q = v.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "doc_id")
    n = q.join(of.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").select("query_id", "n")
    return found.select("query_id", "item_id").distinct().join(q, "query_id").join(of, ["doc_id", "item_id"]).select("query_id", "item_id"), n


def crag_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits, and for queries of low confidence the addresses of the query's document as web results."""
    fused = cut_lineage(rrf_fuse(spark, sf))
    local = fused.select("query_id", F.col("item_id").alias("item"), "score", "rank")
    m = table(spark, sf, "document_metadata").select(F.col("document_id").alias("doc_id"), "pdf_url").filter("pdf_url is not null").distinct()
    q = points(spark, sf).filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "doc_id")
    web = q.join(m, "doc_id").select("query_id", F.col("pdf_url").alias("item"), F.round(0.8 * trust(F.col("pdf_url")) * 0.6, 6).alias("score"), F.lit(1).alias("rank"))
    confidence = evaluation.path_features(fused).select("query_id", (F.col("top1") * 12).alias("confidence"))
    return fusion.merge_with_web(local, web, confidence)


def window_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence windows of fused hits, earlier hits claiming their neighbours."""
    c = table(spark, sf, "chunks").select("chunk_id", "doc_id", "split_idx", F.col("raw_content").alias("text")).dropDuplicates(["chunk_id"])
    hits = rrf_fuse(spark, sf).select("query_id", "rank", F.col("item_id").alias("chunk_id")).join(c.drop("text"), "chunk_id")
    return claim_windows(hits, c)


_POINTS = """
p AS (
  SELECT DISTINCT point_no AS id, vector::DOUBLE[] AS vec, collection, nullif(chunk_id, '') AS chunk_id, doc_id FROM vector_points
  WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0
), sims AS (
  SELECT q.id AS query_id, c.id AS point, c.chunk_id AS item_id, c.collection,
         CASE c.collection WHEN 'primary_v2' THEN 'PRIMARY' WHEN 'hype_v2' THEN 'B' WHEN 'propositions_v2' THEN 'C' ELSE 'A' END AS path,
         round(list_cosine_similarity(q.vec, c.vec), 6) AS s
  FROM p q JOIN p c ON q.id <> c.id WHERE q.id % 100 = 0 AND c.collection IN ('primary_v2', 'hype_v2', 'propositions_v2', 'clusters_v2')
), title AS (
  SELECT document_id AS doc_id, min(title) AS text FROM document_metadata WHERE title <> '' GROUP BY 1
), bq AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT p.id AS query_id, unnest(regexp_extract_all(lower(t.text), '[\\p{L}\\p{N}_]+')) AS term FROM p JOIN title t USING (doc_id) WHERE p.id % 100 = 0) GROUP BY ALL
), bd AS (
  SELECT chunk_id, doc_id, regexp_extract_all(lower(coalesce(raw_content, '')), '[\\p{L}\\p{N}_]+') AS t FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)
), bs AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM bd
), bp AS (
  SELECT chunk_id, doc_id, len(t) AS length, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, t, unnest(t) AS term FROM bd) WHERE term IN (SELECT term FROM bq) GROUP BY ALL
), bdf AS (SELECT term, count(*) AS df FROM bp GROUP BY term
), bh AS (
  SELECT query_id, chunk_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS s
  FROM bp JOIN bdf USING (term) JOIN bq USING (term), bs GROUP BY ALL
), lists AS (
  SELECT query_id, path, rank, item_id, payload FROM (SELECT query_id, path, item_id, point::VARCHAR AS payload, row_number() OVER (PARTITION BY query_id, path ORDER BY s DESC, point) AS rank FROM sims) WHERE rank <= 5
  UNION ALL
  SELECT query_id, 'D', rank, chunk_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM bh) WHERE rank <= 5
), seen AS (
  SELECT *, CASE path WHEN 'D' THEN 1 WHEN 'PRIMARY' THEN 2 WHEN 'B' THEN 3 WHEN 'C' THEN 4 ELSE 5 END AS ord FROM lists WHERE item_id IS NOT NULL
), fused AS (
  SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(ord * 1000 + rank) AS first,
         array_to_string(list_transform(list_sort(list_distinct(list(ord || ':' || path))), lambda x: split_part(x, ':', 2)), ',') AS sources,
         arg_min(payload, ord * 1000 + rank) AS payload
  FROM seen GROUP BY ALL
), ranked AS (
  SELECT query_id, item_id, score, sources, payload, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item_id) AS rank FROM fused
)"""
_FEATURES = """
, feat AS (
  SELECT query_id, round(max(score) FILTER (rank = 1), 6) AS top1,
         round(coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 5), 0), 6) AS spread,
         round(avg(CASE WHEN contains(sources, ',') THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement
  FROM ranked WHERE rank <= 5 GROUP BY query_id
)"""

QUERIES = {f.__name__: f for f in (dense_topk, bm25_topk, bm25_terms, multi_path_retrieve, paths_isolated, rrf_fuse, rrf_sources, rrf_top, confidence_features, retrieval_metrics, crag_merge, window_claims)}
SQL = {
    "dense_topk": """
SELECT query_id, item_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""",
    "bm25_topk": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM eval_items WHERE item_id % 100 = 0) GROUP BY ALL),
po AS (SELECT doc_id, len(t) AS length, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
s AS (SELECT query_id, doc_id AS item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM po JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
    "bm25_terms": r"""
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term""",
    "multi_path_retrieve": "WITH " + _POINTS + " SELECT query_id, path, rank, item_id, payload FROM lists",
    "paths_isolated": "WITH " + _POINTS + " SELECT path, count(*) AS n_hits FROM lists WHERE path <> 'D' GROUP BY path",
    "rrf_sources": "WITH "
    + _POINTS
    + """, g AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (10 + rank)), 9) AS score, min(ord * 1000 + rank) AS first, list_sort(list_distinct(list(ord))) AS o FROM seen GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item_id) AS rank,
  array_to_string(list_transform(CASE WHEN list_contains(o, 2) THEN list_filter(o, lambda x: x <> 5) ELSE o END, lambda x: CASE x WHEN 1 THEN 'D' WHEN 2 THEN 'PRIMARY' WHEN 3 THEN 'B' WHEN 4 THEN 'C' ELSE 'A' END), ',') AS sources FROM g""",
    "rrf_fuse": "WITH " + _POINTS + " SELECT * FROM ranked",
    "rrf_top": "WITH " + _POINTS + " SELECT * FROM ranked WHERE rank <= 8",
    "confidence_features": "WITH "
    + _POINTS
    + _FEATURES
    + """, c AS (SELECT *, round(greatest(0, least(1, 0.6 * top1 + 0.2 * spread + 0.2 * agreement)), 6) AS confidence FROM feat)
SELECT *, CASE WHEN confidence > 0.5 AND confidence <= 0.8 THEN 0.1 ELSE 0.0 END::DOUBLE AS temperature,
       CASE WHEN confidence > 0.5 AND confidence <= 0.8 THEN 0.3 ELSE 0.1 END::DOUBLE AS top_p FROM c""",
    "retrieval_metrics": "WITH "
    + _POINTS
    + """, rel AS (
  SELECT DISTINCT q.id AS query_id, c.chunk_id AS item_id FROM p q JOIN p c ON q.doc_id = c.doc_id WHERE q.id % 100 = 0 AND c.chunk_id IS NOT NULL
), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1
), h AS (
  SELECT r.query_id, r.rank, CASE WHEN rel.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN rel ON r.query_id = rel.query_id AND r.item_id = rel.item_id
), w AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM h)
SELECT w.query_id, coalesce(any_value(n.n), 0) AS n_relevant, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0), 6) AS mrr,
  round(CASE WHEN any_value(n.n) > 0 THEN sum(CASE WHEN hit = 1 AND rank <= 10 THEN hits / rank ELSE 0 END) / least(any_value(n.n), 10) ELSE 0 END::DOUBLE, 6) AS average_precision,
  round(CASE WHEN any_value(n.n) > 0 THEN sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / any_value(n.n) ELSE 0 END::DOUBLE, 6) AS recall
FROM w LEFT JOIN n ON w.query_id = n.query_id GROUP BY w.query_id""",
    "window_claims": "WITH RECURSIVE "
    + _POINTS.lstrip()
    + """, ch AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, split_idx, raw_content AS text FROM chunks),
k AS (SELECT r.query_id, r.rank, ch.chunk_id, ch.doc_id, ch.split_idx, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS n FROM ranked r JOIN ch ON r.item_id = ch.chunk_id),
w AS (SELECT k.query_id, k.n, list({'i': ch.chunk_id, 't': ch.text} ORDER BY ch.split_idx) AS near FROM k JOIN ch ON ch.doc_id = k.doc_id AND ch.split_idx BETWEEN k.split_idx - 1 AND k.split_idx + 1 GROUP BY ALL),
s AS (
  SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS seen, NULL::STRUCT(i VARCHAR, t VARCHAR)[] AS got FROM k
  UNION ALL
  SELECT k.query_id, k.n, CASE WHEN list_contains(seen, k.chunk_id) THEN seen ELSE list_concat(seen, list_filter(list_transform(coalesce(near, []), lambda x: x.i), lambda x: NOT list_contains(seen, x))) END,
    CASE WHEN NOT list_contains(seen, k.chunk_id) THEN list_filter(coalesce(near, []), lambda x: NOT list_contains(seen, x.i)) END
  FROM s JOIN k ON k.query_id = s.query_id AND k.n = s.n + 1 LEFT JOIN w ON w.query_id = k.query_id AND w.n = k.n
)
SELECT k.query_id, k.rank, k.chunk_id, len(got) AS n_parts, coalesce(array_to_string(list_filter(list_transform(got, lambda x: x.t), lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS window_text
FROM s JOIN k ON s.query_id = k.query_id AND s.n = k.n WHERE got IS NOT NULL""",
    "crag_merge": "WITH "
    + _POINTS
    + _FEATURES
    + """, both_ AS (
  SELECT query_id, item_id AS item, score, rank, 'local' AS source FROM ranked
  UNION ALL
  SELECT q.id, m.pdf_url, round(0.8 * 0.2 * 0.6, 6), 1, 'web' FROM p q JOIN (SELECT DISTINCT document_id, pdf_url FROM document_metadata WHERE pdf_url IS NOT NULL) m ON m.document_id = q.doc_id
  WHERE q.id IN (SELECT query_id FROM feat WHERE top1 * 12 < 0.4)
)
SELECT query_id, item, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, rank, item) AS rank FROM both_""",
}
