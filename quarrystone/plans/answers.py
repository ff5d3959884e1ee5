"""Queries of the answering chain: fast and deep mode, judges, gates, generated tokens; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import evaluation, fusion, judges, lookup, packing, providers, ranking, retrieval
from ..session import cut_lineage
from ..sources.tables import table
from .documents import _C, _WORDS, _cited, chunk_rows, chunks, failure_report
from .documents import SQL as _DOCUMENTS
from .search import _POINTS, path_lists, points, query_texts, relevance
from .search import SQL as _SEARCH


def _hits(spark: SparkSession, sf: str, top_n: int) -> DataFrame:
    """(query_id, query, chunk_id, doc_id, text, rank) of the fused hits that are chunks, for queries that have a text."""
    f = fusion.reciprocal_rank_fusion(path_lists(spark, sf), top_n=top_n).select("query_id", F.col("item_id").alias("chunk_id"), "rank")
    f = f.join(chunks(spark, sf, "doc_id", F.col("raw_content").alias("text")), "chunk_id")
    return f.join(query_texts(spark, sf).select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id")


def fast_query(spark: SparkSession, sf: str) -> DataFrame:
    """Fast mode as one plan: five paths, fusion to fifteen, reranking to five, packing, and the flat context ``[key] content``."""
    r = ranking.rerank(_hits(spark, sf, 15), 5)
    p = packing.prefix_pack(r, "query_id", "rank", S.token_estimate(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "chunk_id", F.lit("] "), F.coalesce("text", F.lit(""))).alias("l"))))
    g = p.groupBy("query_id").agg(lines.alias("l"))
    return g.select("query_id", F.size("l").alias("n_rows"), F.md5(F.array_join(F.transform("l", lambda x: x["l"]), "\n\n")).alias("context_hash"))


def rerank_and_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Eight fused hits, reranked by a pair provider in batches, packed, best at both ends."""
    h = _hits(spark, sf, 8).withColumn("pair", judges.pair_scores(judges.common_words, "query", "text"))
    p = packing.prefix_pack(ranking.rerank(h, score=F.coalesce("pair", F.lit(0.0))), "query_id", "rank", S.token_estimate(F.col("text")))
    return packing.interleave(p, "query_id", "rank").select("query_id", "chunk_id", "score", "rank", "position")


def prefiltered_search(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits of documents whose jurisdiction is not known to be another than the wanted one."""
    m = table(spark, sf, "canonical_metadata").distinct()
    other = m.filter(F.coalesce(S.given(F.col("jurisdiction_id")), F.lit("XN-AR")) != "XN-AR").select(F.col("document_id").alias("doc_id")).distinct()
    return _hits(spark, sf, 15).join(other, "doc_id", "left_anti").select("query_id", "chunk_id", "rank")


def global_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty hits of the primary collection, with the chunk and its text instead of the point."""
    v = points(spark, sf)
    h = retrieval.dense_topk(v.filter(F.col("id") % 100 == 0), v.filter("collection = 'primary_v2'"), k=20, same=True)
    h = h.join(v.select(F.col("id").alias("item_id"), "chunk_id"), "item_id").join(chunks(spark, sf, "raw_content"), "chunk_id", "left")
    return h.select("query_id", "rank", "score", F.col("chunk_id"), F.md5(F.coalesce("raw_content", F.lit(""))).alias("text_hash"))


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as candidates: score 0 and no source where missing, text before content, never the questions; the rest as metadata."""
    c = chunk_rows(spark, sf, "raw_content", "expanded_content", "document_type", "doc_id")
    text = F.coalesce(S.given(F.col("expanded_content")), S.given(F.col("raw_content")), F.lit(""))
    meta = F.to_json(F.struct(F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("document_type", F.lit("")).alias("document_type")))
    c = c.select("chunk_id", F.lit(0.0).alias("score"), F.lit("").alias("source_path"), F.md5(text).alias("content_hash"), meta.alias("metadata"))
    return c.distinct()


def candidate_back(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates as flat rows again: the metadata's fields are columns."""
    c = candidate_rows(spark, sf).withColumn("m", F.from_json("metadata", "doc_id string, document_type string"))
    return c.select("chunk_id", "m.doc_id", "m.document_type", F.col("score").alias("relevance"), F.col("content_hash").alias("text_hash"))


def deep_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Deep mode's map pairs: at most four subquestions of a question, and at most twenty chunks of each."""
    q = table(spark, sf, "eval_items").filter(F.col("item_id") % 100 == 0).select("item_id", F.posexplode(providers.call(providers.subqueries, "array<string>", "text")).alias("part_no", "text"))
    q = q.filter("part_no < 4").withColumn("id", F.col("item_id") * 10 + F.col("part_no"))
    return retrieval.bm25_topk(q.select("id", "text"), chunks(spark, sf, "raw_content").select(F.col("chunk_id").alias("id"), F.col("raw_content").alias("text")), k=20)


def deep_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the first twenty chunks of each question; below a success rate of 0.6 the session has none."""
    q = table(spark, sf, "eval_items").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("id"), "text")
    c = chunks(spark, sf, "raw_content")
    h = retrieval.bm25_topk(q, c.select(F.col("chunk_id").alias("id"), F.col("raw_content").alias("text")), k=20)
    h = h.join(c.select(F.col("chunk_id").alias("item_id"), "raw_content"), "item_id").join(q.select(F.col("id").alias("query_id"), "text"), "query_id")
    e = h.withColumn("evidence", providers.call(providers.best_evidence, "string", "text", "raw_content"))
    e = e.withColumn("ok", F.avg(F.when(F.col("evidence") != "NO_EVIDENCE", 1.0).otherwise(0.0)).over(W.partitionBy("query_id")))
    return e.filter("ok >= 0.6 and evidence <> 'NO_EVIDENCE'").select("query_id", F.col("item_id").alias("chunk_id"), F.md5("evidence").alias("evidence_hash"), F.round("ok", 6).alias("success"))


def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A generated answer as tokens in order: the default generator quotes the head of the best hit with its marker."""
    best = ranking.rerank(_hits(spark, sf, 15), 1)
    words = F.filter(F.split(F.concat_ws(" ", F.substring(F.coalesce("text", F.lit("")), 1, 200), F.concat(F.lit("["), "chunk_id", F.lit("]"))), r"\s+"), lambda w: w != "")
    return best.select("query_id", F.posexplode(words).alias("seq", "token"))


def complexity_resolved(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "eval_items").select("item_id", judges.resolved_complexity(F.col("text")).alias("c"))
    return t.select("item_id", "c.complexity", "c.confidence")


def citation_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Both stages of citation checks: the word overlap, and the judge for what it leaves open."""
    v = _cited(spark, sf).withColumn("_v", lookup.citation_verdict(F.col("text_span"), F.col("raw_content"), F.col("citation_confidence").isNull()))
    return v.select("pqac_id", judges.judged(F.col("_v.verdict"), F.col("text_span"), F.col("raw_content")).alias("verdict")).distinct()


def grounded_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are answered right (a job completed) and whose citations resolve to a share of 0.95."""
    c = table(spark, sf, "citation_references").select("pqac_id", "document_id", F.trim("chunk_id").alias("chunk_id")).filter("document_id is not null").distinct()
    ok = c.join(chunks(spark, sf).withColumn("ok", F.lit(1)), "chunk_id", "left")
    p = ok.groupBy("document_id").agg(F.round(F.count("ok") / F.count("*"), 6).alias("precision"))
    right = table(spark, sf, "ingestion_jobs").groupBy("document_id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("correct"))
    p = p.join(right, "document_id", "left").withColumn("correct", F.coalesce("correct", F.lit(False)))
    return p.select("document_id", "precision", "correct", (F.col("correct") & (F.col("precision") >= 0.95)).alias("accurate"))


def element_filter_open(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that satisfy their elements; those without a text cannot be judged and stay, without a verdict."""
    c = chunk_rows(spark, sf, "raw_content", "obligations", "elements")
    c = c.withColumn("_e", lookup.satisfied_elements(F.col("raw_content"), F.col("obligations"), F.col("elements"))).withColumn("ratio", F.col("_e.ratio"))
    return judges.fail_open(c, F.col("_e.passes"), F.coalesce(S.given(F.col("raw_content")), F.lit("")) == "", "ratio").select("chunk_id", "ratio").distinct()


def element_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the element filter and their number."""
    c = chunk_rows(spark, sf, "raw_content", "obligations", "elements").withColumn("_e", lookup.satisfied_elements(F.col("raw_content"), F.col("obligations"), F.col("elements")))
    status = F.when(F.coalesce(S.given(F.col("raw_content")), F.lit("")) == "", "error").when(F.col("_e.passes"), "passed").otherwise("dropped")
    return c.select("chunk_id", status.alias("status")).distinct().groupBy("status").agg(F.count("*").alias("n"))


def path_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a query's expected chunks that each path found, and whether the mean reaches the gate of 0.8."""
    lists = cut_lineage(path_lists(spark, sf))
    relevant, counts = relevance(spark, sf, lists)
    return evaluation.path_recall(lists, relevant, counts=counts)


def fused_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reciprocal rank of every path and of the fused list, and whether the fused one is at least the best."""
    lists = cut_lineage(path_lists(spark, sf))
    rel = cut_lineage(relevance(spark, sf, lists)[0])
    fused = fusion.reciprocal_rank_fusion(lists).select("query_id", F.lit("FUSED").alias("path"), "rank", "item_id")
    return evaluation.fused_improves(lists.select("query_id", "path", "rank", "item_id").unionByName(fused), rel)


def failure_text(spark: SparkSession, sf: str) -> DataFrame:
    """The failure report as lines: category and percentage with one decimal."""
    return failure_report(spark, sf).select(F.concat("category", F.lit(": "), F.format_number(F.col("share") * 100, 1), F.lit("%")).alias("line"))


def chunk_features(spark: SparkSession, sf: str) -> DataFrame:
    """Propositions and questions of every chunk in one pass over the texts."""
    f = judges.features(chunk_rows(spark, sf, "raw_content"), "raw_content", {"triples": providers.triples, "questions": providers.questions})
    return f.select("chunk_id", F.size("triples").alias("n_triples"), F.size("questions").alias("n_questions")).distinct()


def calibration_trained(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of fused lists by a logistic model of their three features, trained on whether the first hit is relevant."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = cut_lineage(fusion.reciprocal_rank_fusion(path_lists(spark, sf)))
    x = evaluation.path_features(f)
    first = f.filter("rank = 1").join(relevance(spark, sf, f.filter("rank = 1"))[0].withColumn("label", F.lit(1.0)), ["query_id", "item_id"], "left").select("query_id", F.coalesce("label", F.lit(0.0)).alias("label"))
    rows = VectorAssembler(inputCols=["top1", "spread", "agreement"], outputCol="features").transform(x.join(first, "query_id"))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(rows)
    return model.transform(rows).select("query_id", "label", F.round(vector_to_array("probability")[1], 6).alias("confidence"))


_FUNCTIONS = [
    fast_query, rerank_and_pack, prefiltered_search, global_dense, candidate_rows, candidate_back, deep_candidates, deep_evidence, answer_tokens, complexity_resolved, citation_judged, grounded_accuracy,
    element_filter_open, element_telemetry, path_recall, fused_gate, failure_text, chunk_features, calibration_trained,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HITS = "WITH " + _POINTS + f""", c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks), h AS (
  SELECT r.query_id, t.text AS query, c.chunk_id, c.doc_id, c.raw_content AS text, r.rank
  FROM ranked r JOIN c ON r.item_id = c.chunk_id JOIN p ON p.id = r.query_id JOIN title t ON t.doc_id = p.doc_id WHERE r.rank <= {{n}}
), w AS (SELECT *, list_distinct({_WORDS.format('query')}) AS x, list_distinct({_WORDS.format("coalesce(text, '')")}) AS y FROM h
), sc AS (SELECT *, CASE WHEN least(len(x), len(y)) > 0 THEN round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) ELSE 0 END::DOUBLE AS score FROM w
), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new FROM sc)"""
def _hits_sql(n: int) -> str:
    return _HITS.replace("{n}", str(n))


_PACK = f"""k AS (SELECT *, sum(coalesce(len({_WORDS.format('text')}) * 2, 0) + 20) OVER (PARTITION BY query_id ORDER BY new) AS running FROM {{rows}})"""
_BM25_CHUNKS = _SEARCH["bm25_topk"].replace("SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents", "SELECT chunk_id AS doc_id, regexp_extract_all(lower(coalesce(raw_content, '')), '[\\p{L}\\p{N}_]+') AS t FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)").replace("rank <= 5", "rank <= 20")
_REL = """, rel AS (SELECT DISTINCT q.id AS query_id, c.chunk_id AS item_id FROM p q JOIN p c ON q.doc_id = c.doc_id WHERE q.id % 100 = 0 AND c.chunk_id IS NOT NULL)"""
_ELEMENTS = f"""{_C}, e AS (SELECT chunk_id, raw_content, len(list_filter(coalesce(obligations, []), lambda x: NOT contains(lower(coalesce(raw_content, '')), lower(x)))) AS missing,
  CASE WHEN len(coalesce(elements, [])) > 0 THEN len(list_filter(elements, lambda x: contains(lower(coalesce(raw_content, '')), lower(x)))) / len(elements) ELSE 1 END::DOUBLE AS r FROM c),
v AS (SELECT chunk_id, coalesce(raw_content, '') = '' AS failed, missing = 0 AND r >= 0.5 AS passes, round(r, 6) AS r FROM e)"""
SQL = {
    "fast_query": _hits_sql(15) + ", " + _PACK.replace("{rows}", "rr WHERE new <= 5") + """ SELECT query_id, count(*)::INT AS n_rows, md5(string_agg('[' || chunk_id || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY new)) AS context_hash FROM k WHERE running <= 6000 GROUP BY query_id""",
    "rerank_and_pack": _hits_sql(8) + ", " + _PACK.replace("{rows}", "rr") + """, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM k WHERE running <= 6000)
SELECT query_id, chunk_id, score, new AS rank, (CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END + 1)::BIGINT AS position FROM i""",
    "prefiltered_search": _hits_sql(15) + """ SELECT query_id, chunk_id, rank FROM h WHERE doc_id IS NULL OR doc_id NOT IN (SELECT document_id FROM canonical_metadata WHERE coalesce(nullif(jurisdiction_id, ''), 'XN-AR') <> 'XN-AR' AND document_id IS NOT NULL)""",
    "global_dense": "WITH " + _POINTS + """, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point) AS rank FROM sims WHERE collection = 'primary_v2'),
c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks), v AS (SELECT DISTINCT ON (point_no) point_no, chunk_id FROM vector_points)
SELECT g.query_id, g.rank, g.s AS score, v.chunk_id, md5(coalesce(c.raw_content, '')) AS text_hash FROM g JOIN v ON v.point_no = g.point LEFT JOIN c ON c.chunk_id = v.chunk_id WHERE rank <= 20""",
    "candidate_rows": f"""WITH {_C} SELECT chunk_id, 0.0::DOUBLE AS score, '' AS source_path, md5(coalesce(nullif(expanded_content, ''), nullif(raw_content, ''), '')) AS content_hash,
  '{{"doc_id":' || to_json(coalesce(doc_id, '')) || ',"document_type":' || to_json(coalesce(document_type, '')) || '}}' AS metadata FROM c""",
    "candidate_back": f"WITH {_C} SELECT chunk_id, coalesce(doc_id, '') AS doc_id, coalesce(document_type, '') AS document_type, 0.0::DOUBLE AS relevance, md5(coalesce(nullif(expanded_content, ''), nullif(raw_content, ''), '')) AS text_hash FROM c",
    "complexity_resolved": f"""WITH w AS (SELECT item_id, {_WORDS.format('text')} AS w, regexp_matches(lower(text), 'compare|differences|versus|vs|similarities|conflict|contradict|supersede|reconcile|summarize across') AS m FROM eval_items),
k AS (SELECT *, len(w) > 20 AND len(list_filter(w, lambda x: x IN ('and', 'or', 'but', 'however', 'although', 'unless', 'except'))) >= 3 AS long FROM w)
SELECT item_id, CASE WHEN len(w) <= 5 THEN 'SIMPLE' WHEN m OR long THEN 'COMPLEX' ELSE 'SIMPLE' END AS complexity, CASE WHEN len(w) <= 5 THEN 0.95 WHEN m THEN 0.9 WHEN long THEN 0.85 ELSE 0.1 END::DOUBLE AS confidence FROM k""",
    "citation_judged": f"""WITH {_C}, w AS (SELECT x.pqac_id, list_distinct({_WORDS.format("coalesce(x.text_span, '')")}) AS a, list_distinct({_WORDS.format("coalesce(c.raw_content, '')")}) AS b FROM citation_references x JOIN c ON lower(trim(x.chunk_id)) = c.chunk_id),
s AS (SELECT pqac_id, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0 END::DOUBLE AS s FROM w)
SELECT DISTINCT pqac_id, CASE WHEN s > 0.5 THEN 'valid' ELSE 'invalid' END AS verdict FROM s""",
    "grounded_accuracy": f"""WITH {_C}, x AS (SELECT DISTINCT pqac_id, document_id, trim(chunk_id) AS chunk_id FROM citation_references WHERE document_id IS NOT NULL),
p AS (SELECT x.document_id, round(count(c.chunk_id) / count(*), 6) AS precision FROM x LEFT JOIN c ON x.chunk_id = c.chunk_id GROUP BY 1), j AS (SELECT document_id, bool_or(status = 'COMPLETED') AS ok FROM ingestion_jobs GROUP BY 1)
SELECT p.document_id, precision, coalesce(ok, false) AS correct, coalesce(ok, false) AND precision >= 0.95 AS accurate FROM p LEFT JOIN j ON p.document_id = j.document_id""",
    "element_filter_open": f"WITH {_ELEMENTS} SELECT chunk_id, CASE WHEN NOT failed THEN r END AS ratio FROM v WHERE failed OR passes",
    "element_telemetry": f"WITH {_ELEMENTS} SELECT CASE WHEN failed THEN 'error' WHEN passes THEN 'passed' ELSE 'dropped' END AS status, count(*) AS n FROM v GROUP BY 1",
    "path_recall": "WITH " + _POINTS + _REL + """, f AS (SELECT path, query_id, count(DISTINCT item_id) AS n FROM lists JOIN rel USING (query_id, item_id) GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
a AS (SELECT path, query_id FROM (SELECT DISTINCT path FROM lists), (SELECT DISTINCT query_id FROM lists)), r AS (SELECT path, query_id, CASE WHEN n.n IS NULL THEN 1 ELSE coalesce(f.n, 0) / n.n END::DOUBLE AS r FROM a LEFT JOIN n USING (query_id) LEFT JOIN f USING (path, query_id))
SELECT path, round(avg(r), 6) AS recall, round(avg(r), 6) >= 0.8 AS passes FROM r GROUP BY path""",
    "fused_gate": "WITH " + _POINTS + _REL + """, u AS (SELECT query_id, path, rank, item_id FROM lists UNION ALL SELECT query_id, 'FUSED', rank, item_id FROM ranked), q AS (SELECT DISTINCT query_id FROM u),
b AS (SELECT path, query_id, min(rank) AS r FROM u JOIN rel USING (query_id, item_id) GROUP BY ALL), m AS (SELECT path, round(sum(1.0::DOUBLE / r) / (SELECT count(*) FROM q), 6) AS mrr FROM b GROUP BY path),
a AS (SELECT path, coalesce(mrr, 0) AS mrr FROM (SELECT DISTINCT path FROM u) LEFT JOIN m USING (path))
SELECT path, mrr, (SELECT mrr FROM a WHERE path = 'FUSED') >= (SELECT max(mrr) FROM a WHERE path <> 'FUSED') AS improves FROM a""",
    "failure_text": "WITH r AS (" + _DOCUMENTS["failure_report"] + ") SELECT category || ': ' || printf('%.1f', share * 100) || '%' AS line FROM r",
    "answer_tokens": _hits_sql(15) + """, t AS (SELECT query_id, list_filter(string_split_regex(substr(coalesce(text, ''), 1, 200) || ' [' || chunk_id || ']', '\\s+'), lambda x: x <> '') AS w FROM rr WHERE new = 1)
SELECT query_id, unnest(range(len(w)))::INT AS seq, unnest(w) AS token FROM t""",
}
