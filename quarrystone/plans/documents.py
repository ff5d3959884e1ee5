"""Queries over chunks, citations, jobs, documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation, lookup, packing, upserts, windows
from ..sources.tables import table


def chunks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Chunks without repeated rows."""
    return table(spark, sf, "chunks").select("chunk_id", *cols).dropDuplicates(["chunk_id"])


def chunk_rows(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Chunks as they are, for functions of a row, whose small results are made distinct instead."""
    return table(spark, sf, "chunks").select("chunk_id", *cols)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "citation_references").distinct()


# ---------------------------------------------------------------- scalars and elements


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as elements: blank ones dropped, numbered in order, with their content identifiers."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"\S"))
    w = windows.W.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumn("split_idx", (F.row_number().over(w) - 1).cast("long"))
    return d.select("doc_id", "split_idx", S.chunk_id(F.col("doc_id").cast("string"), F.col("split_idx"), F.col("line")).alias("chunk_id"))


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vector_points").select("chunk_id").filter("chunk_id <> ''").distinct()
    return v.select("chunk_id", S.name_uuid(F.col("chunk_id")).alias("point_id"), S.name_uuid(F.concat("chunk_id", F.lit("_hype"))).alias("question_point_id"))


def query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", S.query_hash(F.col("text")).alias("query_hash"))


def complexity_route(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "eval_items").select("text").unionByName(table(spark, sf, "document_metadata").select(F.col("title").alias("text"))).filter("text is not null").distinct()
    return t.withColumn("_c", S.complexity(F.col("text"))).select(F.md5("text").alias("text_hash"), "_c.complexity", "_c.confidence")


def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    """The box around all boxes of a page; chunks without a box do not count."""
    b = lambda i: F.col("bounding_box")[i]
    c = chunks(spark, sf, "doc_id", "page_num", "bounding_box")
    c = c.withColumn("page_num", F.coalesce(F.col("page_num").cast("long"), F.lit(-1)))
    return c.groupBy("doc_id", "page_num").agg(F.min(b(0)).alias("x0"), F.min(b(1)).alias("y0"), F.max(b(2)).alias("x1"), F.max(b(3)).alias("y1"), F.count("*").alias("n_chunks"))


def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of similar vectors within a label; the threshold suits these random vectors."""
    e = windows.semantic_chunks(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", threshold=0.0)
    return e.groupBy("label", "chunk_no").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count("*").alias("n"))


# ---------------------------------------------------------------- lookups


def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    c = lookup.canonical(chunks(spark, sf, "document_type"), "document_type", lookup.alias_table(spark, lookup.DOCUMENT_TYPES))
    return c.select("chunk_id", "canonical_id")


TARGET = {"jurisdiction_id": "XN-AR", "document_type_id": "TYP-NDA", "court_id": "CRT-05"}


def prefilter(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "canonical_metadata").distinct()
    return lookup.keep_unless_different(m, TARGET).select("document_id", *TARGET)


EXTRA_TRUST = {"files.example.org": 0.9, "example.org": 0.7, "example.com": 0.5}


def trust_scores(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "document_metadata").select("pdf_url").filter("pdf_url is not null").distinct()
    return u.select("pdf_url", S.authority(F.col("pdf_url")).alias("domain"), lookup.trust(F.col("pdf_url"), lookup.TRUSTED | EXTRA_TRUST).alias("trust"))


def web_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The three best addresses of each kind of document by trust and freshness."""
    m = table(spark, sf, "document_metadata").select("document_id", "pdf_url", "version").filter("pdf_url is not null and version is not null").distinct()
    unit = F.element_at(F.array(F.lit(" days"), F.lit(" months"), F.lit(" years")), (F.col("version") % 3 + 1).cast("int"))
    m = m.withColumn("kind", F.substring("document_id", 1, 3)).withColumn("age", F.concat(F.col("version").cast("string"), unit))
    score = F.round(0.8 * lookup.trust(F.col("pdf_url"), lookup.TRUSTED | EXTRA_TRUST) * S.freshness(F.col("age")), 6)
    w = windows.W.partitionBy("kind").orderBy(F.desc("score"), "pdf_url", "document_id", "version")
    return m.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("kind", "document_id", "pdf_url", "age", "score", "rank")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).select("pqac_id", "text_span", F.lower(F.trim("chunk_id")).alias("k"), "citation_confidence")
    return c.join(chunks(spark, sf, "raw_content").select(F.col("chunk_id").alias("k"), "raw_content"), "k")


def citation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Word overlap of cited spans and their chunks; a citation without a confidence counts as judged too late."""
    v = _cited(spark, sf).withColumn("_v", lookup.citation_verdict(F.col("text_span"), F.col("raw_content"), F.col("citation_confidence").isNull()))
    return v.select("pqac_id", "_v.similarity", "_v.verdict", "_v.span")


def element_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(spark, sf, "raw_content", "obligations", "elements")
    c = c.withColumn("_e", lookup.satisfied_elements(F.col("raw_content"), F.col("obligations"), F.col("elements")))
    return c.select("chunk_id", "_e.missing", "_e.ratio", "_e.passes").distinct()


def citation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with defaults for what is missing: version 1, no hash, confidence 0.95, zeros counting as missing."""
    c = citations(spark, sf)
    return c.select(
        "pqac_id",
        F.coalesce(F.nullif("document_version", F.lit(0)), F.lit(1)).cast("long").alias("document_version"),
        F.coalesce("document_hash", F.lit("")).alias("document_hash"),
        F.coalesce(F.nullif("citation_confidence", F.lit(0.0)), F.lit(0.95)).alias("citation_confidence"),
    )


def evidence_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """Points with the evidence that is kept for their chunk; misses are marked and would be computed."""
    cache = citations(spark, sf).groupBy(F.trim("chunk_id").alias("chunk_id")).agg(F.max("citation_confidence").alias("score"))
    v = table(spark, sf, "vector_points").select("point_no", "chunk_id").distinct()
    j = v.join(cache.withColumn("hit", F.lit(True)), "chunk_id", "left")
    return j.select("point_no", "chunk_id", F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("hit", F.lit(False)).alias("hit"))


def map_success_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of documents of which at least 0.6 of the jobs succeeded."""
    j = table(spark, sf, "ingestion_jobs").distinct().filter("document_id is not null")
    w = windows.W.partitionBy("document_id")
    j = j.withColumn("success", F.round(F.avg(F.when(F.col("status") == "COMPLETED", 1.0).otherwise(0.0)).over(w), 6))
    return j.filter("success >= 0.6").select("job_id", "document_id", "success")


# ---------------------------------------------------------------- packing


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc_id", "split_idx", "raw_content")
    return c.withColumn("rank", F.col("split_idx"))


def pack_budget(spark: SparkSession, sf: str) -> DataFrame:
    return packing.prefix_pack(_ranked(spark, sf), "doc_id", "rank", S.token_estimate(F.col("raw_content"))).select("doc_id", "chunk_id", F.col("running").cast("long").alias("running"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.prefix_pack(_ranked(spark, sf), "doc_id", "rank", S.token_estimate(F.col("raw_content")))


def edge_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return packing.interleave(_packed(spark, sf), "doc_id", "rank").select("chunk_id", "doc_id", "position")


def center_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return packing.interleave(_packed(spark, sf), "doc_id", "rank", "center").select("chunk_id", "doc_id", "position")


def _by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by document type, the longest first: the rank is a value of the row, so no type is numbered in one task."""
    c = chunks(spark, sf, "doc_id", "document_type", "raw_content").withColumn("query_id", F.coalesce(F.lower(F.trim("document_type")), F.lit("")))
    rank = F.struct((-F.coalesce(F.length("raw_content"), F.lit(0))).alias("l"), F.col("chunk_id").alias("c"))
    return c.withColumn("rank", rank).withColumnRenamed("raw_content", "text")


def diversity_topn(spark: SparkSession, sf: str) -> DataFrame:
    return packing.per_document(_by_type(spark, sf), "query_id", "doc_id", "rank").select("query_id", "doc_id", "chunk_id")


def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    a = packing.assemble(_by_type(spark, sf))
    return a.select("query_id", "n_rows", F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("context").alias("context_hash"), F.size("context_map").alias("n_keys"))


def neighbor_expand(spark: SparkSession, sf: str) -> DataFrame:
    n = windows.with_neighbours(chunks(spark, sf, "doc_id", "split_idx", "raw_content"), "doc_id", "split_idx", "raw_content", "chunk_id")
    return n.select("chunk_id", "n_parts", F.md5("window_text").alias("window_hash"))


# ---------------------------------------------------------------- reports and writes


def citation_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a document's citations whose chunk exists, and whether it reaches the grounding bound."""
    c = citations(spark, sf).select("pqac_id", "document_id", F.trim("chunk_id").alias("chunk_id")).distinct()
    ok = c.join(chunks(spark, sf).withColumn("ok", F.lit(1)), "chunk_id", "left")
    p = ok.groupBy("document_id").agg(F.count("*").alias("n"), F.round(F.count("ok") / F.count("*"), 6).alias("precision"))
    return p.withColumn("grounded", F.col("precision") >= 0.95)


def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "ingestion_jobs").distinct()
    m = table(spark, sf, "document_metadata").select("document_id", F.lit(True).alias("there")).distinct()
    j = j.join(m, "document_id", "left")
    cat = S.failure_category(F.col("error_message").isNotNull(), F.coalesce("there", F.lit(False)), F.coalesce("retry_count", F.lit(0)) > 0, F.col("status") == "COMPLETED", F.when(F.coalesce("retry_count", F.lit(0)) > 1, 0.9).otherwise(1.0))
    return evaluation.category_shares(j.select(cat.alias("category")), "category")


def citation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier citations merged with corrected ones: three columns keep their old values."""
    c = upserts.last_wins(citations(spark, sf), "pqac_id", "recorded_at", "document_id", "chunk_id")
    old = c.select("pqac_id", "document_id", "document_version", "document_hash", "page", "chunk_id", "citation_confidence")
    new = old.filter("page % 2 = 0").select("pqac_id", "document_id", (F.col("document_version") + 1).alias("document_version"), F.lit("x").alias("document_hash"), (F.col("page") + 1000).alias("page"), F.upper("chunk_id").alias("chunk_id"), F.lit(0.0).alias("citation_confidence"))
    u = upserts.partial_upsert(old, new, "pqac_id", upserts.CITATION_KEEPS)
    return u.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("document_version", "page")})


def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "ingestion_jobs").select("job_id", "document_id", "status").distinct()
    return upserts.insert_if_absent(j.filter("status = 'COMPLETED'"), j.withColumn("status", F.lit("QUEUED")), "job_id")


def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata").distinct()
    return upserts.last_wins(m, "document_id", "recorded_at", "version").select("document_id", "version", F.unix_micros("recorded_at").alias("recorded_us"))


def cache_fresh(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    now = c.agg(F.max("recorded_at")).first()[0]
    return upserts.fresh_only(c, "recorded_at", F.lit(now).cast("timestamp")).select("pqac_id", F.unix_micros("recorded_at").alias("recorded_us"))


# ---------------------------------------------------------------- events as jobs


def job_last_state(spark: SparkSession, sf: str) -> DataFrame:
    """Fold of state events: first start, last state, number of errors."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"),
        F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("started_at"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
    )


def job_retries_dlq(spark: SparkSession, sf: str) -> DataFrame:
    """Every third and later error of a job goes to the dead letters; earlier ones wait ever longer."""
    w = windows.W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").filter("event_type = 'error'").withColumn("attempt", F.row_number().over(w))
    dead = F.col("attempt") >= 3
    return e.select("event_id", F.col("user_id").alias("job_id"), F.col("attempt").cast("long").alias("attempt"), F.when(dead, "dlq").otherwise("retry").alias("to"), F.when(~dead, S.backoff_seconds(F.col("attempt"))).otherwise(0).alias("wait_s"))


def job_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The event at which a job's running sum of value passes 500."""
    e = table(spark, sf, "events").filter("value is not null").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return windows.first_over(e, "user_id", ["ts", "event_id"], F.col("cents"), 50_000).select(F.col("user_id").alias("job_id"), "event_id", "running")


def sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", S.sse_frame(F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("status"), F.struct(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"))).alias("frame"))


def payload_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose payload parses and has its key; the others are dropped."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.filter("p.k is not null").select("event_id", F.col("p.k").alias("k"))


def token_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with their citation marker and an invented one: markers of chunks that do not exist are taken out."""
    c = citations(spark, sf).select("pqac_id", "text_span", F.lower(F.trim("chunk_id")).alias("chunk_id"))
    known = chunks(spark, sf).withColumn("ok", F.lit(True))
    j = c.join(known, "chunk_id", "left")
    text = F.concat_ws(" ", F.col("text_span"), F.col("chunk_id"), F.lit("pqac-00000000-0000-0000-0000-000000000000"), F.lit("end"))
    return j.select("pqac_id", S.keep_known_markers(text, F.when(F.col("ok"), F.array("chunk_id")).otherwise(F.array().cast("array<string>"))).alias("text"))


def citation_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Citations flattened by document: the first chunk or unknown, and all of them joined."""
    c = citations(spark, sf).filter("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    return c.select("document_id", F.coalesce(F.try_element_at("ids", F.lit(1)), F.lit("unknown")).alias("chunk_id"), F.array_join("ids", ", ").alias("source"))


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_UUID = lambda x: f"""(substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 1, 8) || '-' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 9, 4) || '-5' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 14, 3) || '-' || translate(substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 18, 3) || '-' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x})), 21, 12))"""
_WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> '')"
_TRUST = "CASE " + " ".join(f"WHEN d = '{k}' OR ends_with(d, '.{k}') THEN {v}" for k, v in (lookup.TRUSTED | EXTRA_TRUST).items()) + " ELSE 0.2 END::DOUBLE"
_DOMAIN = r"regexp_replace(lower(regexp_extract(pdf_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '')"
_CASES = " ".join(f"WHEN '{a}' THEN '{k}'" for k, names in lookup.DOCUMENT_TYPES.items() for a in names)
_TYPED = _C + """, t AS (
  SELECT coalesce(lower(trim(document_type)), '') AS query_id, chunk_id, doc_id, raw_content AS text,
         row_number() OVER (PARTITION BY coalesce(lower(trim(document_type)), '') ORDER BY coalesce(length(raw_content), 0) DESC, chunk_id) AS rank FROM c
), dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS n FROM t) WHERE n <= 3)"""
_POS = _C + f""", k AS (SELECT chunk_id, doc_id, split_idx, sum(coalesce(len({_WORDS.format('raw_content')}) * 2, 0) + 20) OVER (PARTITION BY doc_id ORDER BY split_idx) AS running FROM c),
r AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY split_idx) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM k WHERE running <= 6000)"""

_FUNCTIONS = [
    chunk_lines, point_ids, query_hash, complexity_route, bbox_union, semantic_chunks, canonicalize, prefilter, trust_scores, web_topn, citation_verdicts, element_filter, citation_lookup, evidence_cache_join, map_success_gate,
    pack_budget, edge_interleave, center_interleave, diversity_topn, assemble_context, neighbor_expand, citation_precision, failure_report, citation_upsert, insert_if_absent, upsert_last_wins, cache_fresh,
    job_last_state, job_retries_dlq, job_budget, sse_frames, payload_filter, token_filter, citation_groups,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
SQL = {
    "chunk_lines": r"""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS split_idx, line FROM l WHERE regexp_matches(line, '\S'))
SELECT doc_id, split_idx, 'pqac-' || """ + _UUID("sha256(doc_id || '|' || split_idx || '|' || line)") + " AS chunk_id FROM n",
    "point_ids": f"SELECT chunk_id, {_UUID('chunk_id')} AS point_id, {_UUID(chr(39).join(['chunk_id || ', '_hype', '']))} AS question_point_id FROM (SELECT DISTINCT chunk_id FROM vector_points WHERE chunk_id <> '')",
    "query_hash": "SELECT item_id, md5(lower(text)) AS query_hash FROM eval_items",
    "complexity_route": f"""WITH t AS (SELECT DISTINCT text FROM (SELECT text FROM eval_items UNION ALL SELECT title FROM document_metadata) WHERE text IS NOT NULL),
w AS (SELECT text, {_WORDS.format('text')} AS w, regexp_matches(lower(text), 'compare|differences|versus|vs|similarities|conflict|contradict|supersede|reconcile|summarize across') AS m FROM t),
k AS (SELECT *, len(w) > 20 AND len(list_filter(w, lambda x: x IN ('and', 'or', 'but', 'however', 'although', 'unless', 'except'))) >= 3 AS long FROM w)
SELECT md5(text) AS text_hash, CASE WHEN len(w) <= 5 THEN 'SIMPLE' WHEN m OR long THEN 'COMPLEX' ELSE 'ESCALATE' END AS complexity,
       CASE WHEN len(w) <= 5 THEN 0.95 WHEN m THEN 0.9 WHEN long THEN 0.85 ELSE 0 END::DOUBLE AS confidence FROM k""",
    "bbox_union": f"WITH {_C} SELECT doc_id, coalesce(page_num, -1)::BIGINT AS page_num, min(bounding_box[1]) AS x0, min(bounding_box[2]) AS y0, max(bounding_box[3]) AS x1, max(bounding_box[4]) AS y1, count(*) AS n_chunks FROM c GROUP BY doc_id, coalesce(page_num, -1)",
    "semantic_chunks": """WITH l AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
b AS (SELECT label, vec_id, CASE WHEN p IS NOT NULL AND round(list_cosine_similarity(p::DOUBLE[], embedding::DOUBLE[]), 6) < 0 THEN 1 ELSE 0 END AS b FROM l),
g AS (SELECT label, vec_id, (sum(b) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS chunk_no FROM b)
SELECT label, chunk_no, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM g GROUP BY ALL""",
    "canonicalize": f"WITH {_C} SELECT chunk_id, CASE lower(trim(document_type)) {_CASES} END AS canonical_id FROM c",
    "prefilter": "SELECT DISTINCT document_id, jurisdiction_id, document_type_id, court_id FROM canonical_metadata WHERE " + " AND ".join(f"coalesce(nullif({k}, ''), '{v}') = '{v}'" for k, v in TARGET.items()),
    "trust_scores": f"SELECT pdf_url, d AS domain, {_TRUST} AS trust FROM (SELECT DISTINCT pdf_url, {_DOMAIN} AS d FROM document_metadata WHERE pdf_url IS NOT NULL)",
    "web_topn": f"""WITH m AS (SELECT DISTINCT document_id, pdf_url, version, {_DOMAIN} AS d FROM document_metadata WHERE pdf_url IS NOT NULL AND version IS NOT NULL),
s AS (SELECT *, substr(document_id, 1, 3) AS kind, version || CASE version % 3 WHEN 0 THEN ' days' WHEN 1 THEN ' months' ELSE ' years' END AS age,
  round(0.8::DOUBLE * {_TRUST} * CASE version % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END::DOUBLE, 6) AS score FROM m)
SELECT kind, document_id, pdf_url, age, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, pdf_url, document_id, version) AS rank FROM s) WHERE rank <= 3""",
    "citation_verdicts": f"""WITH {_C}, j AS (SELECT DISTINCT x.pqac_id, x.text_span, x.recorded_at, x.document_id, x.citation_confidence, x.document_version, x.document_hash, x.page, x.x0, x.y0, x.x1, x.y1, x.chunk_id, c.raw_content FROM citation_references x JOIN c ON lower(trim(x.chunk_id)) = c.chunk_id),
w AS (SELECT *, list_distinct({_WORDS.format("coalesce(text_span, '')")}) AS a, list_distinct({_WORDS.format("coalesce(raw_content, '')")}) AS b FROM j),
s AS (SELECT *, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0 END::DOUBLE AS s FROM w)
SELECT pqac_id, s AS similarity, CASE WHEN citation_confidence IS NULL THEN CASE WHEN s > 0.5 THEN 'valid' ELSE 'invalid' END WHEN s > 0.8 THEN 'valid' ELSE 'judge' END AS verdict,
       CASE WHEN citation_confidence IS NOT NULL AND s > 0.8 THEN substr(raw_content, 1, 100) END AS span FROM s""",
    "element_filter": f"""WITH {_C}, e AS (SELECT chunk_id, len(list_filter(coalesce(obligations, []), lambda x: NOT contains(lower(coalesce(raw_content, '')), lower(x)))) AS missing,
  CASE WHEN len(coalesce(elements, [])) > 0 THEN len(list_filter(elements, lambda x: contains(lower(coalesce(raw_content, '')), lower(x)))) / len(elements) ELSE 1 END::DOUBLE AS r FROM c)
SELECT chunk_id, missing, round(r, 6) AS ratio, missing = 0 AND r >= 0.5 AS passes FROM e""",
    "citation_lookup": """SELECT pqac_id, coalesce(nullif(document_version, 0), 1)::BIGINT AS document_version, coalesce(document_hash, '') AS document_hash,
  coalesce(nullif(citation_confidence, 0), 0.95)::DOUBLE AS citation_confidence FROM (SELECT DISTINCT * FROM citation_references)""",
    "evidence_cache_join": """WITH k AS (SELECT trim(chunk_id) AS chunk_id, max(citation_confidence) AS score FROM citation_references GROUP BY 1)
SELECT v.point_no, v.chunk_id, coalesce(k.score, 0.5)::DOUBLE AS score, k.chunk_id IS NOT NULL AS hit FROM (SELECT DISTINCT point_no, chunk_id FROM vector_points) v LEFT JOIN k ON v.chunk_id = k.chunk_id""",
    "map_success_gate": """SELECT job_id, document_id, success FROM (SELECT *, round(avg(CASE WHEN status = 'COMPLETED' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY document_id), 6) AS success
FROM (SELECT DISTINCT * FROM ingestion_jobs WHERE document_id IS NOT NULL)) WHERE success >= 0.6""",
    "pack_budget": f"""WITH {_C}, r AS (SELECT doc_id, chunk_id, (sum(coalesce(len({_WORDS.format('raw_content')}) * 2, 0) + 20) OVER (PARTITION BY doc_id ORDER BY split_idx))::BIGINT AS running FROM c)
SELECT * FROM r WHERE running <= 6000""",
    "edge_interleave": f"WITH {_POS} SELECT chunk_id, doc_id, (CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END + 1)::BIGINT AS position FROM r",
    "center_interleave": f"WITH {_POS} SELECT chunk_id, doc_id, (CASE WHEN i % 2 = 0 THEN (n + 1) // 2 - 1 - i // 2 ELSE (n + 1) // 2 + (i - 1) // 2 END + 1)::BIGINT AS position FROM r",
    "diversity_topn": f"WITH {_TYPED} SELECT query_id, doc_id, chunk_id FROM dv",
    "assemble_context": f"""WITH {_TYPED}, l AS (SELECT *, '[' || substr(chunk_id, 1, 13) || '] ' || coalesce(text, '') AS line FROM dv),
s AS (SELECT *, (sum(len({_WORDS.format('line')}) * 2) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS running FROM l)
SELECT query_id, count(*) AS n_rows, count(*)::INT AS n_keys, max(running) AS n_tokens, md5(string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM s WHERE running <= 20400 GROUP BY query_id""",
    "neighbor_expand": f"""WITH {_C} SELECT a.chunk_id, count(*) AS n_parts, md5(coalesce(string_agg(b.raw_content, chr(10) || chr(10) ORDER BY b.split_idx), '')) AS window_hash
FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.split_idx BETWEEN a.split_idx - 1 AND a.split_idx + 1 GROUP BY a.chunk_id""",
    "citation_precision": f"""WITH {_C}, x AS (SELECT DISTINCT pqac_id, document_id, trim(chunk_id) AS chunk_id FROM citation_references),
p AS (SELECT x.document_id, count(*) AS n, round(count(c.chunk_id) / count(*), 6) AS precision FROM x LEFT JOIN c ON x.chunk_id = c.chunk_id GROUP BY x.document_id)
SELECT *, precision >= 0.95 AS grounded FROM p""",
    "failure_report": """WITH j AS (SELECT DISTINCT * FROM ingestion_jobs), k AS (
  SELECT CASE WHEN error_message IS NOT NULL THEN 'GENERATION' WHEN document_id IS NULL OR document_id NOT IN (SELECT document_id FROM document_metadata WHERE document_id IS NOT NULL) THEN CASE WHEN coalesce(retry_count, 0) > 0 THEN 'CRAG' ELSE 'RETRIEVAL' END
    WHEN status <> 'COMPLETED' THEN 'REASONING' WHEN coalesce(retry_count, 0) > 1 THEN 'CITATION' ELSE 'SUCCESS' END AS category FROM j)
SELECT v.category, count(k.category) AS n, round(count(k.category) / (SELECT count(*) FROM k), 6) AS share FROM (SELECT unnest(['RETRIEVAL','CITATION','REASONING','GENERATION','CRAG','SUCCESS']) AS category) v LEFT JOIN k ON k.category = v.category GROUP BY v.category""",
    "citation_upsert": """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pqac_id ORDER BY recorded_at DESC NULLS LAST, document_id DESC NULLS LAST, chunk_id DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM citation_references)) WHERE n = 1)
SELECT pqac_id, document_id, coalesce(document_version, -1)::BIGINT AS document_version, document_hash, coalesce(CASE WHEN page % 2 = 0 THEN page + 1000 ELSE page END, -1)::BIGINT AS page, CASE WHEN page % 2 = 0 THEN upper(chunk_id) ELSE chunk_id END AS chunk_id, citation_confidence FROM d""",
    "insert_if_absent": "SELECT DISTINCT job_id, document_id, CASE WHEN status = 'COMPLETED' THEN status ELSE 'QUEUED' END AS status FROM ingestion_jobs",
    "upsert_last_wins": "SELECT document_id, version, epoch_us(recorded_at) AS recorded_us FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY recorded_at DESC, version DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM document_metadata)) WHERE n = 1",
    "cache_fresh": "SELECT DISTINCT pqac_id, epoch_us(recorded_at) AS recorded_us FROM citation_references WHERE recorded_at > (SELECT max(recorded_at) FROM citation_references) - INTERVAL 7 DAY",
    "job_last_state": "SELECT user_id AS job_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS state, min(ts) FILTER (event_type = 'view') AS started_at, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id",
    "job_retries_dlq": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
SELECT event_id, user_id AS job_id, attempt, CASE WHEN attempt >= 3 THEN 'dlq' ELSE 'retry' END AS "to", CASE WHEN attempt < 3 THEN (10 * pow(3, attempt - 1))::BIGINT ELSE 0 END AS wait_s FROM e""",
    "job_budget": """WITH r AS (SELECT user_id, event_id, ts, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM events WHERE value IS NOT NULL)
SELECT user_id AS job_id, event_id, running FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r WHERE running > 50000) WHERE n = 1""",
    "sse_frames": """SELECT event_id, 'event: ' || CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'status' END || chr(10) || 'data: {"job_id":' || user_id || ',"state":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events""",
    "payload_filter": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE json_valid(props) AND (props->>'k') IS NOT NULL",
    "token_filter": """WITH k AS (SELECT DISTINCT chunk_id FROM chunks), x AS (SELECT DISTINCT * FROM citation_references)
SELECT x.pqac_id, replace(concat_ws(' ', x.text_span, CASE WHEN k.chunk_id IS NULL THEN regexp_replace(lower(trim(x.chunk_id)), 'pqac-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '', 'g') ELSE k.chunk_id END, '', 'end'), '  ', '  ') AS text
FROM x LEFT JOIN k ON lower(trim(x.chunk_id)) = k.chunk_id""",
    "citation_groups": """SELECT document_id, coalesce(ids[1], 'unknown') AS chunk_id, array_to_string(ids, ', ') AS source FROM (SELECT document_id, coalesce(list_sort(list_distinct(list(chunk_id) FILTER (chunk_id IS NOT NULL))), []) AS ids FROM citation_references WHERE document_id IS NOT NULL GROUP BY 1)""",
}
