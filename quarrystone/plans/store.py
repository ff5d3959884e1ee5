"""Queries of the store: elements, chunks, indexes, upserts, lookups, cache, settings; with their SQL."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Service
from ..operators import retrieval, upserts, windows
from ..session import cut_lineage
from ..sources import elements, index, registries, schemas
from ..sources.tables import table
from .documents import _C, chunk_rows, chunks
from .jobs import _folder
from .search import SQL as _SEARCH
from .search import points


def text_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of texts: a form feed is a change of page, a blank line ends an element."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "p"))
    e = d.select("doc_id", F.col("page") + 1, F.posexplode(F.split("p", r"\n[ \t\r]*\n")).alias("pos", "text")).toDF("doc_id", "page", "pos", "text")
    return e.filter(F.col("text").rlike(r"\S")).select("doc_id", "page", "pos", F.md5("text").alias("text_hash"))


def file_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files and read back through the parser provider."""
    path = _folder(spark, "files")
    table(spark, sf, "documents").filter(F.col("text").rlike(r"\S") & (F.col("doc_id") % 100 == 0)).select(F.regexp_replace("text", "[\n\r]+", " ").alias("value")).repartition(4).write.text(path)
    e = elements.read_elements(spark, path, glob="*.txt")
    return e.groupBy("page_num").agg((F.count("*") > 0).alias("any"))


def semantic_chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Semantic chunks of the chunks that have a vector, at 0.85 and at changes of page."""
    v = points(spark, sf).filter("chunk_id <> ''").groupBy("chunk_id").agg(F.min_by("vec", "id").alias("vec"))
    e = v.join(chunks(spark, sf, "doc_id", "split_idx", "raw_content", "bounding_box", F.coalesce(F.col("page_num").cast("long"), F.lit(0)).alias("page")), "chunk_id")
    t = windows.chunk_texts(e, "doc_id", "split_idx", "raw_content", "page", "bounding_box", "vec")
    return t.select("doc_id", "chunk_no", "n", "page", F.md5("text").alias("text_hash"), "x0", "y0", "x1", "y1")


def feature_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Parties and obligations of a chunk by position; the shorter list is filled up with nulls."""
    none = F.array().cast("array<string>")
    c = chunk_rows(spark, sf, F.coalesce("parties", none).alias("party"), F.coalesce("obligations", none).alias("obligation")).distinct()
    return c.select("chunk_id", F.posexplode(F.arrays_zip("party", "obligation")).alias("pos", "z")).select("chunk_id", "pos", "z.party", "z.obligation")


def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over a stored index, written in two steps of which the second corrects the first; only the folders of the
    queries' terms are read."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    path = _folder(spark, "postings")
    index.write_postings(d.filter("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 3 == 1, F.col("text")).otherwise("to be corrected")), path)
    index.upsert_postings(d.filter("id % 3 <> 1"), path)
    q = cut_lineage(retrieval.query_terms(table(spark, sf, "eval_items").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("id"), "text")))
    p = index.read_postings(spark, path, [r.term for r in q.select("term").distinct().collect()])
    s = spark.read.parquet(path).groupBy("item_id").agg(F.first("length").alias("length")).agg(F.sum("length").alias("words")).first()
    n = d.count()
    return retrieval.bm25_scores(q, p, n, (s.words or 0) / n if n else None)


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Points written and overwritten by id: the later write has the last word."""
    path = _folder(spark, "vectors")
    v = points(spark, sf).select("id", "vec", "doc_id")
    index.upsert_vectors(v.filter("id % 2 = 0").withColumn("doc_id", F.lit("old")), path)
    index.upsert_vectors(v.filter("id % 4 <> 2"), path)
    return spark.read.parquet(path).select("id", "doc_id", F.size("vec").alias("dims"))


def bootstrap_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a new store, made twice: what is there stays."""
    root = _folder(spark, "store")
    schemas.bootstrap(spark, root)
    schemas.bootstrap(spark, root)
    return schemas.described(spark, root)


def settings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(schemas.Settings.of(spark)).items()], "name string, value double")


def document_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The document of every citation: its latest registration that was not deleted; misses stay, without a title."""
    m = upserts.last_wins(table(spark, sf, "document_metadata").filter("deleted_at is null").distinct(), "document_id", "recorded_at", "version", "title", "pdf_url")
    wanted = table(spark, sf, "citation_references").select("document_id").filter("document_id is not null").distinct()
    return wanted.join(m.select("document_id", "title", "version"), "document_id", "left").select("document_id", "title", F.coalesce(F.col("version").cast("long"), F.lit(-1)).alias("version"))


def cache_put_get(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence put into the cache and read back: the last write of a key wins, and after seven days it is gone."""
    path = _folder(spark, "cache")
    c = table(spark, sf, "citation_references").filter("chunk_id is not null").distinct()
    put = c.select("chunk_id", F.md5(F.coalesce("text_span", F.lit(""))).alias("query_hash"), F.col("citation_confidence").alias("score"), F.col("recorded_at").alias("at"), "pqac_id")
    for half in (0, 1):
        put.filter(F.pmod(F.xxhash64("pqac_id"), F.lit(2)) == half).write.mode("append").parquet(path)
    held = upserts.last_wins(spark.read.parquet(path), ["chunk_id", "query_hash"], "at", "pqac_id")
    now = put.agg(F.max("at")).first()[0]
    return upserts.fresh_only(held, "at", F.lit(now).cast("timestamp")).select("chunk_id", "query_hash", "pqac_id")


def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Trust of registered addresses by a file of sources; there is none, so the fallback holds, and a broken one gives nothing."""
    path = "/no/such/folder/trusted.yaml"
    rows = [(k, v, registries.load(path) == {}) for k, v in registries.trusted_sources(path).items()]
    return spark.createDataFrame(rows, "domain string, trust double, no_file boolean")


def service_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions queued twice, one in three of them cancelled, the others moved by events: the state of every job."""
    service = Service(spark, _folder(spark, "service")).start()
    q = table(spark, sf, "eval_items").select(F.col("text").alias("query"), "item_id")
    ids = cut_lineage(service.enqueue(q).join(q, "query"))
    service.enqueue(q)
    service.cancel(ids.filter("item_id % 3 = 0"), "2024-01-01")
    steps = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("RUNNING"), F.lit("COMPLETED"))).otherwise(F.array(F.lit("MAP_PHASE"), F.lit("RUNNING")))
    service.publish(ids.select("job_id", F.posexplode(steps).alias("seq", "state")).withColumn("seq", F.col("seq").cast("long")))
    return service.job_states().join(ids.select("job_id", "item_id"), "job_id").select("item_id", "state")


_FUNCTIONS = [service_jobs, text_elements, file_elements, semantic_chunk_texts, feature_zip, bm25_stored, vector_upsert, bootstrap_tables, settings, document_lookup, cache_put_get, registry_rows]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_COLUMNS = [(t, *c.strip().split(" ")) for t, s in schemas.TABLES.items() for c in s.split(",")]
_SIMPLE = {"long": "bigint"}
SQL = {
    "text_elements": r"""WITH p AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS page, unnest(p) AS p FROM (SELECT doc_id, string_split(text, chr(12)) AS p FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, page, unnest(range(len(e)))::INT AS pos, unnest(e) AS text FROM (SELECT doc_id, page, string_split_regex(p, '\n[ \t\r]*\n') AS e FROM p))
SELECT doc_id, page::INT AS page, pos, md5(text) AS text_hash FROM e WHERE regexp_matches(text, '\S')""",
    "semantic_chunk_texts": f"""WITH {_C}, v AS (SELECT chunk_id, arg_min(vector, point_no) AS vec FROM vector_points WHERE chunk_id <> '' AND len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1),
e AS (SELECT c.doc_id, c.split_idx, c.raw_content, coalesce(c.page_num, 0)::BIGINT AS page, c.bounding_box AS b, v.vec FROM v JOIN c ON c.chunk_id = v.chunk_id WHERE regexp_matches(c.raw_content, '[^\\s\\x{{a0}}]')),
l AS (SELECT *, lag(vec) OVER w AS pv, lag(page) OVER w AS pp FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY split_idx)),
n AS (SELECT *, CASE WHEN pv IS NOT NULL AND (round(list_cosine_similarity(pv::DOUBLE[], vec::DOUBLE[]), 6) < 0.85 OR pp <> page) THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY split_idx))::BIGINT AS chunk_no FROM n)
SELECT doc_id, chunk_no, count(*) AS n, min(page) AS page, md5(string_agg(raw_content, ' ' ORDER BY split_idx)) AS text_hash, min(b[1]) AS x0, min(b[2]) AS y0, max(b[3]) AS x1, max(b[4]) AS y1 FROM g GROUP BY ALL""",
    "feature_zip": f"""WITH {_C}, z AS (SELECT chunk_id, unnest(range(greatest(len(coalesce(parties, [])), len(coalesce(obligations, [])))))::INT AS pos, parties, obligations FROM c)
SELECT chunk_id, pos, parties[pos + 1] AS party, obligations[pos + 1] AS obligation FROM z""",
    "service_jobs": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'COMPLETED' WHEN item_id % 3 = 0 THEN 'CANCELLED' ELSE 'MAP_PHASE' END AS state FROM eval_items",
    "bm25_stored": _SEARCH["bm25_topk"],
    "vector_upsert": """WITH p AS (SELECT DISTINCT point_no AS id, doc_id FROM vector_points WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0)
SELECT id, CASE WHEN id % 4 = 2 THEN 'old' ELSE doc_id END AS doc_id, 64 AS dims FROM p""",
    "bootstrap_tables": f"SELECT * FROM (VALUES {_VALUES((t, c, _SIMPLE.get(k, k)) for t, c, k in _COLUMNS)}) v(table_name, column_name, type)",
    "settings": f"SELECT name, value::DOUBLE AS value FROM (VALUES {_VALUES(asdict(schemas.Settings()).items())}) v(name, value)",
    "document_lookup": """WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY recorded_at DESC NULLS LAST, version DESC NULLS LAST, title DESC NULLS LAST, pdf_url DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM document_metadata WHERE deleted_at IS NULL)) WHERE n = 1)
SELECT w.document_id, m.title, coalesce(m.version, -1)::BIGINT AS version FROM (SELECT DISTINCT document_id FROM citation_references WHERE document_id IS NOT NULL) w LEFT JOIN m ON w.document_id = m.document_id""",
    "cache_put_get": """WITH c AS (SELECT DISTINCT * FROM citation_references WHERE chunk_id IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, md5(coalesce(text_span, '')) ORDER BY recorded_at DESC NULLS LAST, pqac_id DESC) AS n FROM c)
SELECT chunk_id, md5(coalesce(text_span, '')) AS query_hash, pqac_id FROM h WHERE n = 1 AND recorded_at > (SELECT max(recorded_at) FROM c) - INTERVAL 7 DAY""",
    "registry_rows": f"SELECT domain, trust::DOUBLE AS trust, true AS no_file FROM (VALUES {_VALUES(registries.FALLBACK_TRUST.items())}) v(domain, trust)",
}
