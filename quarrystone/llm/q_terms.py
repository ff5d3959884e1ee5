"""p5: term frequencies of document types and jurisdictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .terms import record_totals, term_counts, term_rows


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    c, m = table(spark, sf, "chunks"), table(spark, sf, "canonical_metadata")
    rows = term_rows(c, "document_type", "doc_id", c["chunk_id"]).unionByName(
        term_rows(m, "jurisdiction_id", "document_id", F.to_json(F.struct(*[m[x] for x in sorted(m.columns)])))
    )
    totals = record_totals(c, "document_type", "doc_id").unionByName(record_totals(m, "jurisdiction_id", "document_id"))
    return term_counts(rows, totals)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_counts(spark, sf).filter("mark is not null").select("field_name", "term", "mark")


_CTE = r"""
WITH v AS (
  SELECT 'document_type' AS field_name, lower(regexp_replace(document_type, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS term, doc_id AS record
  FROM (SELECT DISTINCT chunk_id, doc_id, document_type FROM chunks)
  UNION ALL
  SELECT 'jurisdiction_id', lower(regexp_replace(jurisdiction_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), document_id
  FROM (SELECT DISTINCT * FROM canonical_metadata)
), n AS (
  SELECT 'document_type' AS field_name, count(DISTINCT doc_id) AS n_all FROM chunks
  UNION ALL SELECT 'jurisdiction_id', count(DISTINCT document_id) FROM canonical_metadata
), c AS (
  SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM v WHERE term <> '' GROUP BY ALL
), r AS (
  SELECT field_name, term, n_occurrences, n_records,
         CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > n_all * 0.2 THEN 'common' END AS mark
  FROM c JOIN n USING (field_name)
)
"""
QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL = {
    "p5_found": _CTE + "SELECT field_name, term, mark FROM r WHERE mark IS NOT NULL",
    "p5_counts": _CTE + "SELECT * FROM r",
}
