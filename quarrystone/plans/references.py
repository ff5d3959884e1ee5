"""Queries of orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import references as R
from ..sources.tables import table


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cited, jobs = table(spark, sf, "citation_references"), table(spark, sf, "ingestion_jobs")
    refs = (
        R.references(cited, "citation_references", "document_id", "pqac_id", "recorded_at", "document")
        .unionByName(R.references(cited, "citation_references", "chunk_id", "pqac_id", "recorded_at", "chunk"))
        .unionByName(R.references(jobs, "ingestion_jobs", "document_id", "job_id", "created_at", "document"))
    )
    valid = R.targets(table(spark, sf, "document_metadata"), "document", "document_id").unionByName(
        R.targets(table(spark, sf, "chunks"), "chunk", "chunk_id")
    )
    return refs, valid


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphans(*_inputs(spark, sf)).select("table_name", "field_name", "record_id").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    refs, valid = _inputs(spark, sf)
    return R.orphan_report(refs, R.orphans(refs, valid))


_SQL = r"""
WITH refs AS (
  SELECT DISTINCT 'citation_references' AS table_name, 'document_id' AS field_name, pqac_id AS record_id, 'document' AS target,
         lower(regexp_replace(document_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS key, recorded_at AS ref_at FROM citation_references
  UNION ALL
  SELECT DISTINCT 'citation_references', 'chunk_id', pqac_id, 'chunk',
         lower(regexp_replace(chunk_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), recorded_at FROM citation_references
  UNION ALL
  SELECT DISTINCT 'ingestion_jobs', 'document_id', job_id, 'document',
         lower(regexp_replace(document_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), created_at FROM ingestion_jobs
), r AS (SELECT * FROM refs WHERE key IS NOT NULL AND key NOT IN ('', 'unknown')),
valid AS (
  SELECT 'document' AS target, lower(regexp_replace(document_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS key, recorded_at, deleted_at FROM document_metadata
  UNION ALL
  SELECT 'chunk', lower(regexp_replace(chunk_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), recorded_at, deleted_at FROM chunks
), orphan AS (
  SELECT * FROM r WHERE NOT EXISTS (
    SELECT 1 FROM valid v WHERE v.target = r.target AND v.key = r.key AND v.recorded_at <= r.ref_at AND (v.deleted_at IS NULL OR v.deleted_at > r.ref_at))
)
"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": _SQL + "SELECT DISTINCT table_name, field_name, record_id FROM orphan",
    "p7_report": _SQL
    + """, c AS (SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_references FROM r GROUP BY ALL),
o AS (SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphan GROUP BY ALL)
SELECT c.table_name, c.field_name, c.month, c.n_references, coalesce(o.n_orphans, 0) AS n_orphans,
       round(coalesce(o.n_orphans, 0) / c.n_references, 6) AS orphan_share
FROM c LEFT JOIN o ON c.table_name = o.table_name AND c.field_name = o.field_name AND c.month IS NOT DISTINCT FROM o.month""",
}
