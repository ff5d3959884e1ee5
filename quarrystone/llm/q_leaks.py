"""p9: evaluation items leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .leaks import leaks


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).filter("equal_run").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and the number of documents that hold a passage of each."""
    return p9_leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if("equal_run").alias("n_equal"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items}
SQL = {
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
