"""p2: noise of scanned pages in chunks, and the repaired texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .scans import line_marks, ordinary_words, repair, word_counts


def _marks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "chunks")
    words = ordinary_words(word_counts(c, "doc_id", "raw_content"))
    return c, line_marks(c, spark.sparkContext.broadcast(words))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marks(spark, sf)[1].select("chunk_id", "line_no", "noise").distinct()


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    return repair(*_marks(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL: dict[str, str] = {}
