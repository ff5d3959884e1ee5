"""p1: chunks longer than 1,800 characters in pieces, and the boundaries they are cut at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .splitting import boundary_rows, pieces


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return boundary_rows(table(spark, sf, "chunks")).select("chunk_id", "start_char")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(table(spark, sf, "chunks"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL: dict[str, str] = {}
