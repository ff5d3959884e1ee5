"""p4: near-duplicate chunks, as pairs and as groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .nearcopies import group_rows, pair_rows, similar_classes


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pair_rows(*similar_classes(table(spark, sf, "chunks"))).select("chunk_id_a", "chunk_id_b")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return group_rows(*similar_classes(table(spark, sf, "chunks")))


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with their exact similarity and the share of their words that is aligned."""
    return pair_rows(*similar_classes(table(spark, sf, "chunks"), aligned=True))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p4_pairs": p4_pairs}
SQL: dict[str, str] = {}
