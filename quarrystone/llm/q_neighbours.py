"""p6: the five most similar points of every usable vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .neighbours import neighbours, recall


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(table(spark, sf, "vector_points")).select(F.col("id").alias("point_no"), F.col("other").alias("neighbour"), "similarity", "place")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    n = neighbours(table(spark, sf, "vector_points"))
    return n.select(F.least("id", "other").alias("point_no_a"), F.greatest("id", "other").alias("point_no_b")).distinct()


def p6_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Against brute force, for the points whose number is divisible by 100."""
    v = table(spark, sf, "vector_points")
    return recall(neighbours(v), v)


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours, "p6_recall": p6_recall}
SQL: dict[str, str] = {}
