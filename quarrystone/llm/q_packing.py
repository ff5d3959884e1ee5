"""p3: chunks packed into containers of 6,000 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .packing import containers, fill_report


def p3_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "chunks"))


def p3_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p3_containers(spark, sf))


QUERIES = {"p3_containers": p3_containers, "p3_fill": p3_fill}
SQL: dict[str, str] = {}
