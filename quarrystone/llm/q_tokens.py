"""p8: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.tables import table
from .tokens import encode


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p8_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens by language label, as written."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("lang").alias("lang"))
    n = p8_ids(spark, sf).select("doc_id", F.size("ids").cast("long").alias("n"))
    return d.join(n, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
SQL = {}
