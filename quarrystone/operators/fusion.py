"""Reciprocal rank fusion of ranked lists, and the merge of local and web results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The contract of a search path: queries, corpus and the number of hits to (query_id, item_id, score, rank).
RetrievalPath = Callable[[DataFrame, DataFrame, int], DataFrame]

#: Order in which lists are read; the first list that has an item gives its payload.
PATHS = ["D", "PRIMARY", "B", "C", "A"]


def isolated(spark: SparkSession, build: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The rows of a path, or none where its tables or columns are missing or its plan cannot be made; the other paths go on."""
    empty = spark.createDataFrame([], schema)
    try:
        return build().select(*[F.col(c).cast(t) for c, t in empty.dtypes])
    except PySparkException:
        return empty


def appended(sources: Column) -> Column:
    """Names joined by commas, but for those that stand in what has been joined so far, as part of another name too."""
    return F.aggregate(sources, F.lit(""), lambda so_far, x: F.when(F.contains(so_far, x), so_far).when(so_far == "", x).otherwise(F.concat(so_far, F.lit(","), x)))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, top_n: int | None = None, payload: str | None = None) -> DataFrame:
    """(query_id, item_id, score, sources, rank) of rows (query_id, path, rank, item_id), rank from 1. With ``payload`` that
    column too, of the first list that has the item.

    An item's score is the sum of 1 / (k + rank) over all its rows, several of one list included. Equal scores keep
    the order in which items are first seen: by list, then by rank. Rows without an item are left out.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, PATHS)), F.col("path")), F.lit(0)).cast("int")
    at = F.when(order > 0, order).otherwise(len(PATHS) + 1)
    rows = lists.filter(F.col("item_id").isNotNull()).withColumn("_seen", F.struct(at.alias("p"), F.col("rank").cast("long").alias("r")))
    fused = rows.groupBy("query_id", "item_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("raw"),
        F.min("_seen").alias("_first"),
        F.min_by(payload if payload else F.lit(None), "_seen").alias(payload or "_payload"),
        F.transform(F.array_sort(F.collect_set(F.struct(F.col("_seen.p").alias("p"), F.col("path").alias("path")))), lambda x: x["path"]).alias("sources"),
    )
    fused = fused.withColumn("score", F.round("raw", 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "_first.p", "_first.r", "item_id")
    fused = fused.withColumn("rank", F.row_number().over(w)).select("query_id", "item_id", "score", F.array_join("sources", ",").alias("sources"), "rank", *([payload] if payload else []))
    return fused.filter(F.col("rank") <= top_n) if top_n else fused


def merge_with_web(local: DataFrame, web: DataFrame, confidence: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(query_id, item, score, source, rank): a query of confidence below ``threshold`` gets its web rows too.

    Local rows stand before web rows of the same score; a missing score is 0; each side keeps its own order.
    """
    low = confidence.filter(F.coalesce("confidence", F.lit(0.0)) < threshold).select("query_id")
    cols = ["query_id", "item", F.coalesce("score", F.lit(0.0)).alias("score"), "rank"]
    both = local.select(*cols, F.lit("local").alias("source")).unionByName(web.join(low, "query_id", "left_semi").select(*cols, F.lit("web").alias("source")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "source", "rank", "item")
    return both.withColumn("rank", F.row_number().over(w))
