"""Retrieval metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The outcomes of a run.
CATEGORIES = ["RETRIEVAL", "CITATION", "REASONING", "GENERATION", "CRAG", "SUCCESS"]


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, n_relevant, mrr, average_precision, recall) for (query_id, item_id, rank) against (query_id, item_id).

    Reciprocal rank of the first hit; precision at each hit over min(relevant, k); hits within k over relevant. A query
    without relevant items has zeros. Hits are found by a join, so relevant lists may be long. With ``counts``, the number
    (query_id, n) of a query's relevant items, ``relevant`` needs to hold those only that are found.
    """
    rel = relevant.select("query_id", "item_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant")) if counts is None else counts.select("query_id", F.col("n").alias("n_relevant"))
    hit = found.join(rel.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = hit.withColumn("hits", F.sum("hit").over(w))
    within = F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.col("hits") / F.col("rank")).otherwise(0.0)
    m = hit.groupBy("query_id").agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(within).alias("precisions"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("n_hits"),
    )
    m = m.join(n, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    some = F.col("n_relevant") > 0
    return m.select(
        "query_id",
        "n_relevant",
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(some, F.col("precisions") / F.least("n_relevant", F.lit(k))).otherwise(0.0), 6).alias("average_precision"),
        F.round(F.when(some, F.col("n_hits") / F.col("n_relevant")).otherwise(0.0), 6).alias("recall"),
    )


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """(category, n, share) of all categories, zeros included."""
    spark = df.sparkSession
    have = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    total = have.agg(F.sum("n")).first()[0] or 0
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = F.coalesce(F.col("n"), F.lit(0))
    share = F.round(n / F.lit(total), 6) if total else F.lit(0.0)
    return every.join(have, "category", "left").select("category", n.cast("long").alias("n"), share.alias("share"))


def path_features(fused: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, top1, spread, agreement) of a fused list with ``sources``: the best score, the gap from the first to the
    last of ``top`` (0 if there are fewer), and the share of the top rows that several lists found."""
    t = fused.filter(F.col("rank") <= top)
    last = F.max(F.when(F.col("rank") == top, F.col("score")))
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    many = F.avg(F.when(F.contains(F.col("sources"), F.lit(",")), 1.0).otherwise(0.0))
    return t.groupBy("query_id").agg(
        F.round(first, 6).alias("top1"), F.round(F.coalesce(first - last, F.lit(0.0)), 6).alias("spread"), F.round(many, 6).alias("agreement")
    )


def path_recall(lists: DataFrame, relevant: DataFrame, least: float = 0.8, counts: DataFrame | None = None) -> DataFrame:
    """(path, recall, passes): the mean over all queries of the share of their relevant items that the path has, as sets; a query
    without relevant items has 1. ``counts`` as in ``retrieval_metrics``."""
    rel = relevant.distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n")) if counts is None else counts
    hits = lists.select("path", "query_id", "item_id").distinct().join(rel, ["query_id", "item_id"]).groupBy("path", "query_id").agg(F.count("*").alias("hits"))
    total, none = lists.select("query_id").distinct().join(n, "query_id", "left").agg(F.count("*"), F.count_if(F.col("n").isNull())).first()
    shares = hits.join(n, "query_id").groupBy("path").agg(F.sum(F.col("hits") / F.col("n")).alias("s"))
    r = lists.select("path").distinct().join(shares, "path", "left")
    r = r.select("path", F.round((F.coalesce("s", F.lit(0.0)) + none) / max(total, 1), 6).alias("recall"))
    return r.withColumn("passes", F.col("recall") >= least)


def fused_improves(lists: DataFrame, relevant: DataFrame, fused: str = "FUSED") -> DataFrame:
    """(path, mrr, improves): mean reciprocal rank of each path over all queries, and whether the fused one is at least the best."""
    total = lists.select("query_id").distinct().count()
    first = lists.join(relevant.distinct(), ["query_id", "item_id"]).groupBy("path", "query_id").agg(F.min("rank").alias("first"))
    m = first.groupBy("path").agg(F.sum(1.0 / F.col("first")).alias("s"))
    m = lists.select("path").distinct().join(m, "path", "left")
    m = m.select("path", F.round(F.coalesce("s", F.lit(0.0)) / max(total, 1), 6).alias("mrr"))
    ours, best = m.agg(F.max(F.when(F.col("path") == fused, F.col("mrr"))), F.max(F.when(F.col("path") != fused, F.col("mrr")))).first()
    return m.withColumn("improves", F.lit(ours is not None and (best is None or ours >= best)))


def gate(metrics: dict[str, float], least: dict[str, float]) -> None:
    """Raises with every metric that misses its target."""
    missed = {k: (metrics.get(k), v) for k, v in least.items() if metrics.get(k) is None or metrics[k] < v}
    if missed:
        raise AssertionError("; ".join(f"{k}: {got} < {want}" for k, (got, want) in missed.items()))
