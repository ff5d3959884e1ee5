"""Scoring of candidates by a provider, trees of parents, and rendered contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import given, overlap_coefficient, token_estimate
from ..session import cut_lineage
from .packing import prefix_pack


def rerank(candidates: DataFrame, k: int | None = None, score: Column | None = None) -> DataFrame:
    """Candidates (query_id, query, text, rank) in the order of a score, earlier rank first where it ties; the default
    score is the share of common words. Without a scorer that works, pass a constant: the order stays."""
    s = F.round(overlap_coefficient(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))) if score is None else score, 6)
    w = W.partitionBy("query_id").orderBy(F.desc("_s"), "_r")
    d = candidates.withColumn("_s", s).withColumnRenamed("rank", "_r").withColumn("rank", F.row_number().over(w))
    d = d.withColumnRenamed("_s", "score").drop("_r")
    return d.filter(F.col("rank") <= k) if k else d


def ancestors(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor, distance) of a forest (node, parent): paths double in every round, so their number is the
    logarithm of the depth. Edges to oneself and nulls are left out; a cycle raises."""
    paths = cut_lineage(edges.filter("parent is not null and node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    for i in range(rounds):
        reach = F.lit(2**i)
        step = paths.filter(F.col("distance") == reach).alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node"))
        more = step.select("a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        more = cut_lineage(more)
        if more.isEmpty():
            return paths
        if not more.filter("node = ancestor").isEmpty():
            raise ValueError("the parents form a cycle")
        paths = cut_lineage(paths.unionByName(more))
    raise ValueError("the tree is too deep")


def numbered_context(df: DataFrame, by: str, order: str, source: str, text: str, budget: int = 6000) -> DataFrame:
    """(by, n_rows, context): the rows that fit the budget, each as ``[i] (Source: s): text`` and a blank line, in order; a missing
    source is UNKNOWN. The budget bounds the row that a group becomes."""
    packed = prefix_pack(df, by, order, token_estimate(F.col(text)), budget)
    i = F.row_number().over(W.partitionBy(by).orderBy(order))
    line = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] (Source: "), F.coalesce(given(F.col(source)), F.lit("UNKNOWN")), F.lit("): "), F.coalesce(text, F.lit("")), F.lit("\n\n"))
    g = packed.withColumn("_i", i).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))).alias("_l"))
    return g.select(by, F.size("_l").cast("long").alias("n_rows"), F.array_join(F.transform("_l", lambda x: x["l"]), "").alias("context"))


def first_alias(text: Column, registry: dict[str, list[str]], head: int = 3000) -> Column:
    """The canonical identifier of the first registry entry one of whose names stands, as words, in the first ``head`` characters of
    a text, by the registry's order."""
    low, out = F.lower(F.substring(text, 1, head)), None
    for k, names in registry.items():
        hit = low.rlike(whole_words(names))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(None).cast("string") if out is None else out


def whole_words(names: list[str]) -> str:
    """A pattern for any of the names with no letter or digit beside it."""
    return r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")(?:$|[^\p{L}\p{N}])"
