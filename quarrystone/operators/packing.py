"""Order and size of the context: prefix packing, interleaving, diversity, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import given, token_estimate

#: Tokens of the two modes, 0.2 and 0.6 of a window of 102,000, and what stands between chunks.
BUDGETS = {"fast": 20_400, "deep": 61_200}
SEPARATOR = "\n\n---\n\n"


def prefix_pack(df: DataFrame, by: str, rank: str, tokens: Column, budget: int = 6000, overhead: int = 20, least: int = 0) -> DataFrame:
    """Rows up to the first at which the running sum of tokens and overhead passes the budget. Every addend is
    positive, so this is a filter on the running sum. A row costs at least ``overhead`` + ``least`` tokens, so no more than
    budget / cost rows of a group can stay, and every task drops the others of its rows before the shuffle."""
    w = W.partitionBy(by).orderBy(rank)
    d = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget // max(1, overhead + least))
    return d.withColumn("running", F.sum(tokens + overhead).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("running") <= budget).drop("_n")


def interleave(df: DataFrame, by: str, rank: str, mode: str = "edges") -> DataFrame:
    """Adds ``position`` from 1: the best rows at both ends, or in the centre. It is made for packed rows, whose groups are small."""
    i = F.row_number().over(W.partitionBy(by).orderBy(rank)) - 1
    n = F.count("*").over(W.partitionBy(by))
    d = df.withColumn("_i", i.cast("long")).withColumn("_n", n)
    even, i, n = F.col("_i") % 2 == 0, F.col("_i"), F.col("_n")
    if mode == "edges":
        at = F.when(even, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2))
    else:
        half = F.ceil(n / 2)
        at = F.when(even, half - 1 - F.floor(i / 2)).otherwise(half + F.floor((i - 1) / 2))
    return d.withColumn("position", (at + 1).cast("long")).drop("_i", "_n")


def per_document(df: DataFrame, by: str, doc: str, rank: str, most: int = 3) -> DataFrame:
    """At most ``most`` rows of a document for each query; rows without a document share one."""
    w = W.partitionBy(by, F.coalesce(given(F.col(doc)), F.lit("unknown_doc"))).orderBy(rank)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def first_of_each(df: DataFrame, by: str, key: str, rank: str) -> DataFrame:
    """The best row of each key; rows without a key are left out."""
    w = W.partitionBy(by, key).orderBy(rank)
    return df.filter(given(F.col(key)).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rendered(df: DataFrame, by: str, doc: str, key: str, text: str, rank: str, mode: str) -> DataFrame:
    """The lines that fit the budget of a mode: diversity, then one row per key, then prefix packing of the rendered lines."""
    d = first_of_each(per_document(df, by, doc, rank), by, key, rank)
    d = d.withColumn("_line", F.concat(F.lit("["), F.substring(key, 1, 13), F.lit("] "), F.coalesce(text, F.lit(""))))
    return prefix_pack(d, by, rank, token_estimate(F.col("_line")), BUDGETS.get(mode, BUDGETS["deep"]), 0, least=2)


def assemble(df: DataFrame, by: str = "query_id", doc: str = "doc_id", key: str = "chunk_id", text: str = "text", rank: str = "rank", mode: str = "fast") -> DataFrame:
    """(by, n_rows, n_tokens, context, context_map): the rendered lines joined, and the text of each key."""
    d = rendered(df, by, doc, key, text, rank, mode)
    lines = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_line").alias("line"), F.col(key).alias("k"), F.col(text).alias("t"))))
    out = d.groupBy(by).agg(F.count("*").alias("n_rows"), F.max("running").alias("n_tokens"), lines.alias("_l"))
    texts = F.map_from_entries(F.transform("_l", lambda x: F.struct(x["k"], x["t"])))
    return out.select(by, "n_rows", "n_tokens", F.array_join(F.transform("_l", lambda x: x["line"]), SEPARATOR).alias("context"), texts.alias("context_map"))
