"""Writes as transformations: what a table is after rows have been merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The columns of a citation that a later write leaves alone.
CITATION_KEEPS = ["document_version", "document_hash", "citation_confidence"]


def last_wins(df: DataFrame, key: str | list[str], *latest) -> DataFrame:
    """One row per key, the latest one; ``latest`` must make the order total."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in latest])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def partial_upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of both by key: a new row replaces the old one but for the columns in ``keep``, whose old values stay, null
    ones included. Either side has a key once."""
    o, n = old.alias("o"), new.select(*old.columns).alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    had, has = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keep else F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*[pick(c).alias(c) for c in old.columns])


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old.select(key), key, "left_anti").select(*old.columns))


def fresh_only(df: DataFrame, at: str, now, days: int = 7) -> DataFrame:
    """Rows younger than their time to live."""
    return df.filter(F.col(at) > now - F.expr(f"interval {days} days"))


def replace_table(df: DataFrame, path: str, *by: str) -> None:
    """Writes beside the table, in folders by some columns if wanted, and swaps, so a table may be rewritten from itself."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path + ".new")
    target, fresh, gone = fs_path(path), fs_path(path + ".new"), fs_path(path + ".old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    if fs.exists(target):
        fs.rename(target, gone)
    fs.rename(fresh, target)
    fs.delete(gone, True)
