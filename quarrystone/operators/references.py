"""References to records that do not exist: temporal orphan detection and its report.

A reference is (table, field, record, key, time). It resolves if some target row has the same key, was
recorded at or before that time and was not deleted by then.

Defined cases
  * keys are compared without surrounding blanks and without letter case; null, empty and ``unknown``
    keys are no references and never reported;
  * repeated rows count once; a record id with several different keys or times is one reference each;
  * a reference without a time resolves to nothing and is an orphan; a target without recorded_at never resolves anything;
  * empty inputs give empty results; other columns of the inputs are never read, whatever their names.

Plan: the distinct keys of the references are anti-joined with the target keys; those that are left are joined back to
their references, which are orphans at any time. The other references meet the validity intervals of their keys (one
open-ended row per key plus the distinct closed ones, aggregated before the shuffle) in a left anti-join on the key with the
interval as residual condition. Keys that hold a large share of the references are salted, and only their rows of the
other side are replicated; at most ``1 / hot_share`` keys can be hot, so that list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_BLANKS = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def norm_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), EDGE_BLANKS, ""))


def references(df: DataFrame, table_name: str, field: str, record_id: str, at: str, target: str) -> DataFrame:
    """Non-empty references of one field, repeated rows removed."""
    return (
        df.select(
            F.lit(table_name).alias("table_name"),
            F.lit(field).alias("field_name"),
            df[record_id].cast("string").alias("record_id"),
            F.lit(target).alias("target"),
            norm_key(df[field]).alias("key"),
            df[at].alias("at"),
        )
        .filter(F.col("key").isNotNull() & ~F.col("key").isin("", "unknown"))
        .distinct()
    )


def targets(df: DataFrame, target: str, key: str, since: str = "recorded_at", until: str = "deleted_at") -> DataFrame:
    """Validity intervals by key: the earliest open one, and every distinct closed one."""
    t = df.select(F.lit(target).alias("target"), norm_key(df[key]).alias("key"), df[since].alias("since"), df[until].alias("until"))
    t = t.filter(F.col("key").isNotNull() & F.col("since").isNotNull())
    opened = t.filter(F.col("until").isNull()).groupBy("target", "key").agg(F.min("since").alias("since"))
    closed = t.filter(F.col("until") > F.col("since")).distinct()
    return opened.withColumn("until", F.lit(None).cast("timestamp")).unionByName(closed)


def missing_keys(keys: DataFrame, valid: DataFrame) -> DataFrame:
    """The distinct (target, key) of references that no target row ever had."""
    return keys.select("target", "key").join(valid.select("target", "key").distinct(), ["target", "key"], "left_anti")


def orphans(refs: DataFrame, valid: DataFrame, hot_share: float = 0.02, salts: int = 16) -> DataFrame:
    """References of ``refs`` whose key is missing, or that no interval of ``valid`` covers at their time."""
    keys = refs.groupBy("target", "key").count()
    total = keys.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(keys.filter(F.col("count") > max(1.0, total * hot_share)).select("target", "key", F.lit(salts).alias("_n")))
    n = F.coalesce(F.col("_n"), F.lit(1)).cast("bigint")
    r = refs.join(hot, ["target", "key"], "left").withColumn("_salt", F.pmod(F.xxhash64("record_id", "at"), n)).drop("_n")

    def replicated(side: DataFrame) -> DataFrame:
        return side.join(hot, ["target", "key"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).drop("_n")

    by = ["target", "key", "_salt"]
    missing = replicated(missing_keys(keys, valid))
    absent = r.join(missing, by, "left_semi")
    r, v = r.join(missing, by, "left_anti").alias("r"), replicated(valid).alias("v")
    at_the_time = (F.col("v.since") <= F.col("r.at")) & (F.col("v.until").isNull() | (F.col("v.until") > F.col("r.at")))
    same = [F.col(f"r.{c}") == F.col(f"v.{c}") for c in by]
    late = r.join(v, same[0] & same[1] & same[2] & at_the_time, "left_anti")
    return absent.unionByName(late).drop("_salt")


def orphan_report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References and orphans by table, field and month of the reference; month is null where the time is."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    by = ["table_name", "field_name", "month"]
    a = refs.groupBy("table_name", "field_name", month).agg(F.count("*").alias("n_references"), F.lit(0).cast("long").alias("n_orphans"))
    b = found.groupBy("table_name", "field_name", month).agg(F.lit(0).cast("long").alias("n_references"), F.count("*").alias("n_orphans"))
    return (
        a.unionByName(b)
        .groupBy(*by)
        .agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans"))
        .withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_references"), 6))
    )
