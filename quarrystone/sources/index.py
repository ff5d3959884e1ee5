"""The search index on disk: postings, text lengths and vectors as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import postings
from ..operators.upserts import replace_table


def write_postings(corpus: DataFrame, path: str, buckets: int = 32) -> None:
    """Postings of (id, text), dealt by term into folders, so that a query reads the folders of its terms only."""
    p = postings(corpus).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    p.repartition("bucket").sortWithinPartitions("term", "item_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 32) -> DataFrame:
    """Postings of the given terms; partitions and row groups without them are pruned."""
    wanted = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")


def upsert_postings(new: DataFrame, path: str, buckets: int = 32) -> None:
    """Postings of new or changed texts (id, text); all postings that an id had before go, so a text may lose terms."""
    spark = new.sparkSession
    fresh = postings(new).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    old = spark.read.parquet(path).join(new.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_anti")
    rows = old.select(*fresh.columns).unionByName(fresh)
    replace_table(rows.repartition("bucket").sortWithinPartitions("term", "item_id"), path, "bucket")


def upsert_vectors(new: DataFrame, path: str, key: str = "id") -> None:
    """Writes vectors by id; a new one replaces an old one of its id."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
        new = old.join(new.select(key), key, "left_anti").unionByName(new)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    replace_table(new, path)
