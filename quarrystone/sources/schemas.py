"""Tables of the store, their columns and keys, and the folders they are kept in; settings of a deployment."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: The columns of the tables.
TABLES = {
    "citation_references": "pqac_id string, document_id string, document_version int, document_hash string, page int, x0 double, y0 double, x1 double, y1 double, text_span string, chunk_id string, citation_confidence double",
    "document_metadata": "document_id string, title string, pdf_url string, version int",
    "ingestion_jobs": "job_id string, document_id string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error_message string, retry_count int",
    "primary_v2": "id string, vec array<float>, chunk_id string, doc_id string, text string",
    "hype_v2": "id string, vec array<float>, chunk_id string, doc_id string, questions array<string>",
    "propositions_v2": "id string, vec array<float>, chunk_id string, doc_id string, proposition string",
    "clusters_v2": "id string, vec array<float>, chunk_id string, doc_id string, text string, level int",
    "postings": "item_id string, term string, tf long, length int",
}


@dataclass(frozen=True)
class Settings:
    """Settings that are read from the session as ``spark.quarrystone.<name>``, with the defaults of the data model."""

    top_k_per_path: int = 5
    fast_trim: int = 15
    deep_trim: int = 8
    final_k: int = 5
    pack_budget: int = 6000
    chunk_similarity: float = 0.85
    crag_threshold: float = 0.4
    most_retries: int = 3

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"spark.quarrystone.{f.name}", None) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})


def bootstrap(spark: SparkSession, root: str) -> None:
    """Makes every table that is not there yet, empty; what is there stays."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def described(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, column_name, type) of the tables under a folder."""
    rows = [(name, c, t) for name in TABLES for c, t in spark.read.parquet(f"{root}/{name}").dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")
