"""p10: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage
from ..sources.tables import table
from .subjects import agreement, assigned, composition, fitted, subject_scores


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    labels = table(spark, sf, "subject_labels")
    scored = cut_lineage(subject_scores(table(spark, sf, "documents")))
    return scored, labels, fitted(scored, labels)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    scored, _, thresholds = _scored(spark, sf)
    return assigned(scored, thresholds).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    scored, _, thresholds = _scored(spark, sf)
    return composition(scored, thresholds)


def p10_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """On the half of the labelled documents that the thresholds were not fitted on."""
    scored, labels, thresholds = _scored(spark, sf)
    return agreement(assigned(scored, thresholds), labels, half=1)


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition, "p10_agreement": p10_agreement}
SQL: dict[str, str] = {}
