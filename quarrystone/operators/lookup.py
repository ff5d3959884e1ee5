"""Small-dimension lookups: canonical names, trust of addresses, metadata filters, verdicts on citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import authority, given, overlap_coefficient

#: Canonical identifiers and the names by which they are known.
JURISDICTIONS = {
    "IN-MH": ["maharashtra", "mh", "state of maharashtra", "maharastra"],
    "IN-DL": ["delhi", "nct delhi", "new delhi", "delhi ncr"],
    "IN-KA": ["karnataka", "ka", "state of karnataka"],
    "US-NY": ["new york", "ny", "n.y.", "state of new york"],
    "US-CA": ["california", "ca", "state of california"],
}
DOCUMENT_TYPES = {
    "DOC-10K": ["10-k", "10k", "annual report"],
    "DOC-10Q": ["10-q", "10q", "quarterly report"],
    "DOC-MSA": ["msa", "master service agreement"],
    "DOC-NDA": ["nda", "non-disclosure agreement", "non disclosure agreement"],
}
#: Trust of domains and of their subdomains; any other address has DEFAULT_TRUST.
TRUSTED = {
    "sec.gov": 1.0,
    "law.cornell.edu": 0.98,
    "supremecourt.gov": 1.0,
    "congress.gov": 0.95,
    "federalregister.gov": 0.95,
    "irs.gov": 1.0,
    "finra.org": 0.90,
    "investor.gov": 0.95,
    "ftc.gov": 0.95,
    "internal_firm_documents": 1.0,
    "partner_knowledge_base": 0.95,
}
DEFAULT_TRUST = 0.2


def alias_table(spark: SparkSession, registry: dict[str, list[str]]) -> DataFrame:
    """(alias, canonical_id) of a fixed registry; of repeated aliases the later one wins."""
    rows = {a.strip().lower(): k for k, names in registry.items() for a in names}
    return spark.createDataFrame(list(rows.items()), "alias string, canonical_id string")


def canonical(df: DataFrame, column: str, aliases: DataFrame, name: str = "canonical_id") -> DataFrame:
    """Adds the canonical identifier of a hand-typed name, null if it is unknown. The registry is fixed and tiny."""
    key = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return df.join(F.broadcast(aliases.withColumnRenamed("canonical_id", name)), key == F.col("alias"), "left").drop("alias")


def keep_unless_different(df: DataFrame, target: dict[str, str | None]) -> DataFrame:
    """Null-tolerant filter: a row goes only if a wanted field has another value than the wanted one."""
    for field, value in target.items():
        if value:
            df = df.filter(F.coalesce(given(F.col(field)), F.lit(value)) == value)
    return df


def trust(url: Column, trusted: dict[str, float] | None = None) -> Column:
    """Trust of an address: the first listed domain that it equals or ends in, by a chain of comparisons in the plan."""
    host, out = authority(url), None
    for domain, score in (TRUSTED if trusted is None else trusted).items():
        hit = (host == domain) | F.endswith(host, F.lit("." + domain))
        out = F.when(hit, float(score)) if out is None else out.when(hit, float(score))
    return F.lit(DEFAULT_TRUST) if out is None else out.otherwise(DEFAULT_TRUST)


def citation_verdict(claim: Column, source: Column, late: Column) -> Column:
    """struct(similarity, verdict, span): valid above 0.8 with the head of the source, a judge's case otherwise;
    where the judge was late, valid above 0.5 without a span."""
    s = F.round(overlap_coefficient(F.coalesce(claim, F.lit("")), F.coalesce(source, F.lit(""))), 6)
    verdict = F.when(late, F.when(s > 0.5, "valid").otherwise("invalid")).when(s > 0.8, "valid").otherwise("judge")
    span = F.when(~late & (s > 0.8), F.substring(source, 1, 100))
    return F.struct(s.alias("similarity"), verdict.alias("verdict"), span.alias("span"))


def satisfied_elements(text: Column, required: Column, optional: Column, least: float = 0.5) -> Column:
    """struct(missing, ratio, passes): an element is there if the text has it, letter case aside. All required ones must
    be, and a share of ``least`` of the optional ones; a row without elements passes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    there = lambda x: F.contains(low, F.lower(x))
    req, opt = F.coalesce(required, F.array().cast("array<string>")), F.coalesce(optional, F.array().cast("array<string>"))
    missing = F.size(F.filter(req, lambda x: ~there(x)))
    ratio = F.when(F.size(opt) > 0, F.size(F.filter(opt, there)) / F.size(opt)).otherwise(F.lit(1.0))
    return F.struct(missing.alias("missing"), F.round(ratio, 6).alias("ratio"), ((missing == 0) & (ratio >= least)).alias("passes"))
