"""Column functions. All stay inside generated code: no Python per row.

Missing-value rule of the data model: an empty string, a zero and an empty list are missing wherever a default applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of name-based identifiers.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: Phrases that make a question complex wherever they stand in it, and connectors that count as words.
COMPLEX_MARKS = ["compare", "differences", "versus", "vs", "similarities", "conflict", "contradict", "supersede", "reconcile", "summarize across"]
CONNECTORS = ["and", "or", "but", "however", "although", "unless", "except"]
MARKER = r"pqac-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def given(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_text(text: Column, content: Column, proposition: Column, questions: Column) -> Column:
    """The first text that is there: text, content, proposition, the questions joined by a blank, or nothing."""
    return F.coalesce(given(text), given(content), given(proposition), F.array_join(questions, " "), F.lit(""))


def word_list(c: Column) -> Column:
    """Blank-separated words, lower-cased."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Search terms: runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def token_estimate(c: Column) -> Column:
    """Tokens of a text without a tokenizer: twice its words."""
    return F.coalesce(word_count(c) * 2, F.lit(0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set, 0 if either is empty."""
    x, y = F.array_distinct(word_list(a)), F.array_distinct(word_list(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def name_uuid(name: Column) -> Column:
    """Name-based identifier, version 5, in the DNS namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "utf-8"))), 1, 32)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(doc: Column, idx: Column, text: Column) -> Column:
    """Identifier of a chunk from its content and place."""
    return F.concat(F.lit("pqac-"), name_uuid(F.sha2(F.concat_ws("|", doc, idx.cast("string"), text), 256)))


def query_hash(c: Column) -> Column:
    return F.md5(F.lower(c))


def authority(url: Column) -> Column:
    """Host part of an address with user and port, lower-cased, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def freshness(age: Column) -> Column:
    return F.when(age.rlike("day|hour|minute"), 1.0).when(age.rlike("month"), 0.8).otherwise(0.6)


def complexity(text: Column) -> Column:
    """struct(complexity, confidence): SIMPLE, COMPLEX or ESCALATE."""
    n, low = F.size(word_list(text)), F.lower(text)
    marked = low.rlike("|".join(COMPLEX_MARKS))
    connectors = F.size(F.filter(word_list(text), lambda w: w.isin(CONNECTORS)))
    kind = F.when(n <= 5, "SIMPLE").when(marked, "COMPLEX").when((n > 20) & (connectors >= 3), "COMPLEX").otherwise("ESCALATE")
    sure = F.when(n <= 5, 0.95).when(marked, 0.9).when((n > 20) & (connectors >= 3), 0.85).otherwise(0.0)
    return F.struct(kind.alias("complexity"), sure.alias("confidence"))


def decoding(confidence: Column) -> Column:
    """struct(temperature, top_p) by answer confidence."""
    middle = (confidence > 0.5) & (confidence <= 0.8)
    return F.struct(F.when(middle, 0.1).otherwise(0.0).alias("temperature"), F.when(middle, 0.3).otherwise(0.1).alias("top_p"))


def failure_category(malformed: Column, retrieved: Column, triggered: Column, correct: Column, precision: Column) -> Column:
    return (
        F.when(malformed, "GENERATION")
        .when(~retrieved & triggered, "CRAG")
        .when(~retrieved, "RETRIEVAL")
        .when(~correct, "REASONING")
        .when(precision < 0.95, "CITATION")
        .otherwise("SUCCESS")
    )


def calibrated(top1: Column, spread: Column, agreement: Column) -> Column:
    """Untrained confidence: a weighted sum cut to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * top1 + 0.2 * spread + 0.2 * agreement))


def backoff_seconds(retries: Column) -> Column:
    return (F.lit(10) * F.pow(F.lit(3.0), retries - 1)).cast("long")


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def keep_known_markers(text: Column, known: Column) -> Column:
    """The text without markers of unknown citations; known ones stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({MARKER})"), 1))
    unknown = F.filter(found, lambda m: ~F.array_contains(known, m))
    return F.aggregate(unknown, text, lambda t, m: F.replace(t, m, F.lit("")))
