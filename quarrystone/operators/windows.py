"""Operators over neighbours in reading order: semantic chunks, sentence windows, running sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import cosine


def semantic_chunks(df: DataFrame, by: str, order: str, vector: str, page: Column | None = None, threshold: float = 0.85) -> DataFrame:
    """Adds ``chunk_no`` from 0: a new chunk begins where the similarity to the element before is below the threshold
    or the page changes."""
    w = W.partitionBy(by).orderBy(order)
    before = F.lag(vector).over(w)
    new = before.isNotNull() & (F.round(cosine(before, F.col(vector)), 6) < threshold)
    if page is not None:
        new = new | (F.lag(page).over(w) != page)
    return df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("chunk_no", F.sum("_new").over(w)).drop("_new")


def chunk_texts(elements: DataFrame, by: str, order: str, text: str, page: str, box: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """(by, chunk_no, n, text, page, x0, y0, x1, y1) of the semantic chunks of elements: blank ones are dropped, texts joined by a
    blank in order, the page is that of the chunk, the box is around all boxes there are."""
    e = semantic_chunks(elements.filter(F.col(text).rlike(r"(?U)\S")), by, order, vector, F.col(page), threshold)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    g = e.groupBy(by, "chunk_no").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"),
        F.min(page).alias("page"),
        *[f(F.col(box)[i]).alias(name) for i, (name, f) in enumerate((("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)))],
    )
    return g


def with_neighbours(df: DataFrame, doc: str, idx: str, text: str, ident: str, width: int = 1) -> DataFrame:
    """(ident, n_parts, window_text): every row's text with those up to ``width`` places around it, by an equi-join on
    the document and the place."""
    near = df.select(F.col(ident), F.col(doc), F.explode(F.sequence(F.col(idx) - width, F.col(idx) + width)).alias(idx))
    both = near.join(df.select(doc, idx, F.col(text).alias("_t")), [doc, idx])
    parts = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_t").alias("t"))))
    out = both.groupBy(ident).agg(parts.alias("_p"))
    return out.select(ident, F.size("_p").cast("long").alias("n_parts"), F.array_join(F.transform(F.filter("_p", lambda x: x["t"].isNotNull()), lambda x: x["t"]), "\n\n").alias("window_text"))


def claim_windows(candidates: DataFrame, corpus: DataFrame, width: int = 1, most: int = 1000) -> DataFrame:
    """Sentence windows in which an earlier candidate claims its neighbours.

    ``candidates`` is (query_id, rank, chunk_id, doc_id, split_idx), at most ``most`` ranks a query (they are the result
    of a top-k search; a rank beyond that, or none, is an error); ``corpus`` is (chunk_id, doc_id, split_idx, text). The neighbours are joined first, so a
    query's group holds its candidates' windows only. A candidate that was claimed is dropped; one that can fetch
    nothing stays as it is.
    """
    beyond = F.raise_error(F.concat(F.lit(f"claim_windows takes ranks up to {most}, not "), F.coalesce(F.col("rank").cast("string"), F.lit("null"))))
    c = candidates.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).otherwise(beyond))
    near = c.withColumn("_at", F.explode(F.sequence(F.col("split_idx") - width, F.col("split_idx") + width)))
    text = corpus.select(F.col("doc_id"), F.col("split_idx").alias("_at"), F.col("chunk_id").alias("found_id"), F.col("text").alias("found_text"))
    rows = near.join(text, ["doc_id", "_at"], "left")
    rows = rows.select("query_id", "rank", "chunk_id", F.col("_at").cast("long").alias("at"), "found_id", "found_text")

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for (rank, anchor), g in pdf.sort_values(["rank", "at"]).groupby(["rank", "chunk_id"], sort=True):
            if anchor in seen:
                continue
            got = [(i, t) for i, t in zip(g["found_id"], g["found_text"]) if isinstance(i, str) and i not in seen]
            seen.update(i for i, _ in got)
            out.append((g["query_id"].iloc[0], rank, anchor, len(got), "\n\n".join(t for _, t in got if isinstance(t, str))))
        return pd.DataFrame(out, columns=["query_id", "rank", "chunk_id", "n_parts", "window_text"])

    return rows.groupBy("query_id").applyInPandas(claim, "query_id long, rank int, chunk_id string, n_parts long, window_text string")


def first_over(df: DataFrame, by: str, order: list[str], amount: Column, limit: float) -> DataFrame:
    """Each group's first row at which the running sum passes the limit, with that sum."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("running", F.sum(amount).over(w)).filter(F.col("running") > limit)
    return d.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_n = 1").drop("_n")
