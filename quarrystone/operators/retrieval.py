"""Top-k search for a set of queries against a corpus: exact dense similarity and BM25.

Rank is a column, never row order; every order ends in a key, so it is total. Scores are rounded to six decimals
before ranking. A failed or missing path is an empty table of the same columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import terms
from ..session import cut_lineage, spread

HITS = "query_id long, item_id long, score double"
#: Similarities that a worker holds at once.
CELLS = 4_000_000


def ranked(hits: DataFrame, k: int, *by: str, score: str = "score", ident: str = "item_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1."""
    w = W.partitionBy(*(by or ("query_id",))).orderBy(F.desc(score), ident)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, same: bool = False, list_column: str | None = None, query_block: int = 4096) -> DataFrame:
    """(query_id, item_id, score, rank) of the ``k`` most similar items of each query, by cosine.

    Both inputs are (id long, vec array<float>) of usable vectors. The queries go to the workers in blocks of at most
    ``query_block`` rows, one pass over the corpus per block; every partition keeps its ``k`` best per query, so only
    k x queries x partitions rows are shuffled. ``same`` keeps a query from finding itself. With ``list_column``
    the result has that column too, and ``k`` rows for each of its values, found in the same pass. This is a search for a
    stated set of queries; where their number grows with the corpus, passes do too, and hashing is the way.
    """
    spark, out = queries.sparkSession, None
    rows = queries.select("id", "vec").limit(query_block + 1).toArrow()
    blocks = 1
    if rows.num_rows > query_block:
        blocks = math.ceil(queries.count() / query_block * 1.2)
    schema = HITS + (f", {list_column} string" if list_column else "")
    c = corpus.select("id", "vec", *([F.col(list_column).cast("string").alias("list")] if list_column else []))
    for i in range(blocks):
        if blocks > 1:
            rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "vec").toArrow()
        if not rows.num_rows:
            continue
        held = spark.sparkContext.broadcast((rows.column("id").to_numpy(), np.stack(rows.column("vec").to_numpy(zero_copy_only=False)).astype("f8")))
        hits = c.mapInArrow(_dense(held, k, same, list_column), schema)
        out = hits if out is None else out.unionByName(hits)
    out = spark.createDataFrame([], schema) if out is None else out
    return ranked(out, k, "query_id", *([list_column] if list_column else []))


def _dense(held, k: int, same: bool, list_column: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best: dict = {}  # by list: score, query place, item
        for b in batches:
            if not b.num_rows:
                continue
            all_ids = b.column(0).to_numpy()
            all_vec = np.asarray(b.column(1).flatten()).astype("f8").reshape(len(all_ids), -1)
            lists = np.array(b.column(2).to_pylist(), dtype=object) if list_column else np.full(len(all_ids), None, dtype=object)
            for name in set(lists.tolist()):
                every = np.flatnonzero(lists == name) if name is not None else np.array([i for i, x in enumerate(lists) if x is None])
                for at in np.array_split(every, math.ceil(len(every) * len(q_ids) / CELLS)):
                    ids, c = all_ids[at], all_vec[at]
                    s = q @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)).T
                    if same:
                        s[q_ids[:, None] == ids[None, :]] = -np.inf
                    old = best.get(name, (np.empty(0), np.empty(0, "i8"), np.empty(0, "i8")))
                    # The score of the k-th best so far, less what rounding may add; none, and the slice's own, while there are fewer.
                    edge = np.full(len(q_ids), -np.inf)
                    last = np.flatnonzero(np.arange(len(old[1])) - np.searchsorted(old[1], old[1]) == k - 1)
                    edge[old[1][last]] = old[0][last] - 1e-6
                    if len(last) < len(q_ids) and len(ids) >= k:
                        edge = np.maximum(edge, -np.partition(-s, k - 1, axis=1)[:, k - 1] - 2e-6)
                    r, col = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
                    score, row, item = np.concatenate([old[0], np.round(s[r, col], 6)]), np.concatenate([old[1], r]), np.concatenate([old[2], ids[col]])
                    o = np.lexsort((item, -score, row))
                    o = o[(np.arange(len(o)) - np.searchsorted(row[o], row[o])) < k]
                    best[name] = (score[o], row[o], item[o])
        for name, (score, row, item) in best.items():
            cols = [pa.array(q_ids[row]), pa.array(item), pa.array(score)] + ([pa.array([name] * len(row), pa.string())] if list_column else [])
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "item_id", "score"] + ([list_column] if list_column else []))

    return run


def postings(corpus: DataFrame) -> DataFrame:
    """(item_id, term, tf, length) of a corpus (id, text); both counts are made within the row's partition."""
    t = corpus.select(F.col("id").alias("item_id"), terms(F.col("text")).alias("t"))
    t = t.select("item_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return t.groupBy("item_id", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (id, text): a term repeated in a query counts each time."""
    return queries.select(F.col("id").alias("query_id"), F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(q: DataFrame, p: DataFrame, n: int, mean: float | None, k: int = 5, k1: float = 1.2, b: float = 0.75, few: int = 200_000) -> DataFrame:
    """(query_id, item_id, score, rank) of query terms and the postings (item_id, term, tf, length) that hold them, of a corpus of
    ``n`` texts and so many terms in the ``mean``. Up to ``few`` query terms go to the postings by broadcast, so a term that most
    texts have is no hot key; more are joined."""
    side = F.broadcast if q.count() <= few else lambda x: x
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / F.lit(float(mean or 1.0)))
    scored = p.join(side(df.join(q, "term")), "term").withColumn("s", F.col("qtf") * idf * F.col("tf") / (F.col("tf") + norm))
    return ranked(scored.groupBy("query_id", "item_id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, repeats: bool = False, few: int = 200_000) -> DataFrame:
    """(query_id, item_id, score, rank) by BM25 over (id, text) tables.

    Only postings of query terms leave the scan: a text's terms are cut down to those of the queries before they are
    counted, by a broadcast of at most ``few`` terms, a join beyond. Statistics (number of texts, mean length, document
    frequency) are of the whole corpus, texts without terms included. ``repeats`` says that the corpus may hold a row
    several times; it then counts once, and only lengths and postings are made distinct, never texts. ``bm25_scores``
    over stored postings is the form for many searches.
    """
    q = cut_lineage(query_terms(queries))
    corpus = spread(corpus.select("id", F.coalesce("text", F.lit("")).alias("text")))
    length = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"))
    lengths = corpus.select("id", length.alias("length"))
    stats = (lengths.distinct() if repeats else lengths).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    wanted = q.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= few else wanted
    row = [F.monotonically_increasing_id().alias("row")] if repeats else []
    t = corpus.select(F.col("id").alias("item_id"), *row, terms(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    by = ["item_id", "length", "term", *(["row"] if repeats else [])]
    p = t.select(*[c for c in by if c != "term"], F.explode("t").alias("term")).join(wanted, "term").groupBy(*by).agg(F.count("*").alias("tf"))
    return bm25_scores(q, p.drop("row").distinct() if repeats else p, stats.n, stats.mean, k, k1, b, few)
