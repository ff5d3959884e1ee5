"""Most similar vectors for every vector: cross-polytope hashing with multiprobe and exact reranking.

Every unit vector gets, in each of several tables, a key of ``parts`` signed axes: three rounds of random signs
and a fast Hadamard transform, then the axis of largest magnitude and its sign. A vector is stored under its own
key in every table, and asks there and under a few further keys: of all keys that take the next best axis in one part of one
table, those that lose least by it (query-directed probing). Rows of a bucket meet in one sorted run; each asker keeps its
``k`` best there by exact cosine, and the best over all tables are the answer.

Number of parts and tables follow the number of vectors (``plan``): buckets of some hundred rows keep the copies of a vector
few, which is what is shuffled; comparing the rows of a bucket is one matrix product. Buckets of more than ``block`` rows
are dealt into blocks and every pair of blocks meets in a run of its own, so no run is unbounded and none is cut. Vectors
that are equal up to length are collected first: only the ``k + 1`` smallest ids of such a class take part, and the
others take their answer from the smallest.

Defined cases
  * a vector takes part if it has ``dims`` numbers, none null, NaN or infinite, not all zero; others get no rows;
  * repeated rows (same id) count once; a null id is left out;
  * similarity is the cosine in double precision, rounded to six decimals; ties go to the smaller id;
  * fewer than ``k`` other vectors give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage, spread
from .runs import whole_groups

ROUNDS = 3


def plan(n: int, dims: int) -> tuple[int, int, int]:
    """(parts of a key, tables, probes of a vector) for ``n`` vectors; a part has twice as many values as the padded dimension."""
    parts = max(1, round(math.log(max(n, 600) / 600) / math.log(2 * pad(dims))))
    return parts, math.ceil(5 * 1.6 ** (parts - 1)), 2 * parts


def pad(dims: int) -> int:
    return 1 << max(1, (dims - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def axes(v: np.ndarray, table: int, part: int, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each unit vector under the pseudo-rotation of (table, part), and their magnitudes."""
    rng = np.random.default_rng((table << 8) + part)
    y = np.zeros((len(v), pad(v.shape[1])))
    y[:, : v.shape[1]] = v
    for _ in range(ROUNDS):
        y = hadamard(y * rng.choice([-1.0, 1.0], y.shape[1]))
    a = np.abs(y)
    r = np.arange(len(y))
    at, size = np.empty((len(y), most), "i8"), np.empty((len(y), most))
    for j in range(most):
        at[:, j] = a.argmax(axis=1)
        size[:, j] = a[r, at[:, j]]
        a[r, at[:, j]] = -1
    return at * 2 + (np.take_along_axis(y, at, axis=1) < 0), size


def _matrix(c: pa.Array, dims: int) -> np.ndarray:
    """Rows of a binary column of float32 numbers."""
    return np.frombuffer(b"".join(c.to_pylist()), dtype="<f4").reshape(-1, dims).astype("f8")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, vec, cell): vec is the float32 bytes, cell equal for vectors of equal direction."""
    v = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<float>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    v = v.filter(F.col("id").isNotNull() & (F.size("v") == dims) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.asarray(b.column(1).flatten(), dtype="<f4").reshape(-1, dims)
            q = np.rint(_unit(m.astype("f8")) * 32767).astype("<i2") if len(m) else m.astype("<i2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in q], pa.binary())], names=["id", "vec", "cell"])

    return spread(v).mapInArrow(pack, "id long, vec binary, cell binary").select("id", "vec", F.xxhash64("cell").alias("cell"), F.md5("cell").alias("_m")).withColumn("cell", F.concat_ws("-", "cell", "_m")).drop("_m")


def _keys(rows: DataFrame, dims: int, parts: int, tables: int, probes: int, nearest: int = 3) -> DataFrame:
    """(tab, bucket, stored, id, vec): where each vector is stored and asks, and where it also asks."""
    size = 2 * pad(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column(1), dims))
            own, loss, other, tab = [], [], [], []
            for t in range(tables):
                near = [axes(u, t, p, nearest) for p in range(parts)]
                bucket = np.zeros(len(u), dtype="i8")
                for at, _ in near:
                    bucket = bucket * size + at[:, 0]
                own.append(bucket)
                for p, (at, magnitude) in enumerate(near):
                    for j in range(1, nearest):
                        tab.append(t)
                        loss.append(magnitude[:, 0] - magnitude[:, j])
                        other.append(bucket + (at[:, j] - at[:, 0]) * size ** (parts - 1 - p))
            chosen = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")[:, :probes]
            asks = np.take_along_axis(np.stack(other, axis=1), chosen, axis=1)
            cols = [(np.full(len(u), t), own[t], True) for t in range(tables)] + [(np.array(tab)[chosen[:, i]], asks[:, i], False) for i in range(chosen.shape[1])]
            for t, bucket, stored in cols:
                yield pa.RecordBatch.from_arrays([pa.array(t.astype("i4")), pa.array(bucket), pa.array(np.full(len(u), stored)), b.column(0), b.column(1)], names=["tab", "bucket", "stored", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "tab int, bucket long, stored boolean, id long, vec binary")


def block_keys(keys: DataFrame, by: list[str], ident: str, block: int, few: int = 100_000) -> DataFrame:
    """Adds ``bi`` and ``bj``: 0, 0 in ordinary buckets. A bucket of n > ``block`` rows has ceil(n / block) blocks by
    hash; row x of block i goes to the runs (min(i, j), max(i, j)) of all j, so any two rows meet in one of them. The sizes
    of at most ``few`` such buckets are broadcast, more are joined."""
    sizes = keys.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select(*by, F.ceil(F.col("_n") / block).cast("int").alias("_b"))
    sizes = cut_lineage(sizes)  # a row for a bucket of more than ``block`` rows
    k = keys.join(F.broadcast(sizes) if sizes.count() <= few else sizes, by, "left")
    mine = F.pmod(F.xxhash64(F.col(ident)), F.coalesce("_b", F.lit(1))).cast("int")
    k = k.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.coalesce("_b", F.lit(1)) - 1)))
    return k.withColumn("bi", F.least("_i", "_j")).withColumn("bj", F.greatest("_i", "_j")).drop("_b", "_i", "_j")


def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each row of ``s``: similarity down, then id up; -2 marks no candidate."""
    if s.shape[1] > 4 * k:  # all that reach the k-th value, ties included
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((s >= edge) & (s > -2))
    else:
        r, c = np.nonzero(s > -2)
    o = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[o], c[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _meet(dims: int, k: int, rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 4):
            ids, stored = t.column("id").to_numpy(), t.column("stored").to_numpy(zero_copy_only=False)
            u = _unit(_matrix(t.column("vec").combine_chunks(), dims)).astype("f8")
            a, b, sim = [], [], []
            for i, j in zip(starts, [*starts[1:], t.num_rows]):
                at = np.flatnonzero(stored[i:j]) + i
                if not len(at) or j - i < 2:
                    continue
                for lo in range(i, j, rows):  # a bounded table of similarities at a time
                    hi = min(j, lo + rows)
                    s = np.round(u[lo:hi] @ u[at].T, 6)
                    s[ids[lo:hi, None] == ids[None, at]] = -2
                    r, c = best_of(s, ids[at], k)
                    a.append(ids[lo + r])
                    b.append(ids[at[c]])
                    sim.append(s[r, c])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, sim)], names=["id", "other", "similarity"])

    return run


def neighbours(df: DataFrame, key: str = "point_no", vector: str = "vector", dims: int = 64, k: int = 5, block: int = 4000) -> DataFrame:
    """(id, other, similarity, place) of the ``k`` most similar vectors of every usable one."""
    rows = usable(df, key, vector, dims)
    rows = cut_lineage(rows.groupBy("id").agg(F.min_by("vec", "cell").alias("vec"), F.min("cell").alias("cell")))  # repeated rows
    w = W.partitionBy("cell").orderBy("id")
    reps = rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= k + 1).select("id", "vec")
    keys = block_keys(_keys(reps, dims, *plan(rows.count(), dims)), ["tab", "bucket"], "id", block)
    by = ["tab", "bucket", "bi", "bj"]
    met = keys.select(*by, "stored", "id", "vec").repartition(*by).sortWithinPartitions(*by).mapInArrow(_meet(dims, k), "id long, other long, similarity double")
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    met = met.repartition("id").dropDuplicates(["id", "other"])  # one shuffle serves this and the ranks
    best = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    best = cut_lineage(best)
    # members of a class beyond its k + 1 smallest ids
    lead = rows.groupBy("cell").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter(F.col("n") > k + 1)
    firsts = rows.join(reps.select("id"), "id", "left_anti").join(lead, "cell").select("id", "lead")
    answers = lead.select("lead").join(best.withColumnRenamed("id", "lead"), "lead").select("lead", "other", "similarity")
    answers = answers.unionByName(lead.select("lead", F.col("lead").alias("other"), F.lit(1.0).alias("similarity")))
    answers = answers.withColumn("place", F.row_number().over(W.partitionBy("lead").orderBy(F.desc("similarity"), "other"))).filter(F.col("place") <= k)
    return best.unionByName(firsts.join(answers, "lead").select("id", "other", "similarity", "place"))


def recall(found: DataFrame, df: DataFrame, key: str = "point_no", vector: str = "vector", dims: int = 64, k: int = 5, every: int = 100, block: int = 4096) -> DataFrame:
    """Share of the true ``k`` neighbours that ``found`` has, for the ids divisible by ``every``: brute force in
    blocks, every stored block against the asked vectors, whose number is n / every."""
    rows = usable(df, key, vector, dims).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = rows.filter(F.col("id") % every == 0)
    n = asked.count()
    cuts = max(1, math.ceil(n / block))
    q = asked.select(F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int").alias("tab"), F.lit(False).alias("stored"), "id", "vec")
    spans = max(1, math.ceil(rows.count() / block))
    q = q.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
    s = rows.select(F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("tab"), F.lit(True).alias("stored"), "id", "vec")
    s = s.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(spans)))
    both = q.unionByName(s).withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0))
    by = ["tab", "bucket", "bi", "bj"]
    met = both.select(*by, "stored", "id", "vec").repartition(*by).sortWithinPartitions(*by).mapInArrow(_meet(dims, k), "id long, other long, similarity double")
    met = met.join(asked.select("id"), "id", "left_semi")
    true = met.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))).filter(F.col("place") <= k)
    hit = true.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hit.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
