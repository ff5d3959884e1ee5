"""Near-duplicate texts by Order MinHash, and groups of them.

A text is its words; equal word sequences are one class and take part once. Every run of ``K`` words, labelled with its
occurrence in the text, is hashed in each of ``tables`` orders; the ``picks`` smallest are kept in the order in which
they stand in the text and hashed to the key of the table, so a key survives edits but not reordering of what it
picked. Classes that share a key are candidates. Two bits of the first pick of ``SIGNED`` tables travel with a key, and a
candidate goes on if as many of them agree as a pair at the threshold has but for a chance of ``LOSS`` (1 in 10,000).

A banded alignment of the words verifies every candidate: so many words of one text, with so many edits, match the other
that the sets of runs share at least a certain number (``sure_overlap``), and a pair for which that is enough is accepted.
What the band cannot see (blocks that moved) is decided by the exact overlap of the runs, and nothing else rejects a pair.

Large buckets are dealt into blocks that meet pairwise in tasks of their own, so no group is unbounded, dropped or
capped. Copies are never multiplied before verification.

Defined cases
  * a *word* is a longest run of letters and digits, lower-cased; texts of fewer than ``least_words`` words, null and
    empty texts, and null keys are in no pair;
  * repeated rows count once; equal texts under different keys have similarity 1;
  * similarity is the Jaccard index of the sets of distinct runs of ``K`` words; the threshold itself counts;
  * whole texts are used however long; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .leaks import align, words_of
from .neighbours import block_keys
from .runs import whole_groups

K = 3
SIGNED, LOSS = 32, 1e-4

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, kept from batch to batch."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def run_hashes(words: np.ndarray, sizes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``k`` words, number of runs of each text) of texts laid end to end, each of at least ``k`` words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), "u8")
    for j in range(k):
        h = mix(h + words[j : j + n] + np.uint64(j + 1))
    ends = np.cumsum(sizes)
    keep = np.ones(len(words), bool)
    for j in range(1, k):
        keep[ends - j] = False
    return h[keep[: len(h)]], sizes - (k - 1)


def label_occurrences(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ for the first, second, ... occurrence of a run in its text."""
    key = mix(h + mix(text.astype("u8") + np.uint64(1)))
    o = np.argsort(key, kind="stable")
    s = key[o]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    times = np.empty(len(s), "u8")
    times[o] = np.arange(len(s)) - first
    return np.where(times > 0, mix(h + times * M2), h)


def sketches(h: np.ndarray, sizes: np.ndarray, picks: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """((tables, texts) keys, marks of the texts); ``h`` are the labelled run hashes of texts laid end to end, each of at
    least ``picks`` runs. The marks are two bits of the first pick of each of the first ``SIGNED`` tables."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, sig = np.empty((tables, len(sizes)), "u8"), np.zeros(len(sizes), "u8")
    # the place in the text replaces the lowest bits, so a minimum tells where it stands
    mask = (np.uint64(1) << np.uint64(int(sizes.max()).bit_length())) - np.uint64(1)
    keep = ~mask
    place = (np.arange(len(h)) - np.repeat(starts, sizes)).astype("u8")
    v, at = np.empty_like(h), np.empty((picks, len(sizes)), "i8")
    for t in range(tables):
        np.bitwise_xor(h, np.uint64((2 * t + 1) * 0x9E3779B97F4A7C15 % 2**64), out=v)
        v *= np.uint64(((t + 7) * 0xD1342543DE82EF95 | 1) % 2**64)
        v &= keep
        v |= place
        for p in range(picks):
            at[p] = starts + (np.minimum.reduceat(v, starts) & mask).astype("i8")
            if p + 1 < picks:
                v[at[p]] |= keep
        if t < SIGNED:
            sig |= (mix(h[at[0]] + np.uint64(t)) & np.uint64(3)) << np.uint64(2 * t)
        key = np.full(len(sizes), np.uint64(t))
        for row in np.sort(at, axis=0):
            key = mix(key * M2 + h[row])
        out[t] = key
    return out, sig


def plan(n: int, threshold: float = 0.6, miss: float = 0.001, order: float = 0.76) -> tuple[int, int]:
    """(picks, tables) for ``n`` texts: one more pick for every hundredfold beyond a million keeps chance candidates
    in proportion to the texts, and as many tables as let a pair at the threshold go unmet with the chance ``miss``,
    whatever the picks. A table is met if all picks fall among the common runs, threshold ** picks, and every next pick stands
    on the same side of the one before in both texts, ``order`` (measured on pairs at the threshold)."""
    picks = 3 + max(0, math.ceil((math.log10(max(n, 1)) - 6) / 2))
    return picks, math.ceil(math.log(miss) / math.log1p(-(threshold**picks) * order ** (picks - 1)))


def least_agreement(threshold: float, signed: int = SIGNED, loss: float = LOSS) -> int:
    """The greatest number of agreeing marks of two bits that a pair at the threshold falls short of with a chance of at
    most ``loss``: a mark agrees if the picks do, or by a chance of a quarter."""
    p, below = threshold + (1 - threshold) / 4, 0.0
    for least in range(signed + 1):
        below += math.comb(signed, least) * p**least * (1 - p) ** (signed - least)
        if below > loss:
            return least
    return signed


def prepare(texts: list[str | None], least_words: int) -> tuple[np.ndarray, list[list[str]]]:
    """(numbers of the texts with enough words, their words)."""
    at, out = [], []
    for i, t in enumerate(texts):
        if t and len(t) >= 2 * least_words - 1:
            w = words_of(t)
            if len(w) >= least_words:
                at.append(i)
                out.append(w)
    return np.array(at, "i8"), out


def classes(df: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    """(chunk_id, rep): rep is a 64-bit hash of the words, equal for texts with the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = prepare(b.column(1).to_pylist(), least_words)
            reps = np.fromiter((xxhash.xxh64_intdigest(" ".join(w)) for w in words), "u8", len(words)).view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(reps)], names=["chunk_id", "rep"])

    return _source(df, key, text, least_words).mapInArrow(run, "chunk_id string, rep long").distinct()


def _source(df: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    d = df.select(df[key].cast("string").alias("chunk_id"), df[text].alias("text"))
    return spread(d.filter(F.col("chunk_id").isNotNull() & (F.length("text") >= 2 * least_words - 1)))


def _sketch(least_words: int, picks: int, tables: int):
    """(key, rep, sig) of (chunk_id, text): rep is a 64-bit hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        for b in batches:
            _, words = prepare(b.column(1).to_pylist(), least_words)
            fresh, reps = [], []
            for w in words:
                r = xxhash.xxh64_intdigest(" ".join(w))
                if r not in seen:  # copies are sketched once a task
                    seen.add(r)
                    fresh.append(w)
                    reps.append(r)
            if len(seen) > 2_000_000:
                seen.clear()
            for i in range(0, len(fresh), 1500):
                part = fresh[i : i + 1500]
                h, n = run_hashes(known.hashes([x for w in part for x in w]), np.array([len(w) for w in part]))
                keys, sig = sketches(label_occurrences(h, np.repeat(np.arange(len(n)), n)), n, picks, tables)
                rep = np.array(reps[i : i + 1500], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view("i8")), pa.array(np.tile(rep, tables)), pa.array(np.tile(sig.view("i8"), tables))], names=["key", "rep", "sig"])

    return run


def _pairs_of(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs within each group; groups of one size are expanded together."""
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    for s in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(s), 1)
        base = starts[sizes == s][:, None]
        a.append((base + i).ravel())
        b.append((base + j).ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.array([], "i8"), np.array([], "i8"))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal marks of two bits."""
    d = x.view("u8") ^ y.view("u8")
    return SIGNED - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype("i8")


def _emit(rep: np.ndarray, sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: int):
    ok = (rep[a] != rep[b]) & (agreeing(sig[a], sig[b]) >= least)
    x, y = np.minimum(rep[a], rep[b])[ok], np.maximum(rep[a], rep[b])[ok]
    o = np.lexsort((y, x))  # pairs met in several tables
    x, y = x[o], y[o]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _buckets(block: int, least: int):
    """Pairs of buckets of at most ``block`` rows; the rows of larger ones go on with their key. A large bucket streams
    through: no more of it is held than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), "i8")  # rows of the bucket in progress that have not been passed on
        open_key, passed = None, False  # whether rows of that bucket have been passed on

        def close(t: np.ndarray, first_is_large: bool) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], t[1:, 0] != t[:-1, 0]])) if len(t) else np.array([], "i8")
            sizes = np.diff(np.append(starts, len(t)))
            large = sizes > block
            if len(large):
                large[0] |= first_is_large
            rows = np.repeat(large, sizes)
            small = t[~rows]
            at = np.flatnonzero(np.concatenate([[True], small[1:, 0] != small[:-1, 0]])) if len(small) else starts[:0]
            a, b = _emit(small[:, 1], small[:, 2], *_pairs_of(at, len(small)), least) if len(small) else (small[:, 1], small[:, 1])
            big = t[rows]
            flag = np.concatenate([np.zeros(len(a), bool), np.ones(len(big), bool)])
            cols = [np.concatenate(x) for x in ((a, big[:, 1]), (b, big[:, 2]), (np.zeros(len(a), "i8"), big[:, 0]))]
            return pa.RecordBatch.from_arrays([pa.array(flag), *map(pa.array, cols)], names=["large", "a", "b", "key"])

        for x in batches:
            t = np.concatenate([held, np.stack([x.column(i).to_numpy() for i in range(3)], axis=1)])
            t = t[np.concatenate([[True], (t[1:, :2] != t[:-1, :2]).any(axis=1)])] if len(t) else t  # copies met in several tasks
            if not len(t):
                continue
            first_large = passed and t[0, 0] == open_key
            last = len(t) - int((t[:, 0] == t[-1, 0]).sum())
            key = t[-1, 0]
            if len(t) - last > block or last == 0 and first_large:
                yield close(t, first_large)
                held, open_key, passed = t[:0], key, True
            else:
                if last:
                    yield close(t[:last], first_large)
                held, open_key, passed = t[last:], key, False
        if len(held):
            yield close(held, passed and held[0, 0] == open_key)

    return run


def _blocks(least: int):
    """Pairs of the rows of a run (one pair of blocks of a large bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3):
            a, b = _pairs_of(starts, t.num_rows)
            x, y = _emit(t.column("rep").to_numpy(), t.column("sig").to_numpy(), a, b, least)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def parts_for(df: DataFrame, rows: int, row_bytes: int, most: int = 16_000_000) -> int:
    """Partitions of a shuffle of so many rows, each of about ``most`` bytes."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * row_bytes / most))


def candidates(df: DataFrame, key: str, text: str, least_words: int, n: int, block: int = 512, threshold: float = 0.6) -> DataFrame:
    """(a, b) of classes that share a key and enough marks."""
    picks, tables = plan(n, threshold)
    least = least_agreement(threshold)
    rows = _source(df, key, text, least_words).mapInArrow(_sketch(least_words, picks, tables), "key long, rep long, sig long")
    met = rows.repartition(parts_for(df, n * tables, 48), "key").sortWithinPartitions("key", "rep")
    met = cut_lineage(met.mapInArrow(_buckets(block, least), "large boolean, a long, b long, key long"))
    large = block_keys(met.filter("large").select("key", F.col("a").alias("rep"), F.col("b").alias("sig")), ["key"], "rep", block)
    by = ["key", "bi", "bj"]
    more = large.select(*by, "rep", "sig").repartition(*by).sortWithinPartitions(*by).mapInArrow(_blocks(least), "a long, b long")
    return met.filter(~F.col("large")).select("a", "b").unionByName(more).distinct()


def sure_overlap(length: int, edits: int, runs: int, distinct: int, k: int = K) -> int:
    """Distinct runs of ``k`` words that two texts share at least, if ``length`` words of one, which has ``runs`` runs and
    ``distinct`` different ones, are aligned with ``edits`` edits: an edit breaks at most ``k`` of the runs it touches."""
    return length - (k - 1) - k * edits - (runs - distinct)


def _verify(threshold: float, exact: bool, width: int = 8):
    """Verified pairs of (a, b, text_a, text_b). With ``exact`` every pair has its similarity and its aligned share,
    in the band of ``align``; without, a pair that the alignment accepts has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts, held = Words(), {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            if held > 5_000_000:  # word codes and run sets are kept from batch to batch
                texts.clear()
                held = 0
            at = {k: (c, i) for c, ids in ((2, a_ids), (3, b_ids)) for i, k in enumerate(ids)}
            fresh = [k for k in at if k not in texts]
            if fresh:
                words = [known.hashes(words_of(b.column(c)[i].as_py())) for c, i in map(at.__getitem__, fresh)]
                h, m = run_hashes(np.concatenate(words), np.array([len(w) for w in words]))
                for k, w, x in zip(fresh, words, np.split(h, np.cumsum(m)[:-1])):
                    texts[k] = (w & np.uint64(0x7FFFFFFF)).astype("u4") + np.uint32(1), np.unique(x)
                    held += len(w)
            # sets whose sizes differ more cannot overlap enough
            able = [(x, y) for x, y in zip(a_ids, b_ids) if min(len(texts[x][1]), len(texts[y][1])) >= (threshold - 1e-12) * max(len(texts[x][1]), len(texts[y][1]))]
            out = []
            for (x, y), (length, edits) in zip(able, align([(texts[x][0], texts[y][0], 0) for x, y in able], *(() if exact else (width,)))):
                (v, p), (w, q) = texts[x], texts[y]
                if not exact and sure_overlap(length, edits, len(w) - K + 1, len(q)) * (1 + threshold) >= threshold * (len(p) + len(q)):
                    out.append((x, y, None, None))
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                similarity = both / (len(p) + len(q) - both)
                if similarity >= threshold - 1e-12:
                    out.append((x, y, similarity, max(0, length - edits) / max(len(v), len(w)) if exact else None))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["a", "b", "similarity", "aligned"])

    return run


def similar_classes(df: DataFrame, key: str = "chunk_id", text: str = "raw_content", threshold: float = 0.6, least_words: int = 30, small: int = 50_000, aligned: bool = False) -> tuple[DataFrame, DataFrame]:
    """((chunk_id, rep), (a, b, similarity, aligned)): the classes, and every verified pair of different ones. Their exact
    similarity and the share of the longer text's words that banded alignment matches are there if ``aligned``.

    The texts of candidates are picked out of the scan by a broadcast of their keys while these are at most ``small``
    (a bound on the broadcast), by a shuffled join beyond.
    """
    member = cut_lineage(classes(df, key, text, least_words))
    pairs = cut_lineage(candidates(df, key, text, least_words, member.count(), threshold=threshold))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    first = cut_lineage(member.join(ids, "rep", "left_semi").groupBy("rep").agg(F.min("chunk_id").alias("chunk_id")))
    wanted = F.broadcast(first) if first.count() <= small else first
    source = df.select(df[key].cast("string").alias("chunk_id"), df[text].alias("text"))
    texts = source.join(wanted, "chunk_id").groupBy("rep").agg(F.first("text").alias("text"))
    by = parts_for(df, pairs.count(), 4_000)
    both = pairs.repartition(by, "a").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").repartition(by, "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    found = both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold, aligned), "a long, b long, similarity double, aligned double")
    return member, cut_lineage(found)


def pair_rows(member: DataFrame, found: DataFrame, block: int = 1000) -> DataFrame:
    """(chunk_id_a, chunk_id_b, similarity, aligned) of all pairs of different keys, the smaller first. The members of a
    class are dealt into blocks of about ``block``, so a text of many copies is many tasks."""
    sizes = member.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = member.join(sizes, "rep", "left").withColumn("block", F.pmod(F.xxhash64("chunk_id"), blocks).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), blocks - 1))
    across = found
    for rep, name in (("a", "ca"), ("b", "cb")):
        across = across.join(sizes.withColumnRenamed("rep", rep), rep, "left").withColumn("block", all_blocks).drop("blocks")
        across = across.join(dealt.select(F.col("rep").alias(rep), "block", F.col("chunk_id").alias(name)), [rep, "block"]).drop("block")
    copies = dealt.filter("blocks is not null")
    x = copies.select("rep", F.col("block").alias("i"), all_blocks.alias("j"), F.col("chunk_id").alias("ca")).filter("i <= j")
    y = copies.select("rep", all_blocks.alias("i"), F.col("block").alias("j"), F.col("chunk_id").alias("cb")).filter("i <= j")
    within = x.join(y, ["rep", "i", "j"]).filter("i < j or ca < cb").select("ca", "cb", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("aligned"))
    return across.select("ca", "cb", "similarity", "aligned").unionByName(within).select(F.least("ca", "cb").alias("chunk_id_a"), F.greatest("ca", "cb").alias("chunk_id_b"), "similarity", "aligned").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(rep, root): connected components of (a, b); every node takes the least label around it and then its label's
    label, so the number of rounds is about the logarithm of the longest path. Each round is checkpointed."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = cut_lineage(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")))
    for _ in range(rounds):
        around = both.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = label.join(around, "x").select("x", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("x").alias("next"), F.col("root").alias("far"))
        new = cut_lineage(step.join(jump, "next", "left").select("x", F.least("next", "far").alias("root"), F.col("root").alias("old")))
        if new.filter("root <> old").isEmpty():
            return new.select(F.col("x").alias("rep"), "root")
        label = new.select("x", "root")
    raise RuntimeError("components did not settle")


def group_rows(member: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, group_id, n_links, n_members) of every chunk in a group of two or more: group_id is the least key of
    the group, n_links the number of other classes that the chunk's text is linked to."""
    links = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    m = member.join(components(found), "rep", "left").join(links, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    size = m.groupBy("root").agg(F.min("chunk_id").alias("group_id"), F.count("*").alias("n_members")).filter("n_members > 1")
    return m.join(size, "root").select("chunk_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_members")
