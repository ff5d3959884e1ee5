"""Evaluation texts in training text: q-gram lemma filtering in diagonal bands and banded alignment.

Texts become their words, lower-cased and joined by one blank. Every character q-gram of a document is looked up
among those of the items; a hit lies on a diagonal (place in the document minus place in the item). Two strings of
``span`` characters within ``edits`` edits share at least ``span + 1 - q * (edits + 1)`` q-grams, all within a band of
diagonals no wider than the edits; overlapping bands that count fewer hits are dropped. What is left is verified by
alignment within the band: with edits, and, for runs of ``RUN_WORDS`` equal words, of whole words without any.

The items go to every worker, which indexes them once. Their size is checked: ``MAX_CHARS`` characters at a time, more of them in further
passes over the corpus, so the memory of a worker is bounded whatever the number of items. No shuffle of the corpus.

Defined cases
  * a *word* is a longest run of letters and digits; texts without words, null and empty ones leak nothing;
  * items of fewer than ``RUN_WORDS`` words can leak by alignment only; null ids give no rows;
  * repeated documents or items count once; several passages of one item in a document give one row;
  * very long documents are handled whole; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

WORD = re.compile(r"[^\W_]+")
MAX_CHARS = 8_000_000
Q = 12
SPAN, EDITS = 100, 4
BAND = 16
RUN_WORDS = 12
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


#: Letters in lower case, digits, and a blank for anything else, for texts of these characters only.
PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + b" " * 128


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return text.encode().translate(PLAIN).decode().split() if text.isascii() else WORD.findall(text.lower())


def least_hits(span: int = SPAN, edits: int = EDITS, q: int = Q) -> int:
    return span + 1 - q * (edits + 1)


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place of an array of character codes: its characters as the digits of a number to
    ``BASE``, put together from halves of 2, 4 and 8 characters."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.array([], dtype="u8")
    power = lambda k: np.uint64(pow(int(BASE), k, 2**64))
    h, size, parts = codes.astype("u8"), 1, {}
    while size <= Q:
        parts[size] = h
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    h, done = np.zeros(n, "u8"), 0
    for size in sorted((x for x in parts if x & Q), reverse=True):  # the halves whose sizes sum up to Q
        h = h * power(size) + parts[size][done : done + n]
        done += size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


class WordPlaces:
    """The words of a text as numbers, and where they begin when joined by one blank."""

    def __init__(self, words: list[str]):
        self.code = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), "u8", len(words))
        sizes = np.fromiter(map(len, words), "i8", len(words))
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.start + sizes

    def within(self, lo: int, hi: int) -> np.ndarray:
        """The words that lie whole in [lo, hi)."""
        return self.code[np.searchsorted(self.start, lo) : np.searchsorted(self.end, hi, "right")]


def equal_run(a: np.ndarray, b: np.ndarray, words: int = RUN_WORDS) -> bool:
    """Whether an alignment without edits has so many words: equal ones along a diagonal of the table of both."""
    same = a[:, None] == b[None, :]
    run = same
    for k in range(1, words):
        run = run[:-1, :-1] & same[k:, k:]
        if not run.any():
            return False
    return bool(run.any())


class Items:
    """Index of the items of one pass: q-gram places, word runs and texts."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.texts = [" ".join(w) for w in words]
        self.words = [WordPlaces(w) for w in words]
        # the fewest hits of a band that may hold an equal run, or a span within the edits
        shortest = [min((len(" ".join(w[k : k + RUN_WORDS])) for k in range(len(w) - RUN_WORDS + 1)), default=SPAN) for w in words]
        self.need = np.array([max(1, min(n - Q + 1, least_hits())) for n in shortest], "i8")
        hs, item, place = [], [], []
        for n, t in enumerate(self.texts):
            h = qgram_hashes(codes_of(t))
            hs.append(h)
            item.append(np.full(len(h), n, "i8"))
            place.append(np.arange(len(h), dtype="i8"))
        h = np.concatenate(hs) if hs else np.array([], "u8")
        o = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[o], np.concatenate(item)[o] if hs else h, np.concatenate(place)[o] if hs else h
        self.maybe = np.zeros(1 << BITS, dtype=bool)
        self.maybe[(self.hash >> np.uint64(64 - BITS)).astype("i8")] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the codes, item, place in the item) of every shared q-gram."""
        h = qgram_hashes(codes)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype("i8")])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.array([], "i8")
        return np.repeat(at, n), self.item[k], self.place[k]


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]], width: int = BAND, at_once: int = 1000) -> list[tuple[int, int]]:
    """(length in ``b``, edits) of the best local alignment of each (a, b, diagonal) within ``width`` diagonals around
    its diagonal (place in a minus place in b): match 1, edit -2. Pairs of like length advance together, row by row of
    ``b``. A cell holds score and length in one integer, so the better of two cells is their maximum."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    w = 2 * width + 1
    one = 1 << 20  # a point of score; the length is below it
    match, edit, extra = one + 1, 1 - 2 * one, np.arange(w, dtype="i8") * (2 * one)
    none = np.uint32(0xFFFFFFFF)
    by_length = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    for chosen in (by_length[i : i + at_once] for i in range(0, len(pairs), at_once)):
        part = [pairs[i] for i in chosen]
        rows = max((len(b) for _, b, _ in part), default=0)
        # row r of near holds the characters of a that row j of b meets, from column j on
        near, other = np.full((len(part), rows + w), none, "u4"), np.full((len(part), rows), none - 1, "u4")
        for r, (a, b, diagonal) in enumerate(part):
            lo, hi = max(0, diagonal - width), min(len(a), diagonal - width + len(b) + w - 1)
            if hi > lo:
                near[r, lo - diagonal + width : hi - diagonal + width] = a[lo:hi]
            other[r, : len(b)] = b
        cell, best = np.zeros((len(part), w + 1), "i8"), np.zeros(len(part), "i8")
        for j in range(rows):
            seen = near[:, j : j + w]
            new = cell[:, :w] + np.where(seen == other[:, j : j + 1], match, edit)
            np.maximum(new, cell[:, 1:] + edit, out=new)  # b's character is extra
            new += extra  # a's characters are extra: the best cell to the left, less two points a step
            np.maximum.accumulate(new, axis=1, out=new)
            new -= extra
            new[(new < one) | (seen == none)] = 0
            cell[:, :w] = new
            np.maximum(best, new.max(axis=1), out=best)
        for i, x in zip(chosen, best.tolist()):
            length, score = x & (one - 1), x >> 20
            out[i] = length, -(-(length - score) // 3)  # a substitution lowers the score by 3, a character extra in a by 2
    return out


def region(a: np.ndarray, b: np.ndarray, diagonal: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The part of ``b`` that has the hits, with a margin, the part of ``a`` on these diagonals, and their diagonal."""
    lo, hi = max(0, first - SPAN // 2), min(len(b), last + Q + SPAN // 2)
    left = max(0, lo + diagonal - BAND)
    return a[left : hi + diagonal + BAND], b[lo:hi], lo + diagonal - left


def find(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, bool]]:
    """(text number, item number, aligned characters, edits, has equal run) of every surviving pair."""
    words = [words_of(t) for t in texts]
    joined = [" ".join(w) for w in words]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in joined])])
    codes = codes_of("\0".join(joined) + "\0")
    at, item, place = items.hits(codes)
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, "right") - 1
    diagonal = at - starts[doc] - place
    n_items, shift, span = len(items.ids), 1 << 24, 1 << 26
    keep: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for offset in (0, BAND // 2):  # overlapping bands
        band = (diagonal + offset + shift) // BAND
        key = (doc * n_items + item) * span + band
        o = np.argsort(key, kind="stable")
        k = key[o]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        enough = count >= items.need[item[o[first]]]
        for f, c in zip(first[enough], count[enough]):
            h, on = o[f], place[o[f : f + c]]
            keep.setdefault((int(doc[h]), int(item[h])), set()).add((int(band[h] * BAND - offset - shift + BAND // 2), int(on.min()), int(on.max())))
    order = [(d, i, g) for (d, i), bands in sorted(keep.items()) for g in sorted(bands)]
    coded = {d: codes_of(joined[d]) for d in {d for d, _, _ in order}}
    placed = {d: WordPlaces(words[d]) for d in coded}
    equal = set()
    for d, i, (diagonal, first, last) in order:
        if (d, i) not in equal:
            lo, hi = first, last + Q  # of the item; the same characters of the document lie on the band's diagonals
            if equal_run(placed[d].within(lo + diagonal - BAND, hi + diagonal + BAND), items.words[i].within(lo, hi)):
                equal.add((d, i))
    scored: dict[tuple[int, int], tuple[int, int]] = {}
    for (d, i, _), x in zip(order, align([region(coded[d], codes_of(items.texts[i]), *g) for d, i, g in order])):
        scored[d, i] = max(scored.get((d, i), (0, 0)), x, key=lambda y: y[0] - 3 * y[1])
    out = []
    for (d, i), (length, edits) in scored.items():
        if (d, i) in equal or length >= SPAN and edits * SPAN <= EDITS * length:
            out.append((d, i, length, edits, (d, i) in equal))
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, aligned_chars, edits, equal_run) of every document with a passage of an item."""
    it = items.select(items[item_key].cast("long").alias("i"), items[item_text].alias("t")).filter("i is not null and t is not null")
    size = it.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-size // MAX_CHARS))
    d = docs.select(docs[key].cast("long").alias("d"), docs[text].alias("t")).filter(F.col("d").isNotNull() & (F.length("t") >= 2 * RUN_WORDS - 1))
    d = spread(d)
    out = None
    for p in range(passes):
        rows = it.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).distinct().collect() if passes > 1 else it.distinct().collect()
        index = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, r.t) for r in rows]))
        found = d.mapInArrow(_finder(index, batch_chars), "doc_id long, item_id long, aligned_chars int, edits int, equal_run boolean")
        out = found if out is None else out.unionByName(found)
    by = out.groupBy("doc_id", "item_id")
    return by.agg(F.max("aligned_chars").alias("aligned_chars"), F.min_by("edits", -F.col("aligned_chars")).alias("edits"), F.max("equal_run").alias("equal_run"))


_indexes: dict[str, Items] = {}


def _finder(index, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = index.value
        if name not in _indexes:  # one pass's index a worker
            _indexes.clear()
            _indexes[name] = Items(rows)
        items = _indexes[name]
        for b in batches:
            ids, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < batch_chars):
                    chars += len(texts[end] or "")
                    end += 1
                found = find(texts[at:end], items)
                cols = list(zip(*((ids[at + d], items.ids[i], n, e, q) for d, i, n, e, q in found))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["doc_id", "item_id", "aligned_chars", "edits", "equal_run"])
                at = end

    return run
