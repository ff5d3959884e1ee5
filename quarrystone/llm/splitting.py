"""Splitting oversized texts at natural boundaries, with overlap between consecutive pieces.

A sparse table over the boundary strengths of a text answers "strongest cut in this window" in constant time; ties go
to the right. Each piece ends at the strongest cut in the permissible window of lengths, and the next one steps back
by at most ``overlap``, to a boundary where there is one. The natural boundaries themselves are read off the same index.

Strengths: paragraph 6, numbered clause 5, list item 4, table row 3, sentence 2, word 1; a window without any blank is
cut at the limit.

Defined cases
  * only texts longer than ``limit`` characters are split; null, empty and shorter ones give no rows;
  * a piece begins with the first visible character of its unit; blanks between pieces belong to the piece before;
  * page is page_num plus the form feeds before the piece; null if page_num is null or below 1;
  * repeated rows give their pieces once; a null key gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .boundaries import boundaries

WORD = 1


class RangeMax:
    """Sparse table of range maxima: position of the greatest value in [i, j), the last one of equals."""

    def __init__(self, values: np.ndarray):
        self.v = np.asarray(values)
        n = len(self.v)
        self.levels = [np.arange(n)]
        w = 1
        while 2 * w <= n:
            a = self.levels[-1][:-w]
            b = self.levels[-1][w:]
            self.levels.append(np.where(self.v[b] >= self.v[a], b, a))
            w *= 2

    def argmax(self, i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        a, b = self.levels[k][i], self.levels[k][j - (1 << k)]
        return int(b if self.v[b] >= self.v[a] else a)


#: Whether a character is a blank; no blank has a higher code.
BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


def word_starts(text: str) -> np.ndarray:
    """Offsets of visible characters that follow a blank."""
    blank = BLANK[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x3001)]
    return np.flatnonzero(~blank[1:] & blank[:-1]) + 1


class Cuts:
    """The places where a text may be cut, their strengths, and the index that answers all questions about them."""

    def __init__(self, text: str):
        words, natural = word_starts(text), boundaries(text)
        self.n = len(text)
        self.at = np.union1d(words, np.array([p for p, _ in natural], "i8")).astype("i8")
        self.strength = np.full(len(self.at), WORD, "i4")
        self.strength[np.searchsorted(self.at, [p for p, _ in natural])] = [s for _, s in natural]
        self.top = RangeMax(self.strength)

    def strongest(self, lo: int, hi: int) -> int:
        """The offset of the strongest place in [lo, hi), the last of equals; -1 if there is none."""
        i, j = np.searchsorted(self.at, (lo, hi)).tolist()
        return int(self.at[self.top.argmax(i, j)]) if i < j else -1

    def natural(self) -> list[tuple[int, int]]:
        """(offset, strength) of all natural boundaries in order: the strongest place of the text, of what is to the left of it
        and of what is to the right, and so on until only word starts are left."""
        out, open_ = [], [(0, len(self.at))]
        while open_:
            i, j = open_.pop()
            if i < j and self.strength[k := self.top.argmax(i, j)] > WORD:
                out.append(k)
                open_ += [(i, k), (k + 1, j)]
        return [(int(self.at[k]), int(self.strength[k])) for k in sorted(out)]

    def pieces(self, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
        """(start, end) of the pieces; consecutive pieces share at most ``overlap`` characters."""
        out, start = [], 0
        while self.n - start > limit:
            end = self.strongest(start + max(1, overlap + 1, int(limit * least)), start + limit + 1)
            torn = end < 0
            end = start + limit if torn else end
            out.append((start, end))
            i, j = np.searchsorted(self.at, (end - overlap, end))
            nxt = end - overlap if torn else end
            if i < j:  # the earliest natural boundary in reach, else the earliest word
                good = np.flatnonzero(self.strength[i:j] > WORD)
                nxt = int(self.at[i + (good[0] if len(good) else 0)])
            start = max(nxt, start + 1)
        out.append((start, self.n))
        return out


def cuts(text: str, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one not longer than ``limit`` is one piece."""
    return Cuts(text).pieces(limit, overlap, least) if len(text) > limit else [(0, len(text))]


def _oversized(df: DataFrame, key: str, text: str, page: str | None, limit: int) -> DataFrame:
    cols = [df[key].cast("string").alias("chunk_id"), df[text].alias("text"), (df[page].cast("long") if page else F.lit(None).cast("long")).alias("page")]
    return spread(df.filter(df[key].isNotNull() & (F.length(df[text]) > limit)).select(*cols))


def pieces(df: DataFrame, key: str = "chunk_id", text: str = "raw_content", page: str | None = "page_num", limit: int = 1800, overlap: int = 200) -> DataFrame:
    """(chunk_id, piece_no, start_char, n_chars, page, piece) of every text longer than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                feeds = np.flatnonzero(np.fromiter((c == "\f" for c in t), dtype=bool, count=len(t))) if "\f" in t else np.array([], "i8")
                for i, (s, e) in enumerate(cuts(t, limit, overlap)):
                    rows.append((k, i, s, e - s, p + int(np.searchsorted(feeds, s)) if p and p > 0 else None, t[s:e]))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["chunk_id", "piece_no", "start_char", "n_chars", "page", "piece"])

    return _oversized(df, key, text, page, limit).mapInArrow(run, "chunk_id string, piece_no int, start_char long, n_chars long, page long, piece string").dropDuplicates(["chunk_id", "piece_no"])


def boundary_rows(df: DataFrame, key: str = "chunk_id", text: str = "raw_content", limit: int = 1800, overlap: int = 200) -> DataFrame:
    """(chunk_id, start_char, strength, cut) of the natural boundaries in the splitter's index, for every text longer than
    ``limit``; cut tells whether a piece ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index = Cuts(t)
                ends = {e for _, e in index.pieces(limit, overlap)}
                rows += [(k, p, s, p in ends) for p, s in index.natural()]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.bool_()))], names=["chunk_id", "start_char", "strength", "cut"])

    return _oversized(df, key, text, None, limit).mapInArrow(run, "chunk_id string, start_char long, strength int, cut boolean").distinct()
