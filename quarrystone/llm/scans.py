"""Repair of text from scanned pages: furniture lines, words cut at line ends, misread characters.

1. One pass counts every word of the corpus by the documents that hold it, in scanned text and in other text; the halves
   of words cut at line ends do not count. The words that a small share of all documents has are the *ordinary* words,
   unless they are misreadings: words of scanned text that undoing a confusion turns into a word many times as
   frequent (``without_misreadings``). Their number is bounded by (words of a document) / share, however large the
   corpus, so that table may be broadcast (the bound is checked).
2. A second pass marks the lines of every text. Every line of a scanned text (or one with form feeds) that heads or ends a
   page, two deep, whatever its form or length, is grouped by document and folded form (letters that scanners confuse
   are folded, numbers dropped) and is furniture if that form stands at the edges of at least two pages with different
   body lines beside it; three if it may be a sentence, fills the line, or stands in a table. Page numbers, and lines at
   an edge of a usual header's form, count at once. A line inside a page needs, besides such a form, the end of a page
   there (a page number, a sentence that goes on behind it, its own like) or repetition at edges. Word ends cut by
   a hyphen are joined by the corpus vocabulary; a rare word that becomes an ordinary one by undoing known confusions
   is misread.
3. ``repair`` removes the furniture, undoes breaks and misreadings and joins lines into paragraphs.

Defined cases
  * lines are separated by "\\n" and counted from 1; a carriage return at the end is no part of the line;
  * null, empty and blank texts have no marks and come out unchanged, as does any text without marks;
  * repeated rows count once; a null document id makes a document of its own for the chunk; a null chunk id gives no rows;
  * very long texts are handled whole, line by line; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

#: What a scanner reads, and what was printed.
CONFUSIONS = [
    ("é", "e"), ("c", "e"), ("f", "t"), ("l", "i"), ("ri", "n"), ("@", "a"), ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("|", "l"), ("|", "i"),
    ("cl", "d"), ("ii", "u"), ("rn", "m"), ("¢", "c"), ("9", "g"), ("b", "h"), ("6", "b"), ("h", "li"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("rm", "nn"),
    ("è", "e"), ("ê", "e"), ("$", "s"), ("!", "l"), ("!", "i"), ("8", "b"), ("i", "l"), ("e", "c"), ("t", "f"), ("h", "b"), ("n", "ri"), ("u", "ii"), ("3", "e"), ("4", "a"), ("€", "e"), ("£", "e"), ("w", "vv"), ("li", "h"), ("nn", "rm"), ("o", "c"), ("c", "o"), ("u", "n"), ("n", "u"), ("a", "o"), ("o", "a"),
]
CUT_MARKS = "-‐\xad¬"
MAX_ORDINARY = 2_000_000

WORD = re.compile(r"[^\W_]+(?:['’\-‐][^\W_]+)*")
#: A word as a scanner may have left it: letters, digits and the signs that stand for letters.
RAW_WORD = re.compile(r"[^\W_](?:[^\W_]|[@|¢$!€£](?=[^\W_]|[@|¢$!€£])|[@|¢$€£]|['’\-‐](?=[^\W_]))*|[@|¢$€£](?:[^\W_]|[@|¢$€£]|['’\-‐](?=[^\W_]))+")
LETTERS = re.compile(r"[^\W\d_]")


# ------------------------------------------------------------------ vocabulary


#: Where a text was found to hold a word.
SCANNED, PRINTED = 1, 2
#: A word cut by a line end, both halves: neither is a word of its own.
CUT_WORD = re.compile(rf"(?<!\S)\S+[{re.escape(CUT_MARKS)}][^\S\n]*\n\s*\S+")


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: dict[int, tuple[set[str], set[str]]] = {}

    def out() -> pa.RecordBatch:
        d, words, seen = [], [], []
        for doc, (scan, print_) in docs.items():
            both = scan & print_
            for part, bits in ((both, SCANNED | PRINTED), (scan - both, SCANNED), (print_ - both, PRINTED)):
                d.append(np.full(len(part), doc, "i8"))
                words += part
                seen.append(np.full(len(part), bits, "i1"))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(d)), pa.array(words, pa.string()), pa.array(np.concatenate(seen))], names=["d", "word", "seen"])

    n = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                scan = "\n" in text and (scanned(list(map(str.strip, text.split("\n")))) or "\f" in text)
                words = docs.setdefault(doc, ({""}, {""}))[0 if scan else 1]
                n -= len(words)
                words.update(WORD.findall((CUT_WORD.sub(" ", text) if scan else text).lower()))
                n += len(words)
        if n > 500_000:
            yield out()
            docs.clear()
            n = 0
    if docs:
        yield out()


def word_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(word, n, n_scanned, n_printed): documents that hold the word, those that hold it in scanned text, and in other text;
    the empty word has the number of all documents. Documents are told apart by a 64-bit hash; the words of a document
    are combined in the map before the distinct pairs are shuffled, so batches and partitions do not matter."""
    part = spread(df.select(F.xxhash64(F.coalesce(df[doc].cast("string"), F.lit(""))).alias("d"), df[text].alias("t")))
    pairs = part.mapInArrow(_words_of, "d long, word string, seen byte").groupBy("word", "d").agg(F.bit_or("seen").alias("seen"))
    held = lambda bit: F.count_if(F.col("seen").bitwiseAND(F.lit(bit)) != 0)
    return pairs.groupBy("word").agg(F.count("*").alias("n"), held(SCANNED).alias("n_scanned"), held(PRINTED).alias("n_printed"))


def ordinary_words(counts: DataFrame, share: float = 0.0005) -> dict[str, int]:
    """The words that ``share`` of all documents have, but for those that are misreadings of another, with their documents."""
    counts = cut_lineage(counts)  # a row for a word
    total = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("word") != "") & (F.col("n") >= total * share)).filter(~F.col("word").rlike(r"\d")).limit(MAX_ORDINARY + 1).collect()
    if len(rows) > MAX_ORDINARY:
        raise ValueError("more ordinary words than fit a broadcast; raise the share")
    return without_misreadings({r.word: (r.n, r.n_scanned, r.n_printed) for r in rows})


def without_misreadings(counts: dict[str, tuple[int, int, int]], times: int = 5, odds: float = 0.2) -> dict[str, int]:
    """Documents of each word that is no misreading. A word is one if undoing one confusion gives a word of at least
    ``times`` as many documents and it keeps to scanned text: its documents with it in other text, by those with it in
    scanned text, are at most ``odds`` of the other word's. Where the other word has only scanned text too, four times as
    many documents are asked for; of a word that one or two documents have, odds say nothing and the number decides. The
    rule is the same for a corpus of any size."""

    def misreading(w: str, n: int, scans: int, prints: int) -> bool:
        for v in undone(w):
            m, s, p = counts.get(v, (0, 0, 0))
            if m >= times * n and (n <= 2 or scans and (prints * s <= odds * scans * p if p else prints == 0 and m >= 4 * times * n)):
                return True
        return False

    return {w: n for w, (n, scans, prints) in counts.items() if not misreading(w, n, scans, prints)}


# ------------------------------------------------------------------ misread words


def undone(word: str) -> Iterator[str]:
    """Forms of a word with one confusion undone in one place, or one confusion undone in all its places."""
    for seen, printed in CONFUSIONS:
        at = word.find(seen)
        n = 0
        while at >= 0:
            yield word[:at] + printed + word[at + len(seen) :]
            at = word.find(seen, at + 1)
            n += 1
        if n > 1:
            yield word.replace(seen, printed)


def too_short(w: str) -> bool:
    """Whether a word has too few characters to be told from a misread one: two letters, which may be a word cut off."""
    return len(w) < 3 and (len(w) < 2 or w.isalpha())


def corrected(word: str, ordinary: dict[str, int]) -> str | None:
    """The ordinary word that ``word`` is a misreading of, or None."""
    w = word.lower()
    if w in ordinary or too_short(w) or not LETTERS.search(w):
        return None
    best, best_n = None, 0
    for v in undone(w):
        n = ordinary.get(v, 0)
        if n > best_n:
            best, best_n = v, n
    if best is None and len(w) > 4:
        for v in undone(w):
            for u in undone(v):
                n = ordinary.get(u, 0)
                if n > best_n:
                    best, best_n = u, n
    if best is None or len(best) < min(3, len(w)):
        return None
    return best


# ------------------------------------------------------------------ furniture

NUMBER = r"(?:\d{1,4}|[ivxlcdm]{1,7})"
FOLD = str.maketrans({"1": "l", "|": "l", "i": "l", "!": "l", "0": "o", "c": "e", "é": "e", "è": "e", "@": "a", "5": "s", "$": "s", "9": "g", "¢": "e", "6": "h", "b": "h", "f": "t", "8": "h"})
PAGE_NUMBER = re.compile(rf"^(?:[-–—*\[(]?\s*{NUMBER}\s*[-–—*\])]?|[p][a@]?[g9][eéc]?\.?\s*\d+(?:\s*(?:of|0f|ot|/)\s*\d+)?|\d+\s*/\s*\d+)$", re.I)
BARE_NUMBER = re.compile(rf"^{NUMBER}$", re.I)
LEFT_NUMBER = re.compile(r"^\d{1,4}\s+\|\s+(\S.*)$")
RIGHT_NUMBER = re.compile(r"^(\S.*?)\s{3,}\d{1,4}$")
STARRED = re.compile(r"^\*\s+(\S.*?)\s+\*$")
FILE_NO = re.compile(r"^\w+(?: \w+)? \S{3,5} no\. ?\S+$", re.I)
CONFIDENTIAL = re.compile(r"^\S{10,14} [–—-] \S.*$")
TITLE_DATE = re.compile(r"^[^\W\d]\S+(?: \S+){1,3} (?:\S{1,2} \S+ \S{4}|\S+ \S{1,2}, \S{4}|\S{4}-\S{2}-\S{2}|\S{1,2}\.\S{1,2}\.\S{4})$")
#: A place and date under a signature, which is text: "Signed at Lowfield, 3 May 2004".
DATED_PLACE = re.compile(r"[^\W\d]{3,}, [^\W\d]{3,} \d|[^\W\d]{3,}, \d{1,2} [^\W\d]|, \d{4}-\d\d-|, \d{1,2}\.\d{1,2}\.|[^\W\d]{3,}, [^\W\d]{3,} \S{1,2}, ")
NAME_TITLE = re.compile(r"^\S.* [–—] [^\W\d]\S+$")
MAY_BE_FURNITURE = re.compile(r"[\d–—*|]|^[^a-z]*$|^[ivxlcdm]{1,7}$")
CLAUSE_NUMBER = re.compile(r"^\d+(?:\.\d+)*[.)] ")
#: Between the cells of a table row.
CELLS = re.compile(r"\S(?:\t| \| | {2,}[;|] +| {3,})\S")
ENDS = ".?!;:,"
MONTHS = "january february march april may june july august september october november december".split()


def fold(line: str) -> str:
    """Form of a line that survives misread characters, letter case, numbers and marks around it."""
    s = re.sub(r"\s+", " ", line.lower())
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        s = s.replace(a, b)
    s = re.sub(r"[^\w ]|_", "", s.translate(FOLD))
    return re.sub(r"\d+", "", s).strip()


def header_form(line: str) -> tuple[str, bool]:
    """(text of a running header without number and marks, whether number or marks show that it is one)."""
    for p in (LEFT_NUMBER, RIGHT_NUMBER, STARRED):
        m = p.match(line)
        if m and not line.rstrip("*").rstrip().endswith((".", ";", ",")) or m and FILE_NO.match(m.group(1)):
            return m.group(1), True
    return line, False


def header_like(text: str) -> bool:
    """Whether a text has one of the usual forms of a running header."""
    if len(text) > 70:
        return False
    low = text.lower()
    if FILE_NO.match(text) and re.search(r"\d", text) and _close(low.split()[-3] if len(low.split()) > 2 else "", "file"):
        return True
    if CONFIDENTIAL.match(text) and _close(low.split()[0], "confidential"):
        return True
    if NAME_TITLE.match(text):
        return True
    if TITLE_DATE.match(text) and not text.endswith(".") and " of " not in text and not DATED_PLACE.search(text):
        return bool(re.search(r"\d{4}-\d\d-\d\d$|\d{1,2}\.\d{1,2}\.\d{4}$", text)) or any(_close(w.strip(","), m) for w in low.split() for m in MONTHS)
    return False


def _close(a: str, b: str) -> bool:
    return fold(a) == fold(b)


def scanned(lines: list[str]) -> bool:
    """Whether a text has lines of a fixed measure, as pages have: several lines that go on in the next one."""
    long = [x for x in lines if len(x) >= 30]
    return sum(1 for x in long if x[-1:].isalnum() or x[-1] in CUT_MARKS + ",'’") >= 2


def in_ledger(bare: list[str], full: list[int], k: int) -> bool:
    """Whether a line that ends or begins with a number stands beside another such line of other words."""
    own = header_form(bare[full[k]])[0]
    beside = [header_form(bare[full[j]]) for j in (k - 1, k + 1) if 0 <= j < len(full)]
    return any(marked and not header_like(x) and not _close(x, own) for x, marked in beside)


# ------------------------------------------------------------------ marks of a text


def key_of(line: str) -> str:
    """What repeats of a running line: its folded form, with the number of a clause, and without page number and marks."""
    form = header_form(line)[0]
    folded = fold(form)
    number = CLAUSE_NUMBER.match(form)
    return xxhash.xxh64_hexdigest((number.group() if number else "") + folded) if folded else ""


def pages_of(lines: list[str]) -> list[list[int]]:
    """Places of the lines with text, page by page; a form feed at the start or the end of a line is a change of page."""
    out: list[list[int]] = [[]]
    for i, x in enumerate(lines):
        blank = not x.strip()
        if "\f" in x and (blank or not x.split("\f")[0].strip()):
            out.append([])
        if not blank:
            out[-1].append(i)
            if "\f" in x and x.split("\f")[0].strip():
                out.append([])
    return [x for x in out if x]


def running(bare: list[str], pages: list[list[int]], gone: set[int], numbers: set[int], measure: int) -> Iterator[tuple[int, str]]:
    """(place, "key, context, pages") of the lines that head or end a page, two deep, whatever their form. The line is furniture
    if so many pages (0: it only bears witness) with different contexts have its key at their edges. The context is the body line
    next to it, so copies of one page count once."""
    for page in pages:
        body = [i for i in page if i not in gone]
        for seq, rest in ((page, body), (page[::-1], body[::-1])):
            context = xxhash.xxh64_hexdigest(fold(bare[rest[min(2, len(rest) - 1)]])) if rest else ""
            for i in seq[:3]:
                if i not in gone:
                    break
                if i not in numbers and (key := key_of(bare[i])):
                    yield i, f"{key}\t{context}\t0"
            above = ""
            for i, inward in zip(rest[:2], rest[1:3]):
                line, beside = bare[i], bare[inward]
                key = key_of(line)
                words = line.split()
                marked = header_form(line)[1]
                if not key or line[0].islower() or len(words) == 1 and (line[-1] in ENDS or " " not in beside) or not marked and CELLS.search(line) and CELLS.search(beside):
                    break
                doubtful = line[-1] in ENDS and not marked or len(line) > 0.8 * measure or marked and header_form(beside)[1]
                yield i, f"{above}{key}\t{context}\t{3 if doubtful else 2}"
                above = key


def clean_lines(text: str) -> list[str]:
    return text.split("\n")


def edges(text: str) -> list[tuple[int, str]]:
    """(line number, stripped line) of the lines that may be furniture, by form alone."""
    out = []
    for n, raw in enumerate(clean_lines(text), 1):
        line = raw.strip(" \t\r\f\v\xa0")
        if not line or len(line) > 80 or not MAY_BE_FURNITURE.search(line):
            continue
        if PAGE_NUMBER.match(line):
            out.append((n, line))
        else:
            form, marked = header_form(line)
            if marked or header_like(form) or (form.isupper() and header_like(form.title().replace(" No. ", " No. "))):
                out.append((n, line))
    return out


def marks(text: str, ordinary: dict[str, int]) -> list[tuple[int, str, str]]:
    """(line number, noise, detail): ``furniture`` with an empty detail is sure, with a key it hangs on repetition at page
    edges; ``edge`` is a line at a page edge (see ``running``);
    the detail of ``break`` is the joined word's verdict, of ``misread`` the corrections as seen=printed."""
    lines = [x.rstrip("\r") for x in clean_lines(text)]
    bare = [x.strip(" \t\f\v\xa0") for x in lines]
    full = [i for i, x in enumerate(bare) if x]
    if not full:
        return []
    is_scan = scanned(bare)
    out: list[tuple[int, str, str]] = []
    gone: set[int] = set()
    numbers: set[int] = set()
    place = {i: k for k, i in enumerate(full)}
    unsure: list[int] = []
    wide = sorted(len(x) for x in bare if x)
    measure = wide[int(len(wide) * 0.8)]
    page = is_scan and wide[-1] <= 100
    for n, line in edges(text):
        i = n - 1
        first = not any(bare[:i]) or "\f" in lines[i] or any("\f" in x for x in lines[max(0, i - 2) : i] if not x.strip())
        last = not any(bare[i + 1 :]) or any("\f" in x for x in lines[i + 1 : i + 3])
        edge = first or last
        if PAGE_NUMBER.match(line):
            weak = BARE_NUMBER.match(line)
            if weak and line.isalpha() and not edge and not line.islower():
                continue
            beside = [bare[full[j]] for j in (full.index(i) - 1, full.index(i) + 1) if 0 <= j < len(full)]
            known = any(x == line or header_like(header_form(x)[0]) or PAGE_NUMBER.match(x) and not BARE_NUMBER.match(x) for x in beside)
            # words of a torn line stand alone beside a number; beside a page number stand whole lines or sentence ends
            whole = beside and measure > 25 and all(len(x) > 0.5 * measure or x[-1] in ".?!;:" and len(x) > 3 and " " in x for x in beside)
            if not weak and (edge or is_scan) or known and len(full) > 2 or weak and (whole or edge and len(full) > 1 and (page or any(len(x) > 25 for x in beside)) or page and any(BARE_NUMBER.match(x) for x in beside)):
                gone.add(i)
            if i in gone:
                numbers.add(i)
                out.append((n, "furniture", ""))
            continue
        form, marked = header_form(line)
        like = header_like(form)
        if edge and (marked and (like or not in_ledger(bare, full, place[i])) or like and len(full) > 2):
            gone.add(i)
            out.append((n, "furniture", ""))
        elif like or marked:
            unsure.append(i)
    for again in (0, 1):
        for i in unsure:
            if i in gone:
                continue
            k = place[i]
            form = header_form(bare[i])[0]
            like = header_like(form)
            near = [full[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
            lo, hi = k - 1, k + 1  # a footer and the header of the next page may be equal
            while lo >= 0 and (full[lo] in gone or full[lo] in unsure and _close(header_form(bare[full[lo]])[0], form)):
                lo -= 1
            while hi < len(full) and (full[hi] in gone or full[hi] in unsure and _close(header_form(bare[full[hi]])[0], form)):
                hi += 1
            before, after = bare[full[lo]] if lo >= 0 else "", bare[full[hi]] if hi < len(full) else ""
            # the page ends here: a page number or its own like beside it, or the sentence goes on behind it
            inside = before and form[0].isupper() and not header_form(before)[1] and len(before) > 0.5 * measure
            open_before = inside and before[-1] not in ".?!;:\""
            goes_on = inside and after and not header_form(after)[1] and (after[0].islower() and (is_scan or open_before) or open_before and before[-1] in CUT_MARKS)
            twin = hi - lo > 2 and any(j in unsure and _close(header_form(bare[j])[0], form) for j in near)
            if len(full) > 2 and (goes_on or twin or is_scan and like and open_before or any(j in (gone if like else numbers) for j in near) and (like or not in_ledger(bare, full, k))):
                gone.add(i)
                out.append((i + 1, "furniture", ""))
            elif again:
                out.append((i + 1, "furniture", key_of(bare[i])))
    pages = pages_of(lines)
    if len(full) > 2 and (is_scan or len(pages) > 1):
        out += [(i + 1, "edge", x) for i, x in running(bare, pages, gone, numbers, measure)]
    body = [i for i in full if i not in gone]
    for k, i in enumerate(body):
        line = bare[i]
        skip_last = skip_first = None
        nxt = bare[body[k + 1]] if k + 1 < len(body) else ""
        if line[-1] in CUT_MARKS and len(line) > 1 and nxt:
            head, tail = WORDISH_END.search(line[:-1]), WORDISH_START.match(nxt)
            if head and tail:
                if cut(head.group(), tail.group(), line[-1], ordinary):
                    out.append((i + 1, "break", ""))
                skip_last = head.start()
        prev = bare[body[k - 1]] if k else ""
        if prev and prev[-1] in CUT_MARKS and len(prev) > 1:
            head, tail = WORDISH_END.search(prev[:-1]), WORDISH_START.match(line)
            if head and tail:
                skip_first = tail.end()
        if len(full) < 2 or skip_last is None and skip_first is None and all(dull(x, ordinary) for x in line.split()):
            continue
        found = []
        for m in RAW_WORD.finditer(line):
            w = m.group()
            if skip_last is not None and m.start() >= skip_last:
                fixed = broken_misread(w.rstrip(CUT_MARKS), nxt, ordinary, True)
            elif skip_first is not None and m.end() <= skip_first:
                fixed = broken_misread(w, prev, ordinary, False)
            else:
                fixed = misread(w, m.start() == 0 or line[: m.start()].rstrip()[-1:] in (".", "?", "!", '"', ":", ")"), ordinary)
            if fixed:
                found.append(f"{w}={fixed}")
        if found:
            out.append((i + 1, "misread", "\t".join(found)))
    return out


WORDISH_END = re.compile(r"[^\s\"“”(),;:]*[^\W_]$")
WORDISH_START = re.compile(r"[^\s\"“”(),;:.?!]*[^\W_]")


_dull: set[str] = set()
_dull_of: list[int] = [0]


def dull(token: str, ordinary: dict[str, int]) -> bool:
    """Whether no word between these blanks can be a misread one; answers are kept for the worker's one vocabulary."""
    if token in _dull:
        return True
    if _dull_of[0] != id(ordinary) or len(_dull) > 300_000:
        _dull.clear()
        _dull_of[0] = id(ordinary)
    if any(misread(w, True, ordinary) for w in RAW_WORD.findall(token)):
        return False
    _dull.add(token)
    return True


def misread(w: str, opens: bool, ordinary: dict[str, int]) -> str | None:
    """The correction of a word, or None."""
    if w.lower() in ordinary or too_short(w):
        return None
    parts = re.split(r"([-‐])", w)
    if len(parts) > 1:  # a compound: each part for itself
        fixed = [misread(p, opens, ordinary) or p for p in parts]
        return "".join(fixed) if fixed != parts else None
    signs = any(not c.isalpha() or not c.isascii() for c in w)
    digits = sum(c.isdigit() for c in w)
    if w.isupper() and len(w) > 1 or digits > len(w) / 2 or digits and w[0].isupper() and w.isupper():
        return None
    if w[0].isupper() and not opens and not signs:
        return None  # a name
    v = corrected(w, ordinary)
    if v and w[0].isupper() and not opens and ordinary.get(v, 0) < 1:
        return None
    return v


def broken_misread(w: str, other: str, ordinary: dict[str, int], first: bool) -> str | None:
    """Correction of the half of a cut word that stands in this line."""
    m = (WORDISH_START.match(other) if first else WORDISH_END.search(other[:-1])) if other else None
    if not m:
        return None
    whole = (w + m.group() if first else m.group() + w).lower()
    if whole in ordinary or len(whole) < 4 or any(c.isdigit() for c in whole) and not LETTERS.search(w):
        return None
    cutat = len(w) if first else len(m.group())
    for seen, printed in CONFUSIONS:
        at = whole.find(seen)
        while at >= 0:
            if whole[:at] + printed + whole[at + len(seen) :] in ordinary and (at < cutat) == first:
                half = whole[:cutat] if first else whole[cutat:]
                k = at if first else at - cutat
                return half[:k] + printed + half[k + len(seen) :]
            at = whole.find(seen, at + 1)
    return None


def cut(head: str, tail: str, mark: str, ordinary: dict[str, int]) -> bool:
    """Whether head and tail are one word that was cut only to fit the line."""
    h, t = head.lower(), tail.lower()
    if mark in "\xad¬":
        return True
    if not tail[0].islower() and not tail[0] in "@|¢0123456789é":
        return False
    if h[-1:].isdigit() or not LETTERS.search(h):
        return False
    joined, kept = ordinary.get(h + t, 0), max(ordinary.get(f"{h}-{t}", 0), ordinary.get(f"{h}‐{t}", 0))
    if joined or kept:
        return joined >= kept
    if "-" in h:  # a compound with one of its parts cut, as in no-claims
        last = h.rsplit("-", 1)[1]
        if ordinary.get(last + t, 0) or ordinary.get(h + t, 0):
            return True
    v, x = corrected(h + t, ordinary), corrected(f"{h}-{t}", ordinary)
    if v and not x:
        return True
    if x:
        return False
    return not (ordinary.get(h, 0) and ordinary.get(t, 0))


# ------------------------------------------------------------------ plans


def line_marks(df: DataFrame, ordinary: Broadcast, key: str = "chunk_id", doc: str = "doc_id", text: str = "raw_content") -> DataFrame:
    """(chunk_id, line_no, noise, detail), one row per line and kind; furniture lines have only that row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ordinary.value
        for b in batches:
            rows = []
            for k, d, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows += [(k, d, *m) for m in marks(t, words)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                names=["chunk_id", "doc", "line_no", "noise", "detail"],
            )

    t = df.select(df[key].cast("string").alias("k"), F.coalesce(df[doc].cast("string"), df[key].cast("string")).alias("d"), df[text].alias("t"))
    t = spread(t.filter(F.col("k").isNotNull() & F.col("t").rlike(r"\S")))
    found = t.mapInArrow(run, "chunk_id string, doc string, line_no long, noise string, detail string").distinct()
    found = cut_lineage(found)  # read by three branches; it has a row for a marked line only
    # a line is a running one if the edges of other pages of the document have it too
    parts = F.split("detail", "\t")
    edge = found.filter("noise = 'edge'").select("chunk_id", "doc", "line_no", parts[0].alias("key"), parts[1].alias("context"), parts[2].cast("int").alias("pages"))
    seen = edge.groupBy("doc", "key").agg(F.count_distinct("context").alias("n")).filter("n > 1")
    unsure = found.filter((F.col("noise") == "furniture") & (F.col("detail") != "")).select("chunk_id", "doc", "line_no", F.col("detail").alias("key"), F.lit(2).alias("pages"))
    again = edge.filter("pages > 0").drop("context").unionByName(unsure).join(seen, ["doc", "key"]).filter("n >= pages")
    again = again.select("chunk_id", "doc", "line_no", F.lit("furniture").alias("noise"), F.lit("").alias("detail"))
    sure = found.filter((F.col("noise") != "edge") & ((F.col("noise") != "furniture") | (F.col("detail") == ""))).unionByName(again)
    lines = sure.filter("noise = 'furniture'").select("chunk_id", "line_no").distinct()
    rest = sure.filter("noise <> 'furniture'").join(lines, ["chunk_id", "line_no"], "left_anti").select("chunk_id", "line_no", "noise", "detail")
    return lines.withColumn("noise", F.lit("furniture")).withColumn("detail", F.lit("")).unionByName(rest)


def repair_text(text: str, noise: list[tuple[int, str, str]]) -> str:
    """Continuous paragraphs of a text with marks; a text without marks is returned as it is."""
    if not noise:
        return text
    kind: dict[int, dict[str, str]] = {}
    for n, what, detail in noise:
        kind.setdefault(n, {})[what] = detail
    paragraphs, now, glue = [], "", False
    for n, raw in enumerate(text.split("\n"), 1):
        marks_here = kind.get(n, {})
        line = raw.strip()
        if "furniture" in marks_here:
            continue
        if not line:
            if now and now[-1] in '.?!;:"”)' and not glue:
                paragraphs.append(now)
                now = ""
            continue
        for pair in marks_here.get("misread", "").split("\t"):
            seen, eq, printed = pair.partition("=")
            if eq:
                line = line.replace(seen, printed[:1].upper() + printed[1:] if seen[:1].isupper() else printed, 1)
        line = re.sub(r"[ \t\xa0\f]+", " ", line)
        if not now or glue:
            now += line
        elif now[-1] in CUT_MARKS and len(now) > 1 and now[-2].isalnum():
            now += line  # a hyphen the word has anyway
        else:
            now += " " + line
        glue = "break" in marks_here
        if glue and now[-1] in CUT_MARKS:
            now = now[:-1]
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


def repair(df: DataFrame, found: DataFrame, key: str = "chunk_id", text: str = "raw_content") -> DataFrame:
    """(chunk_id, clean, n_marks) of every chunk; the lines' marks meet their text in one join on the chunk."""
    per = found.groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "noise", "detail")).alias("noise"))
    base = df.select(df[key].cast("string").alias("chunk_id"), df[text].alias("text")).filter("chunk_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            noise = [[(x["line_no"], x["noise"], x["detail"]) for x in n or []] for n in b.column(2).to_pylist()]
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t and repair_text(t, n) for t, n in zip(texts, noise)], pa.string()), pa.array([len(n) for n in noise], pa.int32())],
                names=["chunk_id", "clean", "n_marks"],
            )

    once = base.join(per, "chunk_id", "left").dropDuplicates(["chunk_id"])  # on the partitions of the join: texts travel once
    return once.mapInArrow(run, "chunk_id string, clean string, n_marks int")
