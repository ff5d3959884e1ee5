"""Natural boundaries of a text: where sentences, list items, table rows and numbered clauses begin.

Fixed rules over lines and sentence ends; offsets are characters. Used to split oversized texts and to count sentences.
"""

from __future__ import annotations

import re

SENTENCE, ROW, ITEM, CLAUSE, PARAGRAPH = 2, 3, 4, 5, 6

#: Words whose full stop never ends a sentence, lower-cased without the stop.
NEVER = set(
    "art arts sec secs no nos nr approx i.e e.g v vs cf mr mrs ms dr prof st fig figs para paras p pp vol ch cl al ca bzw z.b d.h u.a abs ziff vgl rz núm pto pág p.ej sr sra sres av ed eds ref refs jan feb mar apr jun jul aug sept oct nov dec tel ext incl resp m mm mme mlle n.° lit s.o s.u i.d.r gem usw.u bspw evtl ggf inkl zzgl".split()
)
#: Ends of company names: the stop ends a sentence only if the next word cannot belong to the name.
COMPANY = {"inc", "ltd", "co", "corp", "s.a", "s.l", "s.r.l", "s.p.a", "b.v", "n.v", "plc", "llc", "bros", "jr", "sr", "e.v"}
AFTER_COMPANY = re.compile(r"(?:Board|Group|Holdings|Partners|Ltd|LLC|plc|GmbH|Inc|Corp|Co)\b")
LETTER_OF = re.compile(r"(?:Schedule|Annex|Appendix|Exhibit|Part|Class|Series|Section|Anlage|Anexo|Annexe)\s+$")

STOP = re.compile(r"[.?!…。！？](?:[\"”»’')\]]+(?=\s|$))?")
MARK = re.compile(r"(?:[•▪◦‣·*–—-]|\(?[a-z]{1,2}[.)]|\(?[ivx]{1,4}\)|\(\d{1,3}\)|\[\d{1,4}\]|\d{1,3}[.)]|\d{1,3}(?:\.\d{1,3}){1,3}\.?|§\s?\d+\.?)[ \t\xa0]+(?=\S)")
NUMBERED = re.compile(r"(?:\(\d{1,3}\)|\[\d{1,4}\]|\d{1,3}[.)]|\d{1,3}(?:\.\d{1,3}){1,3}\.?|§\s?\d+\.?)[ \t\xa0]")
TABLE = re.compile(r"\t|\S\s+[|;]\s+\S.*\s[|;]\s+\S|^\|.*\|")
GLUED = re.compile(r"[^\W_]{2}[)\]]?[.?!][\"”]?([^\W\d_][^.?!]+)$")
OPENER = re.compile(r"[\"“„«‘'(\[¿¡]*(?:[^\W\d_]|\d)|[§]")


def ends_sentence(text: str, at: int, stop: int, nxt: int) -> bool:
    """Whether the stop at ``text[at]``, whose marks end before ``stop``, closes a sentence that ``text[nxt]`` follows."""
    c = text[nxt]
    gap = nxt > stop
    m = OPENER.match(text, nxt)
    if not m:
        return False
    first = text[m.end() - 1]
    if first.islower():
        return False
    if c in "([" and not (first.isupper() or first.isdigit()):
        return False
    if text[at] != ".":
        return gap or first.isupper() and c != first or first.isupper()
    k = at
    while k and not text[k - 1].isspace() and text[k - 1] not in "(\"“[":
        k -= 1
    word = text[k:at]
    glued = GLUED.search(word) if "." in word or "?" in word or "!" in word else None
    if glued:  # the word before had no blank after its own stop
        word = glued.group(1)
    low = word.lower()
    if not gap:  # no blank between the sentences
        if first.isdigit() or not word or not (first.isupper() and nxt + 1 < len(text)):
            return bool(first.isdigit() and word and word[-1].islower() and low not in NEVER and len(word) > 3 and word.isalpha())
        after = text[m.end() : m.end() + 1]
        if c == first and not after.islower() or len(word) == 1:
            return False
    if low in NEVER:  # "prior art." is a word, "art. 5" is not
        return word == "art" and not first.isdigit() and not re.match(r"[IVXLC]+\b", text[nxt:nxt + 6])
    if low in COMPANY:
        return c not in "([" and not AFTER_COMPANY.match(text, nxt)
    if len(word) == 1 and word.isupper():
        return bool(LETTER_OF.search(text, max(0, k - 12), k))
    if word.isdigit() and len(word) <= 2 and (k == 0 or text[k - 1] == "\n"):
        return False  # a mark that opens the line
    return True


def sentence_starts(text: str, lo: int, hi: int) -> list[int]:
    """Offsets within [lo, hi) where a new sentence begins after another one."""
    out = []
    for m in STOP.finditer(text, lo, hi):
        nxt = m.end()
        while nxt < hi and (text[nxt].isspace() or text[nxt] in "\x1c\x1d\x1e\x1f​﻿"):
            nxt += 1
        if nxt < hi and ends_sentence(text, m.start(), m.end(), nxt):
            out.append(nxt)
    return out


def closed(text: str, lo: int, end: int, nxt: int) -> bool:
    """Whether the text before ``end`` is complete, so that the line at ``nxt`` opens a unit."""
    k = end
    while k > lo and (text[k - 1].isspace() or text[k - 1] in "\"”»’')]"):
        k -= 1
    if k == lo:
        return True
    if text[k - 1] in ";:":
        return True
    if text[k - 1] in ".?!…":
        stop = k
        while stop < end and text[stop] in "\"”»’')]":
            stop += 1
        return ends_sentence(text, k - 1, stop, nxt) or OPENER.match(text, nxt) is None
    return False


def boundaries(text: str) -> list[tuple[int, int]]:
    """(offset, strength) of every natural boundary but the one that opens the text, in order."""
    out: dict[int, int] = {}
    first, previous, pos, blank = -1, "", 0, False
    run_lo = 0  # where the running prose began
    prev_end = 0
    n = len(text)
    while pos <= n:
        end = text.find("\n", pos)
        end = n if end < 0 else end
        lo = pos
        while lo < end and text[lo].isspace():
            lo += 1
        if lo == end:
            blank = True
            pos = end + 1
            continue
        line = text[lo:end].rstrip()
        mark = MARK.match(line)
        if mark and len(mark.group()) == len(line):
            mark = None
        done = first < 0 or previous in ("row", "item") or closed(text, run_lo, prev_end, lo)
        kind = "prose"
        if ("\t" in line or "|" in line or ";" in line) and TABLE.search(line):
            kind = "row"
        elif mark:
            opens = line[mark.end() :]
            if NUMBERED.match(line):
                bare = re.match(r"\d+(?:\.\d+)+\s", line)
                if (done or blank and not bare) and (opens[0].isupper() or opens[0] in "\"“„«" or line[0] in "([" or opens[0].isdigit() and done):
                    kind = "clause"
            elif done or previous == "item" or line[0] in "•▪◦‣":
                kind = "item"
        if kind == "prose" and done and first >= 0 or kind != "prose":
            if first >= 0:
                out[lo] = {"row": ROW, "item": ITEM, "clause": CLAUSE, "prose": SENTENCE}[kind]
                if blank:
                    out[lo] = max(out[lo], PARAGRAPH)
            run_lo = lo
        if first < 0:
            first = lo
        if kind != "row":
            body = lo + (mark.end() if mark and kind != "prose" else 0)
            for s in sentence_starts(text, body, end):
                out[s] = max(out.get(s, 0), SENTENCE)
        previous, prev_end, blank = kind, end, False
        pos = end + 1
    out.pop(first, None)
    return sorted(out.items())
