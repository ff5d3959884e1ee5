"""Boundaries on hand-made texts; pieces: invariants against brute force, pages, overlap, degenerate texts."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.boundaries import boundaries
from quarrystone.llm.splitting import Cuts, RangeMax, boundary_rows, cuts, pieces


def starts(text):
    return [text[p:].split()[0] for p, _ in boundaries(text)]


def test_sentences():
    assert starts("The levy of Orka Inc. Board costs 3.5 units. Both agree, e.g. in Art. II. See No. 4 and Sec. 3(f). \"Go!\" was said. Ask Vel Co. about it?  Yes.") == ["Both", "See", '"Go!"', "Ask", "Yes."]
    assert starts("It was paid to Orka Corp. Annex No. 3 follows. No. A-5 lists it under Schedule B. Then Tal v. Rom Ltd. ended.Next one") == ["Annex", "No.", "Then", "Next"]


def test_units():
    assert starts("Items:\n- one of S.A. (see Art. 2);\n- two\nItem | Year | Sum\na | 2001 | 3\n\n2.1 Notice – The end. It is.\n(3) Record: Done.\nwrapped\nline.") == ["-", "-", "Item", "a", "2.1", "It", "(3)"]
    assert starts("One sentence that goes\non\fhere and\n\nthere. \fNext.") == ["Next."]
    assert boundaries("") == [] and boundaries("  \n ") == [] and boundaries("One.") == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=70), st.data())
def test_range_max(values, data):
    i = data.draw(st.integers(0, len(values) - 1))
    j = data.draw(st.integers(i + 1, len(values)))
    best = max(values[i:j])
    assert RangeMax(np.array(values)).argmax(i, j) == max(k for k in range(i, j) if values[k] == best)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nB;", max_size=700))
def test_pieces_cover_the_text(text):
    got = cuts(text, 100, 20)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(got, got[1:]):
        assert s < s2 <= e < e2 + 1 and e - s2 <= 20 and e - s <= 100 and e2 - s2 <= 100


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nB;1-", max_size=500))
def test_cuts_are_the_strongest_of_their_window(text):
    index, natural = Cuts(text), dict(boundaries(text))
    assert index.natural() == sorted(natural.items())
    strength = {p: natural.get(p, 1) for p in range(1, len(text)) if p in natural or not text[p].isspace() and text[p - 1].isspace()}
    got = index.pieces(60, 10) if len(text) > 60 else []
    for s, e in got[:-1]:
        window = [p for p in range(s + 30, s + 61) if p in strength]
        assert e == (max(window, key=lambda p: (strength[p], p)) if window else s + 60)


def test_on_spark(spark):
    long = "The first sentence is here. " * 90 + "\f" + "And this is on the next page. " * 90
    rows = [("a", long, 4, "x"), ("a", long, 4, "x"), ("z", long, 0, "x"), ("n", long, None, "x"), ("w", "x" * 5000, 1, "x"), ("s", "short", 1, "x"), ("e", "", 1, "x"), ("u", None, 1, "x"), (None, long, 1, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, raw_content string, page_num int, piece string")
    got = {}
    for r in pieces(df).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {"a", "z", "n", "w"}
    a = sorted(got["a"], key=lambda r: r.piece_no)
    assert all(r.n_chars == len(r.piece) <= 1800 and r.piece == long[r.start_char : r.start_char + r.n_chars] for r in a)
    assert a[0].page == 4 and a[-1].page == 5 and all(r.piece.startswith(("The first", "And this")) for r in a)
    assert all(0 < p.start_char + p.n_chars - q.start_char <= 200 for p, q in zip(a, a[1:]))
    assert {r.page for r in got["z"] + got["n"]} == {None} and len(got["w"]) == 3
    b = boundary_rows(df).filter("chunk_id = 'a'").collect()
    assert len(b) == 179
    assert {r.start_char for r in b if r.cut} == {r.start_char + r.n_chars for r in a[:-1]}
    assert pieces(df.limit(0)).count() == 0 and boundary_rows(df.limit(0)).count() == 0
