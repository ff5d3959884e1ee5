"""Scan repair on a small corpus of known noise, and its defined cases."""

from quarrystone.llm.scans import corrected, cut, fold, line_marks, marks, ordinary_words, repair, without_misreadings, word_counts

PROSE = "The long-term agreement covers every additional supplier of the company, and the parties will postpone the regular payment until the deadline. "


def corpus():
    rows = [(f"d{i}", f"plain{i}", PROSE * 2, "x") for i in range(30)]
    page = "\n".join(
        [
            "Arkel file No. 12",
            "The long-",
            "term agreement covers every additi-",
            "onal supplier of the company, and the",
            "parties will postp0ne the regu|ar pay-",
            "ment until the deadline. The parties",
            "- 7 -",
            "Arkel fi1e No. 12",
            "will postpone the regular payment until",
            "the deadline.",
            "- 8 -",
        ]
    )
    return rows + [("s", "scan", page, "x"), ("s", "scan", page, "x"), ("t", "torn", "Within\n45\ndays, the parties will postpone the regular payment of the company.", "x"),
                   ("n", "nul", None, "x"), ("e", "emp", "", "x"), ("b", "blank", " \n ", "x"), (None, "nodoc", page, "x")]


def test_marks_and_repair(spark):
    df = spark.createDataFrame(corpus(), "doc_id string, chunk_id string, raw_content string, line_no string")
    words = ordinary_words(word_counts(df, "doc_id", "raw_content"))
    found = line_marks(df, spark.sparkContext.broadcast(words))
    got = {(r.chunk_id, r.line_no, r.noise) for r in found.collect()}
    want = {(1, "furniture"), (3, "break"), (5, "misread"), (5, "break"), (7, "furniture"), (8, "furniture"), (11, "furniture")}
    assert got == {(c, *w) for c in ("scan", "nodoc") for w in want}
    clean = {r.chunk_id: r.clean for r in repair(df, found).collect()}
    assert clean["scan"] == PROSE.strip() + " The parties will postpone the regular payment until the deadline."
    assert clean["torn"] == corpus()[32][2] and clean["nul"] is None and clean["emp"] == "" and clean["blank"] == " \n "
    assert clean["plain3"] == PROSE * 2 and len(clean) == 36


def test_small_rules():
    words = {w: 9 for w in "good-faith postpone regular confirmation agreement".split()}
    assert cut("confir", "mation", "-", words) and not cut("good", "faith", "-", words) and cut("con", "firmation", "\xad", {})
    assert corrected("regu|ar", words) == "regular" and corrected("regular", words) is None and corrected("Xyzzy", words) is None
    assert fold("Arkel fi1e No. 12") == fold("ARKEL FILC NO. 13")
    assert marks("", words) == [] and len(marks("x" * 200_000 + "\n" + "y " * 100_000, words)) == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, chunk_id string, raw_content string")
    words = ordinary_words(word_counts(df, "doc_id", "raw_content"))
    found = line_marks(df, spark.sparkContext.broadcast(words))
    assert words == {} and found.count() == 0 and repair(df, found).count() == 0


def noise(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, raw_content string")
    found = line_marks(df, spark.sparkContext.broadcast({}))
    return {(r.chunk_id, r.line_no) for r in found.filter("noise = 'furniture'").collect()}, df, found


def page(n, *around):
    body = [f"The supplier number {'abcdefgh'[n]} delivers all goods to the", f"company and the parties of lot {'stuvwxyz'[n]} postpone the", "payment until the deadline has passed for all of them."]
    return "\n".join([*around[:-1], *body, *around[-1:]])


def test_plain_running_lines_by_repetition(spark):
    long = "Annual Report of the Directors and Auditors of the Company to the Members in General Meeting"
    rows = [("d", f"c{n}", page(n, ("Annual Report", "Annua1 Report", "ANNUAL REPORT")[n % 3], "Arkel Holdings")) for n in range(4)]
    rows += [("l", f"l{n}", page(n, long, "Arkel Holdings Company")) for n in range(4)]
    rows += [("two", f"t{n}", page(n, "Arkel Holdings", "Statement of Accounts", "Group Secretary")) for n in range(4)]
    rows += [("feed", "f", "\n\f".join(page(n, "Annual Report", "Arkel Holdings") for n in range(4)))]
    # once in a document, or at the edges of copies of one page, is no repetition
    rows += [("once", "o", page(0, "Annual Report", "Arkel Holdings"))] + [("copy", f"y{n}", page(0, "Annual Report", "Arkel Holdings")) for n in range(4)]
    got, _, _ = noise(spark, rows)
    want = {(f"{c}{n}", i) for c in "cl" for n in range(4) for i in (1, 5)}
    want |= {(f"t{n}", i) for n in range(4) for i in (1, 2, 6)} | {("f", 5 * n + i) for n in range(4) for i in (1, 5)}
    assert got == want


def test_body_text_that_looks_like_furniture_stays(spark):
    ledger = "\n".join([page(0, "Arkel file No. 12", ""), "Registration fees    250", "Late registration    30", "Deposit for keys    120", "12 | Annual charge", page(1, "", "- 7 -").strip()])
    headed = ["\n".join([page(n, "").strip() + ".", "Fees – General", page(n + 2, "").strip(), "Fees – General", page(n + 4, "").strip()]) for n in range(2)]
    rows = [("s", "ledger", ledger), *(("s", f"headed{n}", t) for n, t in enumerate(headed))]
    got, df, found = noise(spark, rows)
    last = len(ledger.split("\n"))
    assert got == {("ledger", 1), ("ledger", last)}
    clean = {r.chunk_id: r.clean for r in repair(df, found).collect()}
    assert "Registration fees 250" in clean["ledger"] and "Deposit for keys 120" in clean["ledger"] and clean["headed0"].count("Fees – General") == 2


def test_documents_count_once_however_rows_are_dealt(spark):
    rows = [("hot", f"c{i}", "the agreernent ends") for i in range(40)] + [(f"d{i}", f"e{i}", "the agreement ends") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, raw_content string").repartition(13)
    counts = word_counts(df, "doc_id", "raw_content")
    assert {r.word: r.n for r in counts.collect()} == {"": 8, "the": 8, "ends": 8, "agreernent": 1, "agreement": 7}
    assert set(ordinary_words(counts)) == {"the", "ends", "agreement"}


def test_frequent_misreadings_are_no_ordinary_words():
    counts = {"file": (9000, 6000, 8000), "filc": (90, 90, 1), "tile": (80, 50, 60), "undcr": (45, 45, 0), "under": (9000, 6000, 8000), "xyl": (300, 300, 0), "xyi": (4, 4, 0)}
    # "filc" and "undcr" keep to scanned text; "tile" stands in other text as often as "file" does; "xyi" needs no other text
    for scale in (1, 100):
        assert set(without_misreadings({w: tuple(scale * x for x in c) for w, c in counts.items()})) == {"file", "tile", "under", "xyl"}
    assert set(without_misreadings({"file": (100, 60, 80), "filc": (1, 1, 0)})) == {"file"}


def test_short_words_with_a_sign():
    words = {"of": 500, "to": 500, "is": 500}
    text = "The deadline 0f the payment\nis due t0 the company 1s\nof no use"
    assert {(n, k) for n, k, _ in marks(text, words) if k == "misread"} == {(1, "misread"), (2, "misread")}


def test_same_rows_for_any_batch_size(spark):
    df = spark.createDataFrame([(f"d{i % 37}", f"c{i}-{k}", t) for i in range(60) for k, (_, _, t, _) in enumerate(corpus()[28:32])], "doc_id string, chunk_id string, raw_content string")
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size in ("100", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            words = ordinary_words(word_counts(df, "doc_id", "raw_content"))
            got.append({tuple(r) for r in line_marks(df, spark.sparkContext.broadcast(words)).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] and got[0]
