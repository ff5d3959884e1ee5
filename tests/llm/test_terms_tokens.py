"""Term counts against a brute-force count; token ids against the public library and an exact round trip."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrystone.llm.terms import record_totals, term_counts, term_rows
from quarrystone.llm.tokens import TOKENIZERS, Encoder, decode, encode


def test_terms_brute_force(spark):
    rng = random.Random(1)
    vals = ["A", " a", "b", "B\t", "", "  ", None, "hot", "ü", "Ü"]
    rows = [(f"k{i}", rng.choice([f"d{j}" for j in range(12)] + [None]), rng.choice(vals), "x") for i in range(300)]
    rows += [(f"h{i}", f"d{i % 12}", "Hot ", "x") for i in range(200)] + rows[:50]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, kind string, term string")
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in term_counts(term_rows(df, "kind", "doc_id", df["chunk_id"]), record_totals(df, "kind", "doc_id")).collect()}
    occ, rec = defaultdict(set), defaultdict(set)
    for k, d, v, _ in set(rows):
        if v and v.strip():
            occ[v.strip().lower()].add(k)
            rec[v.strip().lower()] |= {d} - {None}
    n = len({r[1] for r in rows} - {None})
    assert got == {t: (len(occ[t]), len(rec[t]), "rare" if len(rec[t]) < 3 else "common" if len(rec[t]) > n * 0.2 else None) for t in occ}


def test_a_record_torn_between_partitions_counts_once(spark):
    df = spark.createDataFrame([(f"k{i:04}", "one" if i < 900 else f"d{i % 7}", "same") for i in range(1000)], "chunk_id string, doc_id string, kind string")
    for n in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [(r.term, r.n_occurrences, r.n_records) for r in term_counts(term_rows(df, "kind", "doc_id", df["chunk_id"]), record_totals(df, "kind", "doc_id")).collect()]
        assert got == [("same", 1000, 8)]
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_terms_empty(spark):
    df = spark.createDataFrame([], "chunk_id string, doc_id string, kind string")
    assert term_counts(term_rows(df, "kind", "doc_id", df["chunk_id"]), record_totals(df, "kind", "doc_id")).count() == 0


TEXTS = [
    "", None, " ", "\n\n  \t x", "Plain words, don't they're I'LL 12345", "äöü ß – „Zitat“ 北京市中级人民法院" * 3, "العربية हिन्दी 👩‍👩‍👧 é",
    "<|endoftext|> literal", "a" * 3000, "=" * 700, " " * 900 + "x", "aaaab" * 300, "  　 nbsp", "x\r\ny\r\n\r\n", "\x00\x01​", "dies ist" * 500,
]


def test_ids_equal_the_library_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode(df).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:40]
        assert decode(got[i], f"{TOKENIZERS}/byte_bpe_50k.json") == (x or "")


def test_ids_empty_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode(df).count() == 0
    df = spark.createDataFrame([(1, "a b")] * 2, "doc_id long, text string")
    assert encode(df).groupBy("doc_id").agg(F.count("*").alias("n")).first().n == 2


def test_long_pieces():
    tokenizers = pytest.importorskip("tokenizers")
    file = f"{TOKENIZERS}/byte_bpe_50k.json"
    enc, t, rng = Encoder(file), tokenizers.Tokenizer.from_file(file), random.Random(2)
    assert enc.in_order
    for x in ("a" * 100_000, " " * 50_001 + "x", "".join(rng.choice("etaoin") for _ in range(2500)), "abab" * 4001 + "a"):
        assert enc.encode([x]) == [t.encode(x, add_special_tokens=False).ids], x[:10]
