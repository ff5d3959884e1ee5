"""Relational operators on hand-made rows, against plain Python where it is short."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import evaluation, fusion, lookup, packing, providers, ranking, retrieval, summaries, upserts, windows
from quarrystone.sources import elements, index, registries


def test_dense_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, [1.0] + [0.0] * 7), (102, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    vec = {r.id: list(r.vec) for r in df.collect()}
    q = [0, 5, 101]
    got = {}
    for block in (4096, 2):
        for r in retrieval.dense_topk(df.filter(F.col("id").isin(q)), df.repartition(5), k=4, same=True, query_block=block).collect():
            got.setdefault((block, r.query_id), {})[r["rank"]] = r.item_id
        for i in q:
            want = sorted((x for x in vec if x != i), key=lambda x: (-cos(vec[i], vec[x]), x))[:4]
            assert [got[block, i][k] for k in (1, 2, 3, 4)] == want
    assert retrieval.dense_topk(df.limit(0), df).count() == 0 and retrieval.dense_topk(df, df.limit(0)).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "dog"), (3, ""), (4, None), (5, "bird")], "id long, text string")
    got = retrieval.bm25_topk(spark.createDataFrame([(9, "Cat cat fish"), (8, "none")], "id long, text string"), docs).collect()
    mean, idf = 5 / 5, math.log(1 + (5 - 1 + 0.5) / 1.5)
    assert [(r.query_id, r.item_id, r["rank"]) for r in got] == [(9, 1, 1)]
    assert got[0].score == round(2 * idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), 6)
    q = spark.createDataFrame([(9, "Cat cat fish"), (8, "none")], "id long, text string")
    for few in (0, 200_000):
        assert retrieval.bm25_topk(q, docs.unionByName(docs), repeats=True, few=few).collect() == got


def test_fusion_order_and_sources(spark):
    rows = [(1, "PRIMARY", 1, "x"), (1, "D", 1, "y"), (1, "A", 2, "y"), (1, "C", 1, "z"), (1, "C", 2, "z"), (1, "B", 1, None), (1, "A", 1, "x")]
    f = {r.item_id: r for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, path string, rank int, item_id string")).collect()}
    assert f["x"].score == round(2 / 61, 9) and f["y"].score == f["z"].score == round(1 / 61 + 1 / 62, 9)
    assert [f[i]["rank"] for i in "xyz"] == [1, 2, 3] and f["y"].sources == "D,A" and f["z"].sources == "C"


def test_web_merge(spark):
    cols = "query_id long, item string, score double, rank int"
    local = spark.createDataFrame([(1, "a", 0.5, 1), (2, "b", None, 1)], cols)
    web = spark.createDataFrame([(1, "w", 0.5, 1), (2, "v", 0.0, 1)], cols)
    conf = spark.createDataFrame([(1, 0.4), (2, 0.39)], "query_id long, confidence double")
    assert [(r.query_id, r.item, r.source) for r in fusion.merge_with_web(local, web, conf).orderBy("query_id", "rank").collect()] == [(1, "a", "local"), (2, "b", "local"), (2, "v", "web")]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6])
def test_interleave(spark, n):
    df = spark.createDataFrame([("q", i) for i in range(1, n + 1)], "q string, r int")
    for mode, five in (("edges", [1, 3, 5, 4, 2]), ("center", [5, 3, 1, 2, 4])):
        got = [r.r for r in packing.interleave(df, "q", "r", mode).orderBy("position").collect()]
        assert sorted(got) == list(range(1, n + 1)) and (n != 5 or got == five)


def test_packing_and_assembly(spark):
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate([10, 20, 5], 1)], "q string, r int, t int")
    assert packing.prefix_pack(df, "q", "r", F.col("t"), budget=70).count() == 2  # hit exactly
    assert packing.prefix_pack(df, "q", "r", F.col("t"), budget=29).count() == 0  # the first is too large
    rows = [("q", 1, "c1", "d", "one"), ("q", 2, "c1", "d", "again"), ("q", 3, "c2", "d", None), ("q", 4, "c3", "d", "late"), ("q", 5, "", "", "x"), ("q", 6, "c4", None, "y")]
    a = packing.assemble(spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, text string")).collect()
    assert [(r.n_rows, r.context) for r in a] == [(3, "[c1] one\n\n---\n\n[c2] \n\n---\n\n[c4] y")]


def test_lookups(spark):
    df = spark.createDataFrame([(" NDA ",), ("msa",), ("x",), (None,)], "t string")
    got = [r.canonical_id for r in lookup.canonical(df, "t", lookup.alias_table(spark, lookup.DOCUMENT_TYPES)).collect()]
    assert sorted(map(str, got)) == ["DOC-MSA", "DOC-NDA", "None", "None"]
    df = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("", "2"), ("a", "2")], "j string, c string")
    assert lookup.keep_unless_different(df, {"j": "a", "c": None}).count() == 4
    assert lookup.keep_unless_different(df, {"j": "a", "c": "1"}).count() == 2 and lookup.keep_unless_different(df, {}).count() == 5


def test_semantic_chunks(spark):
    rows = [("d", 1, [1.0, 0.0], 1), ("d", 2, [1.0, 0.1], 1), ("d", 3, [0.0, 1.0], 1), ("d", 4, [0.0, 1.0], 2), ("d", 5, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "d string, i int, v array<double>, p int")
    assert [r.chunk_no for r in windows.semantic_chunks(df, "d", "i", "v", F.col("p")).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_windows_and_claims(spark):
    corpus = spark.createDataFrame([(f"c{i}", "d", i, f"t{i}") for i in range(6) if i != 4], "chunk_id string, doc_id string, split_idx int, text string")
    near = {r.chunk_id: r.window_text for r in windows.with_neighbours(corpus, "doc_id", "split_idx", "text", "chunk_id").collect()}
    assert near["c0"] == "t0\n\nt1" and near["c3"] == "t2\n\nt3" and near["c5"] == "t5"
    cand = spark.createDataFrame([(1, 1, "c1", "d", 1), (1, 2, "c2", "d", 2), (1, 3, "c3", "d", 3), (1, 4, "zz", "d", 9)], "query_id long, rank int, chunk_id string, doc_id string, split_idx int")
    got = [(r.chunk_id, r.n_parts, r.window_text) for r in windows.claim_windows(cand, corpus).orderBy("rank").collect()]
    assert got == [("c1", 3, "t0\n\nt1\n\nt2"), ("c3", 1, "t3"), ("zz", 0, "")]


def test_claims_beyond_the_bound_are_an_error(spark):
    corpus = spark.createDataFrame([("c1", "d", 1, "t1")], "chunk_id string, doc_id string, split_idx int, text string")
    for rank in (1001, None):
        cand = spark.createDataFrame([(1, rank, "c1", "d", 1)], "query_id long, rank int, chunk_id string, doc_id string, split_idx int")
        with pytest.raises(Exception, match="ranks up to 1000"):
            windows.claim_windows(cand, corpus).collect()


def test_metrics(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (3, "y", 1)], "query_id long, item_id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "q")], "query_id long, item_id string")
    got = {r.query_id: (r.n_relevant, r.mrr, r.average_precision, r.recall) for r in evaluation.retrieval_metrics(found, rel, k=2).collect()}
    assert got == {1: (3, 0.5, 0.25, round(1 / 3, 6)), 2: (1, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}
    shares = {r.category: (r.n, r.share) for r in evaluation.category_shares(spark.createDataFrame([("SUCCESS",), ("SUCCESS",), ("CRAG",), ("CRAG",)], "c string"), "c").collect()}
    assert len(shares) == 6 and shares["CRAG"] == (2, 0.5) and shares["CITATION"] == (0, 0.0)
    assert evaluation.category_shares(spark.createDataFrame([], "c string"), "c").count() == 6
    with pytest.raises(AssertionError, match="recall"):
        evaluation.gate({"recall": 0.5}, {"recall": 0.9, "precision": 0.1})
    evaluation.gate({"recall": 0.9}, {"recall": 0.9})


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "h"), ("b", None, "h")], "k string, v int, keep string")
    new = spark.createDataFrame([("b", 2, "n"), ("c", 3, "n")], "k string, v int, keep string")
    assert {tuple(r) for r in upserts.partial_upsert(old, new, "k", ["keep"]).collect()} == {("a", 1, "h"), ("b", 2, "h"), ("c", 3, "n")}
    assert {tuple(r) for r in upserts.insert_if_absent(old, new, "k").collect()} == {("a", 1, "h"), ("b", None, "h"), ("c", 3, "n")}
    path = f"{tmp_path}/t"
    upserts.replace_table(old, path)
    upserts.replace_table(upserts.insert_if_absent(spark.read.parquet(path), new, "k"), path)
    assert spark.read.parquet(path).count() == 3


def test_providers_and_tree(spark):
    df = spark.createDataFrame([(None,), ("",), ("Rent is due. The tenant shall pay it. Why?",)], "t string")
    e = [r.e for r in df.select(providers.call(providers.hashed_embedding(8), "array<float>", "t").alias("e")).collect()]
    assert [round(sum(x * x for x in v), 4) for v in e] == [0, 0, 1]
    assert [r.p for r in df.select(providers.call(providers.triples, "array<string>", "t").alias("p")).collect()][2] == ["Rent\tis\tdue", "The tenant\tshall\tpay it"]
    leaves = spark.createDataFrame([("d", f"n{i:02}", f"Text {i}. More.", [float(i % 4), 1.0]) for i in range(27)] + [("e", "m", "One.", [1.0, 1.0])], "doc_id string, node_id string, text string, vec array<float>")
    tree = summaries.summary_tree(leaves).collect()
    assert {r.doc_id for r in tree} == {"d"} and sorted(c for r in tree if r.level == 1 for c in r.children) == [f"n{i:02}" for i in range(27)]
    top = max(r.level for r in tree)
    assert sum(r.level == top for r in tree) == 1
    big = summaries.clusters(leaves, group=10).groupBy("cluster").count().collect()
    assert {r.cluster.split("-")[0] for r in big} == {"0", "1", "2"} and sum(r["count"] for r in big) == 28
    assert summaries.summary_tree(leaves.limit(0)).count() == 0


def test_ancestors(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("z", None), ("w", "w")]
    got = {tuple(r) for r in ranking.ancestors(spark.createDataFrame(edges, "node string, parent string")).collect()}
    assert got == {(f"n{i}", f"n{j}", j - i) for i in range(10) for j in range(i + 1, 10)} | {("x", "y", 1)}
    with pytest.raises(ValueError):
        ranking.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))


def test_rerank_and_context(spark):
    c = spark.createDataFrame([(1, "cat dog", "bird", 1), (1, "cat dog", "cat", 2), (1, "cat dog", None, 3)], "query_id long, query string, text string, rank int")
    assert [(r.text, r["rank"]) for r in ranking.rerank(c, 2).orderBy("rank").collect()] == [("cat", 1), ("bird", 2)]
    assert [r.text for r in ranking.rerank(c, score=F.lit(0.0)).orderBy("rank").collect()] == ["bird", "cat", None]
    d = spark.createDataFrame([("d", 2, "", "b"), ("d", 1, "s", None)], "doc string, i int, source string, text string")
    assert ranking.numbered_context(d, "doc", "i", "source", "text").first().context == "[1] (Source: s): \n\n[2] (Source: UNKNOWN): b\n\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\nTwo\nlines.\f\n \fThree.")
    (tmp_path / "b.bad").write_bytes(b"\xff")
    got = [(r.element_idx, r.text, r.page_num) for r in elements.read_elements(spark, str(tmp_path), glob="*.txt").orderBy("element_idx").collect()]
    assert got == [(0, "One.", 1), (1, "Two\nlines.", 1), (2, "Three.", 3)]
    assert elements.read_elements(spark, str(tmp_path), parser=lambda b: 1 / 0).count() == 0
    (tmp_path / "r.json").write_text('{"trusted_sources": {"x.org": 1}, "kinds": {"A": ["a"]}}')
    (tmp_path / "broken.json").write_text("{")
    assert registries.trusted_sources(f"{tmp_path}/r.json") == {"x.org": 1.0} and registries.aliases(f"{tmp_path}/r.json", "kinds") == {"A": ["a"]}
    assert registries.trusted_sources(f"{tmp_path}/broken.json") == {} and "sec.gov" in registries.trusted_sources(f"{tmp_path}/none.json")


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "dog"), (3, None)], "id long, text string")
    index.write_postings(docs, f"{tmp_path}/p")
    got = {(r.item_id, r.term, r.tf) for r in index.read_postings(spark, f"{tmp_path}/p", ["cat", "none"]).collect()}
    assert got == {(1, "cat", 2)}
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    index.upsert_vectors(v, f"{tmp_path}/v")
    index.upsert_vectors(spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), f"{tmp_path}/v")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
