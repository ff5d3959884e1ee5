"""What a search shuffles follows its texts and its results, not queries times texts."""

import random

import pytest

import __spark_entry__ as entry
from quarrystone.operators import manysearch, retrieval

WORDS = ["of", "s", "notice", "annual", "board", "record", "lien", "Ämter", "x_1"]


def test_bm25_many(spark):
    """Equal to the plain search, ties, small blocks, repeated rows and parts of the queries included."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS[: rng.randint(1, 9)]) for _ in range(n))
    docs = [(f"d{i:03d}", text(rng.randint(0, 12))) for i in range(300)] + [("e1", None), ("e2", "")]
    q = spark.createDataFrame([(i, text(rng.randint(1, 4)) + rng.choice(["", " LIEN", " nowhere"])) for i in range(40)] + [(90, "nowhere"), (91, "..."), (92, None)], "id long, text string")
    d = spark.createDataFrame(docs, "id string, text string")
    want = retrieval.bm25_topk(q, d, k=4).orderBy("query_id", "rank").collect()
    assert len(want) > 100
    twice = d.unionByName(d).repartition(3)
    for few, block in ((200_000, 65_536), (50, 7)):
        assert manysearch.bm25_many(q, twice, k=4, few=few, block=block).orderBy("query_id", "rank").collect() == want
    assert manysearch.bm25_many(q.limit(0), d).count() == 0 and manysearch.bm25_many(q, d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sixty queries and 2,000 texts that nearly all have a word of every title; one document has all points and texts."""
    f, rng = str(tmp_path_factory.mktemp("growth")), random.Random(7)
    chunks = [(f"c{i:04d}", "big", i, " ".join(["notice", "of", *rng.choices(WORDS, k=4), f"name{rng.randint(0, 60)}"])) for i in range(2000)]
    points = [(100 * i, [rng.gauss(0, 1) for _ in range(64)], rng.choice(["primary_v2", "hype_v2"]), f"c{i:04d}", "big" if i % 2 else f"b{i}") for i in range(60)]
    points += [(i * 100 + 1, [rng.gauss(0, 1) for _ in range(64)], "clusters_v2", f"c{i:04d}", "big") for i in range(2000)]
    titles = [(f"b{i}", f"Notice of name{i}", None) for i in range(60)] + [("big", "Board of record", "https://big.example.org")]
    for name, rows, schema in (
        ("chunks", chunks, "chunk_id string, doc_id string, split_idx long, raw_content string"),
        ("vector_points", points, "point_no long, vector array<float>, collection string, chunk_id string, doc_id string"),
        ("document_metadata", titles, "document_id string, title string, pdf_url string"),
        ("canonical_metadata", [("b0", "XN-BR")], "document_id string, jurisdiction_id string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{f}/{name}.parquet")
    return f


def written(spark):
    e = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))


@pytest.mark.parametrize("name", ["multi_path_retrieve", "crag_merge", "retrieval_metrics", "path_recall", "calibration_trained", "answer_tokens", "fast_query", "prefiltered_search", "rrf_sources", "confidence_features", "rrf_top", "window_claims", "fused_gate", "rerank_and_pack", "rrf_fuse"])
def test_shuffle(spark, folder, name):
    before = written(spark)
    rows = entry.queries()[name](spark, folder).collect()
    shuffled = written(spark) - before
    assert rows and shuffled < 1_200_000
