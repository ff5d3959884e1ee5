"""Judges, gates, path isolation, bounded packing, chunk texts and the store on hand-made rows."""

import pandas as pd
from pyspark.sql import functions as F

from quarrystone.api import Service
from quarrystone.operators import evaluation, fusion, judges, packing, ranking, windows
from quarrystone.sources import index, schemas


def test_isolated_paths(spark):
    schema = "query_id long, path string, rank int, item_id string"
    good = spark.createDataFrame([(1, "A", 1, "x")], schema)
    assert fusion.isolated(spark, lambda: good, schema).count() == 1
    for broken in (lambda: spark.read.parquet("/no/such/folder"), lambda: good.select("nothing"), lambda: good.drop("rank")):
        assert fusion.isolated(spark, broken, schema).count() == 0


def test_sources_and_payload(spark):
    rows = [(1, "PRIMARY", 1, "x", "p1"), (1, "A", 1, "x", "a1"), (1, "D", 2, "x", "d2"), (1, "A", 2, "y", None), (1, "C", 3, "y", "c3")]
    f = fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, path string, rank int, item_id string, payload string"), payload="payload")
    got = {r.item_id: (r.sources, r.payload, r.kept) for r in f.withColumn("kept", fusion.appended(F.split("sources", ","))).collect()}
    assert got == {"x": ("D,PRIMARY,A", "d2", "D,PRIMARY"), "y": ("C,A", "c3", "C,A")}


def test_second_stages(spark):
    t = spark.createDataFrame([("one two three",), ("what is the right place for all of this now",), ("please compare the one and the other of them",)], "t string")
    assert [tuple(r.c) for r in t.select(judges.resolved_complexity(F.col("t")).alias("c")).collect()] == [("SIMPLE", 0.95), ("SIMPLE", 0.1), ("COMPLEX", 0.9)]
    assert [r.c.complexity for r in t.select(judges.resolved_complexity(F.col("t"), F.lit("COMPLEX")).alias("c")).collect()] == ["SIMPLE", "COMPLEX", "COMPLEX"]
    v = spark.createDataFrame([("judge", "a b", "a b c"), ("judge", "a b", "c"), ("valid", "a", "b"), ("judge", None, None)], "v string, a string, b string")
    assert [r.j for r in v.select(judges.judged(F.col("v"), F.col("a"), F.col("b")).alias("j")).collect()] == ["valid", "invalid", "valid", "invalid"]
    rows = spark.createDataFrame([(1, True, False, "x"), (2, False, False, "x"), (3, None, True, "x"), (4, None, None, "x")], "i int, p boolean, e boolean, d string")
    assert {(r.i, r.d) for r in judges.fail_open(rows, F.col("p"), F.col("e"), "d").collect()} == {(1, "x"), (3, None)}


def test_providers_that_fail(spark):
    def broken(*parts: pd.Series) -> pd.Series:
        raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "a b", "b c"), (2, None, "x")], "i int, a string, b string")
    assert [r.s for r in df.orderBy("i").select(judges.pair_scores(judges.common_words, "a", "b").alias("s")).collect()] == [0.5, 0.0]
    assert [r.s for r in df.select(judges.pair_scores(broken, "a", "b").alias("s")).collect()] == [None, None]
    f = judges.features(df.select("i", "a"), "a", {"up": lambda t: t.fillna("").str.upper().str.split(" "), "bad": broken})
    assert {(r.i, tuple(r.up), tuple(r.bad)) for r in f.collect()} == {(1, ("A", "B"), ()), (2, ("",), ())}


def test_gates(spark):
    lists = spark.createDataFrame([("P", 1, 1, "a"), ("P", 1, 2, "a"), ("P", 2, 1, "z"), ("FUSED", 1, 2, "a"), ("FUSED", 2, 1, "b")], "path string, query_id long, rank int, item_id string")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "query_id long, item_id string")
    assert {r.path: (r.mrr, r.improves) for r in evaluation.fused_improves(lists, rel).collect()} == {"P": (0.5, True), "FUSED": (0.75, True)}
    assert {r.path: (r.recall, r.passes) for r in evaluation.path_recall(lists, rel).collect()} == {"P": (0.25, False), "FUSED": (0.75, False)}
    assert {r.path: r.recall for r in evaluation.path_recall(lists, rel.filter("query_id = 1")).collect()} == {"P": 0.75, "FUSED": 0.75}  # nothing expected is all found


def test_packing_is_bounded_and_exact(spark):
    rows = [("hot", i, "w " * (i % 7)) for i in range(3000)] + [("one", 0, None)]
    df = spark.createDataFrame(rows, "q string, r int, t string").repartition(7)
    got = packing.prefix_pack(df, "q", "r", F.coalesce(F.regexp_count("t", F.lit("w")), F.lit(0)), budget=500, overhead=20).collect()
    run, want = 0, 0
    for _, i, t in rows[:3000]:
        run += 20 + t.count("w")
        want += run <= 500
    assert sorted(r.r for r in got if r.q == "hot") == list(range(want)) and max(r.running for r in got) <= 500
    c = {r.q: r for r in ranking.numbered_context(df.withColumn("s", F.lit("")), "q", "r", "s", "t", budget=100).collect()}
    assert c["one"].context == "[1] (Source: UNKNOWN): \n\n" and c["hot"].n_rows == 4  # 20, 42, 66, 92 tokens


def test_names_as_words(spark):
    df = spark.createDataFrame([("a karate msa",), ("Anda N.Y. mhx",), ("x" * 3000 + " nda",), (None,)], "t string")
    got = [r.a for r in df.select(ranking.first_alias(F.col("t"), {"K": ["ka", "mh"], "M": ["msa"], "N": ["nda"], "Y": ["n.y."]}).alias("a")).collect()]
    assert got == ["M", "Y", None, None]


def test_chunk_texts(spark):
    rows = [("d", 0, "a", 1, [0.0, 0.0, 1.0, 1.0], [1.0, 0.0]), ("d", 1, "  ", 1, None, [0.0, 1.0]), ("d", 2, "b", 1, [2.0, -1.0, 3.0, 0.5], [1.0, 0.1]), ("d", 3, "c", 2, None, [1.0, 0.1]), ("d", 4, "e", 2, None, [0.0, 1.0]), ("d", 5, None, 2, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "doc string, i int, t string, p int, b array<double>, v array<float>")
    got = [tuple(r) for r in windows.chunk_texts(df, "doc", "i", "t", "p", "b", "v").orderBy("chunk_no").collect()]
    assert got == [("d", 0, 2, "a b", 1, 0.0, -1.0, 3.0, 1.0), ("d", 1, 1, "c", 2, None, None, None, None), ("d", 2, 1, "e", 2, None, None, None, None)]


def test_postings_upsert(spark, tmp_path):
    path = str(tmp_path / "p")
    index.write_postings(spark.createDataFrame([(1, "old words here"), (2, "stay here")], "id long, text string"), path)
    index.upsert_postings(spark.createDataFrame([(1, "new here"), (3, "here here")], "id long, text string"), path)
    got = {(r.item_id, r.term, r.tf) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "new", 1), (1, "here", 1), (2, "stay", 1), (2, "here", 1), (3, "here", 2)}


def test_settings_and_tables(spark, tmp_path):
    spark.conf.set("spark.quarrystone.final_k", "9")
    try:
        assert schemas.Settings.of(spark).final_k == 9 and schemas.Settings.of(spark).crag_threshold == 0.4
    finally:
        spark.conf.unset("spark.quarrystone.final_k")
    schemas.bootstrap(spark, str(tmp_path))
    spark.createDataFrame([("i", "t", 1, 2)], schemas.TABLES["postings"]).write.mode("overwrite").parquet(f"{tmp_path}/postings")
    schemas.bootstrap(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 1 and schemas.described(spark, str(tmp_path)).count() == 49


def test_service(spark, tmp_path):
    service = Service(spark, str(tmp_path)).start().start()
    q = spark.createDataFrame([("what?",), ("who?",), ("what?",)], "query string")
    ids = {r.query: r.job_id for r in service.enqueue(q).collect()}
    assert len(ids) == 2 and {r.job_id for r in service.enqueue(q).collect()} == set(ids.values()) and service.read("queue").count() == 2
    service.publish(spark.createDataFrame([(ids["what?"], 1, "RUNNING"), (ids["what?"], 2, "FAILED"), (ids["what?"], 3, "RUNNING")], "job_id string, seq long, state string"))
    for _ in range(2):
        service.cancel(spark.createDataFrame([(ids["who?"],), (ids["what?"],), ("no such job",)], "job_id string"), "2024-01-01")
    assert {r.job_id: r.state for r in service.job_states().collect()} == {ids["what?"]: "FAILED", ids["who?"]: "CANCELLED"}
    frames = [r.frame.split("\n")[0] for r in service.job_events(ids["what?"]).orderBy("seq").collect()]
    assert frames == ["event: status", "event: failed"] and service.read("cancellations").count() == 2
    files = spark.createDataFrame([("d1", "a.pdf"), ("d1", "b.pdf"), ("d1", "a.pdf")], "document_id string, file_path string")
    service.ingest(files, "2024-01-01")
    assert service.ingest(files, "2024-01-02").count() == 2 and service.read("ingestion_jobs").filter("status = 'QUEUED' and created_at < '2024-01-02'").count() == 2
    assert service.citation("none").count() == 0 and service.document("none").count() == 0
