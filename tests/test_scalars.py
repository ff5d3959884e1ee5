"""Column functions against plain Python."""

import hashlib
import uuid

from pyspark.sql import functions as F

from quarrystone.functions import scalars as S
from quarrystone.operators import lookup


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


def test_identifiers(spark):
    for text in ("abc", "ünïcode", ""):
        h = hashlib.sha256(f"d|3|{text}".encode()).hexdigest()
        assert one(spark, S.chunk_id(F.lit("d"), F.lit(3), F.col("t")), t=text) == f"pqac-{uuid.uuid5(uuid.NAMESPACE_DNS, h)}"
        assert one(spark, S.name_uuid(F.col("t")), t=text) == str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def test_overlap_and_cosine(spark):
    f = lambda a, b: one(spark, S.overlap_coefficient(F.col("a"), F.col("b")), a=a, b=b)
    assert f("The cat sat", "the CAT ran far") == 2 / 3 and f("", "a") == 0 and f("  ", "") == 0
    g = lambda a, b: one(spark, S.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert abs(g([1.0, 0.0], [1.0, 1.0]) - 2**-0.5) < 1e-12 and g([0.0, 0.0], [1.0, 1.0]) == 0


def test_authority_and_trust(spark):
    want = {"https://www.sec.gov/x": ("sec.gov", 1.0), "http://investor.SEC.gov?q": ("investor.sec.gov", 1.0), "https://notsec.gov": ("notsec.gov", 0.2), "https://u@sec.gov:443/": ("u@sec.gov:443", 0.2), "": ("", 0.2), "nonsense": ("", 0.2)}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    got = {r.u: (r.a, r.t) for r in df.select("u", S.authority(F.col("u")).alias("a"), lookup.trust(F.col("u")).alias("t")).collect()}
    assert got == want
    assert one(spark, lookup.trust(F.lit("https://sec.gov"), {})) == 0.2


def test_complexity(spark):
    long = " ".join(["word"] * 18 + ["and", "or", "but"])
    cases = {"a b c d e": "SIMPLE", "please vs. compare these six words": "COMPLEX", "one two three four five six": "ESCALATE", long: "COMPLEX", " ".join(["word"] * 17 + ["and", "or", "but"]): "ESCALATE", "the reconciled balance sheet is out": "ESCALATE", "we reconcile it across five years": "COMPLEX"}
    cases["the reconciled balance sheet is out"] = "COMPLEX"  # inside a longer word too
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c.complexity for r in df.select("t", S.complexity(F.col("t")).alias("c")).collect()} == cases


def test_cascades(spark):
    c = lambda *a: one(spark, S.failure_category(*map(F.lit, a)))
    assert [c(True, True, False, True, 1.0), c(False, False, True, True, 1.0), c(False, False, False, True, 1.0), c(False, True, True, False, 1.0), c(False, True, False, True, 0.94), c(False, True, False, True, 0.95)] == ["GENERATION", "CRAG", "RETRIEVAL", "REASONING", "CITATION", "SUCCESS"]
    d = lambda x: tuple(one(spark, S.decoding(F.lit(x))))
    assert d(0.81) == (0.0, 0.1) and d(0.8) == (0.1, 0.3) and d(0.5) == (0.0, 0.1)
    assert [one(spark, S.backoff_seconds(F.lit(n))) for n in (1, 2)] == [10, 30]
    assert one(spark, S.calibrated(F.lit(2.0), F.lit(0.0), F.lit(0.0))) == 1.0


def test_text_fallback_and_markers(spark):
    df = spark.createDataFrame([("", "c", "p", ["q"]), ("", None, "", ["q", "r"]), (None, None, None, None)], "a string, b string, c string, d array<string>")
    assert [r[0] for r in df.select(S.first_text(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == ["c", "q r", ""]
    a, b = "pqac-" + str(uuid.UUID(int=1)), "pqac-" + str(uuid.UUID(int=2))
    df = spark.createDataFrame([(f"x {a} y {b}{b} z", [a])], "t string, k array<string>")
    assert df.select(S.keep_known_markers(F.col("t"), F.col("k"))).first()[0] == f"x {a} y  z"


def test_elements_and_verdict(spark):
    e = lambda t, r, o: tuple(one(spark, lookup.satisfied_elements(F.lit(t), F.lit(r), F.lit(o))))
    assert e("Pay the Rent", ["rent"], ["pay", "leave"]) == (0, 0.5, True)
    assert e("nothing", ["rent"], None if False else ["x"]) == (1, 0.0, False)
    null = F.lit(None).cast("array<string>")
    assert tuple(one(spark, lookup.satisfied_elements(F.lit(None).cast("string"), null, null))) == (0, 1.0, True)
    v = lambda c, s, late: tuple(one(spark, lookup.citation_verdict(F.lit(c), F.lit(s), F.lit(late))))
    assert v("a b c", "a b c d", False) == (1.0, "valid", "a b c d") and v("a b", "a c", False) == (0.5, "judge", None)
    assert v("a b", "a c", True)[1] == "invalid" and v("a b c", "a b d", True)[1] == "valid"
