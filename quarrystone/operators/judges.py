"""Second stages: what a first rule leaves open goes to a provider, and a provider that fails decides nothing by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complexity, overlap_coefficient

#: A pair provider: two Series of texts to a Series of scores; it may raise.
PairProvider = Callable[[pd.Series, pd.Series], pd.Series]


def resolved_complexity(text: Column, fallback: Column | None = None) -> Column:
    """struct(complexity, confidence) with ESCALATE resolved: by the verdict of a model where it gives one, else SIMPLE at 0.1."""
    c = complexity(text)
    open_ = c["complexity"] == "ESCALATE"
    model = F.lit(None).cast("string") if fallback is None else fallback
    known = model.isin("SIMPLE", "COMPLEX")
    return F.struct(
        F.when(open_, F.when(known, model).otherwise("SIMPLE")).otherwise(c["complexity"]).alias("complexity"),
        F.when(open_, F.when(known, 0.8).otherwise(0.1)).otherwise(c["confidence"]).alias("confidence"),
    )


def judged(verdict: Column, claim: Column, source: Column, least: float = 0.5) -> Column:
    """A verdict with the judge's cases decided; the default judge asks for a share of common words above ``least``."""
    s = F.round(overlap_coefficient(F.coalesce(claim, F.lit("")), F.coalesce(source, F.lit(""))), 6)
    return F.when(verdict == "judge", F.when(s > least, "valid").otherwise("invalid")).otherwise(verdict)


def fail_open(rows: DataFrame, passes: Column, failed: Column, detail: str) -> DataFrame:
    """Rows that pass, and, without their ``detail``, those whose judge failed: an error drops nothing."""
    d = rows.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_passes", F.coalesce(passes, F.lit(False)))
    d = d.withColumn(detail, F.when(~F.col("_failed"), F.col(detail)))
    return d.filter("_failed or _passes").drop("_failed", "_passes")


def pair_scores(provider: PairProvider, a: str, b: str) -> Column:
    """Scores of pairs of texts by a provider, in Arrow batches; a batch that it fails on has none."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            try:
                yield provider(x.fillna(""), y.fillna(""))
            except Exception:
                yield pd.Series([None] * len(x), dtype="float64")

    return run(F.col(a), F.col(b))


def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """The default pair provider: shared words over the smaller word set."""

    def of(x: str, y: str) -> float:
        p, q = set(x.lower().split()), set(y.lower().split())
        return len(p & q) / min(len(p), len(q)) if p and q else 0.0

    return pd.Series([of(x, y) for x, y in zip(a, b)])


def features(rows: DataFrame, text: str, providers: dict[str, Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """Rows with an array of strings per provider, all made in one pass over the texts. A provider that fails on a batch leaves
    empty arrays."""
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c != text), *(f"{name} array<string>" for name in providers)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p.drop(columns=[text])
            for name, provider in providers.items():
                try:
                    out[name] = provider(p[text]).to_numpy()
                except Exception:
                    out[name] = [[] for _ in range(len(p))]
            yield out

    return rows.mapInPandas(run, schema)
