"""Model calls as pluggable providers, with deterministic offline defaults.

A provider is a function from a pandas Series to a pandas Series; the wrappers run it over Arrow batches, so a model is
loaded once a worker. The defaults need no model and give the same answer everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[pd.Series], pd.Series]
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.?!]+[.?!]?")
VERBS = {"is", "are", "was", "were", "has", "had", "shall", "will", "may", "must", "can", "cannot", "covers", "led", "concerned", "runs", "paid", "binds", "replaces", "limits", "states"}


def hashed_embedding(dims: int = 64) -> Provider:
    """Signed feature hashing of the words, of length one (all zeros for a text without words)."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in WORD.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("f4").tolist())
        return pd.Series(out)

    return embed


def lead_sentences(n: int = 2) -> Provider:
    """Summary by the first sentences."""
    return lambda texts: texts.map(lambda t: " ".join(s.strip() for s in SENTENCE.findall(t or "")[:n]).strip())


def triples(texts: pd.Series) -> pd.Series:
    """Subject, verb and rest of each sentence that has a known verb, without repeats."""

    def of(t: str | None) -> list[str]:
        out = []
        for s in SENTENCE.findall(t or ""):
            w = s.strip(" .?!\n\t").split()
            at = next((i for i, x in enumerate(w) if i and x.lower() in VERBS), None)
            if at and at + 1 < len(w):
                out.append("\t".join((" ".join(w[:at]), w[at], " ".join(w[at + 1 :]))))
        return list(dict.fromkeys(out))

    return texts.map(of)


def questions(texts: pd.Series) -> pd.Series:
    """Up to three questions that a text answers, one per leading sentence."""
    return texts.map(lambda t: [f"What about {s.strip(' .?!').lower()}?" for s in SENTENCE.findall(t or "") if s.strip(" .?!\n")][:3])


def best_evidence(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """The sentence of a text that shares most words with its question, the first of equals, or NO_EVIDENCE."""

    def of(q: str | None, t: str | None) -> str:
        want = set(WORD.findall((q or "").lower()))
        found = [(len(want & set(WORD.findall(s.lower()))), -i, s.strip()) for i, s in enumerate(SENTENCE.findall(t or ""))]
        n, _, s = max(found, default=(0, 0, ""))
        return s if n else "NO_EVIDENCE"

    return pd.Series([of(q, t) for q, t in zip(questions, texts)])


def subqueries(texts: pd.Series) -> pd.Series:
    """A question and its parts at connectors, the question itself first, at most four."""
    return texts.map(lambda t: list(dict.fromkeys([t or "", *[x.strip() for x in re.split(r"[;?]|, and ", t or "") if len(x.split()) > 3]]))[:4])


def call(provider: Callable[..., pd.Series], kind: str, *columns: Column | str) -> Column:
    """A provider as a column, over Arrow batches; it gets a Series for each of the columns."""

    @F.pandas_udf(kind)
    def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield provider(part)

    @F.pandas_udf(kind)
    def several(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield provider(*part)

    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return one(*cols) if len(cols) == 1 else several(*cols)
