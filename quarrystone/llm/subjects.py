"""Subject areas of documents by curated terms: one pass over the texts with a multi-pattern automaton.

An automaton over the terms of all languages finds, in each sentence, the longest terms at word borders; what comes out of
that pass is small and is kept. From it the documents of each term are counted (a term weighs the more the rarer it is) and
the documents scored. A sentence is about the subject that has at least half of the weight of its terms. A term shared by
several subjects counts for those whose own terms the document has most of, then for those most of its shared terms allow.
A subject's score is its share of the sentences (so it does not depend on length), and every subject whose score reaches
its threshold is assigned. Thresholds are fitted on one half of the labelled documents (``fitted``); ``agreement`` measures
them on the other.

Defined cases
  * null, empty and blank texts, and texts without a sentence, have no subject; null ids give no rows;
  * the language is found from the text by its function words, never from the language column;
  * a quotation that a sentence only mentions counts as nothing;
  * repeated rows count once; whole texts are used; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .boundaries import boundaries
from .subject_terms import FUNCTION_WORDS, NEUTRAL, TERMS

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
#: A quotation that a sentence only mentions, by verbs of the four languages.
QUOTED = re.compile(r"\b(?:(?:quot|mention|cit)(?:es?|ed)|zitiert|erwähnt|mentionne|cita|menciona)\s+[\"“„«][^\"”“»]*[\"”“»]")
QUOTES = "\"“„«"
GRID = [0.2, 0.25, 0.3, 0.35, 0.4]


class Matcher:
    """Automaton over all terms; a match is (start, end, entries), an entry a (language, subjects, term)."""

    def __init__(self) -> None:
        import ahocorasick

        entries: dict[str, dict[str, set[str]]] = {}
        for subject, by_language in TERMS.items():
            for language, terms in by_language.items():
                for term in terms.split(";"):
                    entries.setdefault(term.strip().lower(), {}).setdefault(language, set()).add(subject)
        for language, phrases in NEUTRAL.items():
            for phrase in filter(None, map(str.strip, phrases.split(";"))):
                entries.setdefault(phrase, {}).setdefault(language, set())
        self.terms = sorted(entries)
        self.entries = [entries[t] for t in self.terms]
        #: A sense is a term with the subjects it stands for; a term's senses differ by language.
        self.senses: list[tuple[str, frozenset[str]]] = []
        self.numbers: list[dict[str, int]] = []
        self.alone: list[int] = []
        for term, by_language in zip(self.terms, self.entries):
            number: dict[frozenset[str], int] = {}
            for subjects in map(frozenset, by_language.values()):
                if subjects and subjects not in number:
                    number[subjects] = len(self.senses)
                    self.senses.append((term, subjects))
            self.numbers.append({language: number[frozenset(x)] for language, x in by_language.items() if x})
            one = len(set(map(frozenset, by_language.values()))) == 1
            self.alone.append(next(iter(number.values()), -1) if one else -1)
        self.automaton = ahocorasick.Automaton()
        for n, t in enumerate(self.terms):
            self.automaton.add_word(t, n)
        self.automaton.make_automaton()

    def sense(self, n: int, language: str, main: str) -> int:
        """The sense of a term in a sentence and a text of these languages, -1 if it has none there: that of the language, or the
        one it has in every language that knows it."""
        known = self.numbers[n]
        return known.get(language, known.get(main, self.alone[n]))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, term number) of the longest terms at word borders, from left to right, in lower-cased text."""
        hits = []
        for last, n in self.automaton.iter(text):
            start, end = last + 1 - len(self.terms[n]), last + 1
            if start and (text[start - 1].isalnum() or text[start - 1] in "-_"):
                continue
            if end < len(text) and text[end].isalpha():
                # a plural is still the term
                if not (text[end] == "s" and not text[end + 1 : end + 2].isalpha()):
                    continue
            hits.append((start, end, n))
        hits.sort(key=lambda h: (h[0], -h[1]))
        out, free = [], 0
        for h in hits:
            if h[0] >= free:
                out.append(h)
                free = h[1]
        return out


WORDS_OF = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}


def language_of(words: list[str], default: str = "en") -> str:
    """The language most of whose function words are among the words."""
    counts = [(sum(map(known.__contains__, words)), language) for language, known in WORDS_OF.items()]
    n, best = max(counts, key=lambda c: c[0])
    return best if n else default


def clean(text: str) -> str:
    return " ".join(text.replace("’", "'").replace("\xad", "").lower().split())


def units_of(text: str) -> list[tuple[str, list[str]]]:
    """(cleaned text, words) of the units that are sentences: they have words and a full stop, or are long enough without one."""
    at = [0, *(p for p, _ in boundaries(text)), len(text)]
    out = []
    for a, b in zip(at, at[1:]):
        low = clean(text[a:b])
        words = WORD.findall(low)
        if len(words) >= 3 and (len(words) >= 8 or low.rstrip("\"”»’')] ")[-1:] in (".", "?", "!")):
            out.append((low, words))
    return out


def sentences(text: str) -> list[str]:
    return [low for low, _ in units_of(text)]


def sentence_hits(text: str | None, matcher: Matcher) -> tuple[int, list[list[int]]]:
    """(number of sentences, the senses of the terms of every sentence that has any)."""
    units = units_of(text) if text and not text.isspace() else []
    main, out = "", []
    for low, words in units:
        hits = matcher.find(QUOTED.sub(" ", low) if any(q in low for q in QUOTES) else low)
        if hits:
            main = main or language_of([w for _, part in units for w in part])
            language = language_of(words, main)
            here = [x for *_, n in hits if (x := matcher.sense(n, language, main)) >= 0]
            if here:
                out.append(here)
    return len(units), out


def shares(n: int, hits: list[list[int]], matcher: Matcher, weight: dict[int, float]) -> dict[str, float]:
    """Share of the ``n`` sentences by subject, from the senses of their terms."""
    senses = matcher.senses
    votes: Counter[str] = Counter()
    for here in hits:
        for s in {next(iter(senses[x][1])) for x in here if len(senses[x][1]) == 1}:
            votes[s] += 1
    # shared terms vote too, but only where own terms leave a tie
    for here in hits:
        for s in {s for x in here for s in senses[x][1]}:
            votes[s] += 1e-6
    about: Counter[str] = Counter()
    for here in hits:
        if len(here) == 1 and len(senses[here[0]][1]) == 1:
            about.update(senses[here[0]][1])
            continue
        mass: Counter[str] = Counter()
        for x in here:
            subjects = senses[x][1]
            if len(subjects) > 1:
                most = max(votes[s] for s in subjects)
                subjects = {s for s in subjects if votes[s] == most}
            for s in subjects:
                mass[s] += weight.get(x, 1.0) / len(subjects)
        total = sum(mass.values())
        about.update(s for s, m in mass.items() if m * 2 >= total - 1e-9)
    return {s: c / n for s, c in about.items()}


def scores(text: str | None, matcher: Matcher, weight: dict[int, float]) -> tuple[int, dict[str, float]]:
    """(number of sentences, share of the sentences by subject)."""
    n, hits = sentence_hits(text, matcher)
    return n, shares(n, hits, matcher, weight) if n else {}


def term_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_sentences, hits) of every document: the only pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for b in batches:
            found = [sentence_hits(t, matcher) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([h for _, h in found], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "n_sentences", "hits"]
            )

    d = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("t")).filter("doc_id is not null")
    return spread(d).mapInArrow(run, "doc_id long, n_sentences int, hits array<array<int>>").distinct()


def rarity(hits: DataFrame) -> dict[int, float]:
    """Weight of each sense of a curated term by the documents that have it; a row per sense of a fixed list is collected."""
    total = hits.filter("n_sentences > 0").count()
    n = hits.select(F.explode(F.array_distinct(F.flatten("hits"))).alias("sense")).groupBy("sense").agg(F.count("*").alias("n"))
    return {r.sense: math.log(1 + total / r.n) for r in n.collect()}


def subject_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, subject, score) of every subject a document has a sentence about; a document without
    any has one row with a null subject."""
    hits = cut_lineage(term_hits(df, key, text))
    weight = df.sparkSession.sparkContext.broadcast(rarity(hits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for b in batches:
            rows = []
            for k, n, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                by = shares(n, h, matcher, weight.value) if h else {}
                rows += [(k, n, s, x) for s, x in by.items()] or [(k, n, None, 0.0)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=["doc_id", "n_sentences", "subject", "score"])

    return hits.mapInArrow(run, "doc_id long, n_sentences int, subject string, score double")


def assigned(scored: DataFrame, threshold: float | dict[str, float] = 0.3) -> DataFrame:
    """Subjects whose score reaches the threshold, one for all or one for each (0.3 where none is given)."""
    least = F.lit(0.3)
    for subject, x in threshold.items() if isinstance(threshold, dict) else ():
        least = F.when(F.col("subject") == subject, x).otherwise(least)
    least = least if isinstance(threshold, dict) else F.lit(threshold)
    return scored.filter(F.col("score") >= least - 1e-9).select("doc_id", "subject", F.round("score", 6).alias("score"))


def composition(scored: DataFrame, threshold: float | dict[str, float] = 0.3) -> DataFrame:
    """Documents by subject, a document without any under null."""
    docs = scored.select("doc_id").distinct()
    return docs.join(assigned(scored, threshold), "doc_id", "left").groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"))


def label_rows(labels: DataFrame, key: str = "doc_id", subject: str = "subject", half: int | None = None) -> DataFrame:
    """(doc_id, subject) of labels, compared in lower case, without outer blanks and with underscores between words; of all
    documents, or of one of two halves of them."""
    name = F.regexp_replace(F.lower(F.trim(labels[subject])), r"[\s-]+", "_").alias("subject")
    lab = labels.select(labels[key].cast("long").alias("doc_id"), name).filter("doc_id is not null and subject <> ''").distinct()
    return lab if half is None else lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)


def fitted(scored: DataFrame, labels: DataFrame, default: float = 0.3, margin: float = 0.02) -> dict[str, float]:
    """Threshold of each subject, fitted on one half of the labelled documents: the best F1 of a grid around the definition, which
    stays unless another is better by ``margin``, the labels being in part wrong and of one subject a document. A few
    counts per subject are collected."""
    lab = label_rows(labels, half=0)
    rows = scored.join(lab.select("doc_id").distinct(), "doc_id", "left_semi").filter("subject is not null")
    rows = rows.join(lab.withColumn("true", F.lit(1)), ["doc_id", "subject"], "left")
    n = {r.subject: r.n for r in lab.groupBy("subject").agg(F.count("*").alias("n")).collect()}
    at = [F.count_if((F.col("score") >= x - 1e-9) & true).alias(f"{name}{i}") for i, x in enumerate(GRID) for name, true in (("tp", F.col("true").isNotNull()), ("fp", F.col("true").isNull()))]
    out = {}
    for r in rows.groupBy("subject").agg(*at).collect():
        f1 = {x: 2 * r[f"tp{i}"] / max(1, r[f"tp{i}"] + r[f"fp{i}"] + n.get(r.subject, 0)) for i, x in enumerate(GRID)}
        best = max(GRID, key=lambda x: (f1[x], -abs(x - default)))
        out[r.subject] = best if f1[best] > f1[default] + margin else default
    return out


def agreement(found: DataFrame, labels: DataFrame, key: str = "doc_id", subject: str = "subject", half: int | None = None) -> DataFrame:
    """Labels by subject and how many of them were assigned."""
    lab = label_rows(labels, key, subject, half)
    hit = lab.join(found.select("doc_id", "subject", F.lit(1).alias("hit")), ["doc_id", "subject"], "left")
    return hit.groupBy("subject").agg(F.count("*").alias("n_labels"), F.count("hit").alias("n_assigned"))
