"""Encoding of a corpus by a public byte-level BPE, with DuckDB recursive queries in every partition.

A batch of texts is split by the tokenizer's pattern. Its distinct pieces that this worker has not met yet
become token-position rows; one recursive query joins neighbouring rows with the merge table and contracts, in
each piece, the leftmost pair of least rank until no pair is left; an ordered aggregation gives the ids. Pieces
longer than ``LONG_BYTES`` run apart from the others, so that short ones are not visited for as many steps, and contract
all disjoint pairs of least rank in a step. That gives the same ids where no merge ranks below the one that made its
parts, as is so in trained tables; it is checked when the table is loaded. The database never spills to a local disk.

Defined cases: null and empty texts give an empty list; text that spells a special token is ordinary text;
lone surrogates cannot occur (Parquet strings are UTF-8); repeated doc_ids give one row each; every other
column is left alone. No shuffle: the work is a map over the scan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: The pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BYTES = 64
CACHE = 200_000
BATCH_CHARS = 4_000_000

#: A step contracts in each piece the leftmost pair of least rank.
LEFTMOST = """
best AS (SELECT c.w, arg_min({'pos': c.pos, 'gone': c.next_pos, 'tok': m.made}, m.rank::BIGINT * 4294967296 + c.pos) AS b
         FROM cur c JOIN merges m ON m.l = c.tok AND m.r = c.next_tok GROUP BY c.w),
done AS (SELECT w, b.pos AS pos, b.gone AS gone, b.tok AS tok FROM best)
"""
#: A step contracts in each piece all pairs of least rank, from the left; of overlapping ones every other.
ALL_DISJOINT = """
met AS (SELECT c.w, c.pos, c.next_pos AS gone, c.i, c.tok = c.next_tok AS twin, m.made AS tok, m.rank, min(m.rank) OVER (PARTITION BY c.w) AS least
        FROM cur c JOIN merges m ON m.l = c.tok AND m.r = c.next_tok),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY pos) AS run FROM met WHERE rank = least),
done AS (SELECT w, pos, gone, tok FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM runs) WHERE NOT twin OR k % 2 = 1)
"""
ENCODE = """
WITH RECURSIVE st(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM init
  UNION
  (WITH active AS (SELECT DISTINCT w FROM st),
        cur AS (SELECT w, pos, tok, lead(tok) OVER q AS next_tok, lead(pos) OVER q AS next_pos, row_number() OVER q AS i
                FROM recurring.st JOIN active USING (w) WHERE tok >= 0
                WINDOW q AS (PARTITION BY w ORDER BY pos)),
        {step}
   SELECT w, pos, tok FROM done UNION ALL SELECT w, gone, -1 FROM done)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM st WHERE tok >= 0 GROUP BY w ORDER BY w
"""


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Merge table and piece cache of one worker process."""

    def __init__(self, file: str):
        import duckdb
        import regex

        model = json.load(open(file, encoding="utf-8"))["model"]
        vocab, pairs = model["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.bytes = [vocab[c] for _, c in sorted(byte_chars().items())]
        merges = pa.table(  # noqa: F841
            {
                "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "made": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
            }
        )
        # what a merge makes must be merged later: then all pairs of least rank may be contracted in one step
        made, ranks = {}, {}
        for rank, (a, b) in enumerate(pairs):
            made[a + b] = max(rank, made.get(a + b, 0))
            for x in (a, b):
                ranks.setdefault(x, rank)
        self.in_order = all(ranks.get(x, rank + 1) > rank for x, rank in made.items())
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merge_rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def learn(self, pieces: list[str], step: str = LEFTMOST) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        init = pa.table(
            {
                "w": pa.array([i for i, b in enumerate(raw) for _ in b], pa.int32()),
                "pos": pa.array([k for b in raw for k in range(len(b))], pa.int32()),
                "tok": pa.array([self.bytes[x] for b in raw for x in b], pa.int32()),
            }
        )
        self.db.register("init", init)
        for w, ids in self.db.execute(ENCODE.format(step=step)).fetchall():
            self.known[pieces[w]] = list(ids)
        self.db.unregister("init")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.known]
        short = [p for p in new if len(p.encode("utf-8")) <= LONG_BYTES]
        for i in range(0, len(short), 20_000):
            self.learn(short[i : i + 20_000])
        for p in new:
            if len(p.encode("utf-8")) > LONG_BYTES:
                self.learn([p], ALL_DISJOINT if self.in_order else LEFTMOST)
        known = self.known
        return [[i for p in s for i in known[p]] for s in split]


_encoders: dict[str, Encoder] = {}


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row of ``df``."""
    file = os.path.join(folder, tokenizer + ".json")
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(file) or _encoders.setdefault(file, Encoder(file))
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):  # a bounded number of characters at a time
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array(enc.encode(texts[at:end]), pa.list_(pa.int32()))], names=[key, "ids"]
                )
                at = end

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return df.select(df[key], df[text]).mapInArrow(run, StructType().add(key, kind).add("ids", ArrayType(IntegerType())))


def decode(ids: list[int], file: str) -> str:
    """The text of a list of ids; the exact inverse of encode for any text."""
    model = json.load(open(file, encoding="utf-8"))["model"]
    back, byte = {i: t for t, i in model["vocab"].items()}, {c: b for b, c in byte_chars().items()}
    return bytes(byte[c] for i in ids for c in back[i]).decode("utf-8")
