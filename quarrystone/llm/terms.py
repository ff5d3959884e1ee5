"""Frequency of every distinct term: occurrences, distinct records, and a mark on the useless ones.

Range-partitioned external sort of (field, term, record, row key) and a run-length scan of each sorted partition. The
range bounds cover all four columns, so neither a term nor a record that holds a third of all rows stays in one
partition; each scan emits partial runs, and a record torn between partitions counts once where they are added up.

Defined cases
  * a term is the value without surrounding blanks, lower-cased; null and blank values are left out;
  * a row key seen twice with the same term and record counts as one occurrence (repeated rows);
  * a null record id counts its occurrences but is no record;
  * ``rare``: fewer than ``min_records`` distinct records; ``common``: more than ``max_share`` of the distinct
    records of that field's table, with or without a value; otherwise the mark is null. A term that is both is rare;
  * an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def norm_term(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), BLANKS, ""))


def term_rows(df: DataFrame, field: str, record: str, key: Column) -> DataFrame:
    """(field_name, term, record, row_key) of one column; row_key tells repeated rows from others."""
    t = df.select(F.lit(field).alias("field_name"), norm_term(df[field]).alias("term"), df[record].cast("string").alias("record"), key.alias("row_key"))
    return t.filter(F.col("term") != "")


def record_totals(df: DataFrame, field: str, record: str) -> DataFrame:
    return df.select(F.lit(field).alias("field_name"), df[record].cast("string").alias("record")).distinct().groupBy("field_name").agg(F.count("record").alias("n_all"))


def _starts(*cols: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before it; nulls equal nulls."""
    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in cols:
        a, b = c.slice(1), c.slice(0, n - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        ne = ne | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        new[1:] |= ne
    return new


OUT = "field_name string, term string, n_occurrences long, n_records long, edge string"


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of a partition sorted by all four columns. A run is a record of a term; runs are added up by
    term, but for the first and the last of the partition, which may go on in another one: they come out with their
    record as ``edge`` and are counted once where partitions are put together."""
    last: tuple | None = None  # the row before this batch
    open_run: list | None = None  # field, term, record, occurrences of the run in progress
    first_run = True

    def rows(f, t, occurrences, records, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(f, pa.string()), pa.array(t, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64()), pa.array(edge, pa.string())],
            names=["field_name", "term", "n_occurrences", "n_records", "edge"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(4)]
        rec, row = _starts(*cols[:3]), _starts(*cols)
        row[0] = tuple(c[0].as_py() for c in cols) != last
        last = tuple(c[b.num_rows - 1].as_py() for c in cols)
        at = np.flatnonzero(rec)
        f, t, r = (c.take(pa.array(at)).to_pylist() for c in cols[:3])
        n = np.add.reduceat(row.astype("i8"), at).tolist()
        if open_run and open_run[:3] == [f[0], t[0], r[0]]:
            n[0] += open_run[3]
        elif open_run:
            f, t, r, n = [open_run[0], *f], [open_run[1], *t], [open_run[2], *r], [open_run[3], *n]
        open_run = [f.pop(), t.pop(), r.pop(), n.pop()]
        if f and first_run:
            yield rows(f[:1], t[:1], n[:1], [0], r[:1])
            f, t, r, n, first_run = f[1:], t[1:], r[1:], n[1:], False
        if f:
            new = np.flatnonzero([True, *((f[i], t[i]) != (f[i - 1], t[i - 1]) for i in range(1, len(f)))])
            has = np.array([x is not None for x in r], "i8")
            yield rows([f[i] for i in new], [t[i] for i in new], np.add.reduceat(np.array(n), new), np.add.reduceat(has, new), [None] * len(new))
    if open_run:
        yield rows(open_run[:1], open_run[1:2], open_run[3:], [0], open_run[2:3])


def term_counts(rows: DataFrame, totals: DataFrame, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    cols = ["field_name", "term", "record", "row_key"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).mapInArrow(scan_runs, OUT)
    # at most two edges a partition
    records = F.sum("n_records") + F.size(F.collect_set("edge"))
    counts = runs.groupBy("field_name", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), records.alias("n_records"))
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > F.col("n_all") * max_share, "common")
    # one row per field: a fixed, tiny side
    return counts.join(F.broadcast(totals), "field_name").withColumn("mark", mark).drop("n_all")
