"""Complete groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) where ``starts`` opens each group of equal first ``keys`` columns and no group is torn.

    Only the group in progress is carried over, so a partition of many small groups streams. The caller
    bounds the size of a group (see ``block_keys``).
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and all(held[-1].column(i)[held[-1].num_rows - 1].as_py() == b.column(i)[b.num_rows - 1].as_py() for i in range(keys)):
            held.append(b)  # all of one group
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        starts = _starts(t, keys)
        if starts[-1] == 0:
            held = [b]
            continue
        yield t.slice(0, int(starts[-1])), starts[:-1]
        held = t.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t, keys)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for i in range(keys):
        c = t.column(i).combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)
