"""Run a vectorised numpy function over whole groups of a sorted partition, with bounded memory.

A partition is read batch by batch.  Groups are adjacent (the caller sorts), so
everything up to the last group boundary can be processed at once; only the
unfinished tail is carried over.  Memory is one batch plus one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(
    batches: Iterator[pa.RecordBatch], key: str, fn: Callable[[pa.Table], pa.Table | None], min_rows: int = 50_000
) -> Iterator[pa.RecordBatch]:
    """Call fn on tables that hold only complete groups of ``key`` (an int64 column)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < min_rows:
            continue
        last = batch.column(key)[batch.num_rows - 1].as_py()
        tbl = pa.Table.from_batches(held)
        keys = tbl.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != last)[-1]) + 1 if (keys != last).any() else 0
        if cut:
            out = fn(tbl.slice(0, cut).combine_chunks())
            if out is not None:
                yield from out.to_batches(max_chunksize=100_000)
        rest = tbl.slice(cut)
        held = rest.to_batches()
        rows = rest.num_rows
        min_rows = max(min_rows, 2 * rows) if rows >= min_rows else min_rows
    if held:
        out = fn(pa.Table.from_batches(held).combine_chunks())
        if out is not None:
            yield from out.to_batches(max_chunksize=100_000)


def floats(tbl: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (null as NaN) and the mask of nulls of a double column."""
    col = tbl.column(name)
    null = pc.is_null(col).to_numpy().astype(bool)
    return pc.fill_null(col, float("nan")).to_numpy().astype(np.float64), null
