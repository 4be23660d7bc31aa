"""Streaming over sorted Arrow batches: groups of equal key, each of a size that its caller has bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """Yields lists of tables, one table for each run of equal keys, over batches sorted by integer keys. Holds one batch and one group."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        cuts = _cuts(table, keys)
        if len(cuts) > 1:
            yield [table.slice(s, e - s) for s, e in zip(cuts[:-1], cuts[1:])]
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield [rest]


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    """Starts of the runs, 0 first."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()
