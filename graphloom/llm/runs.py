"""Groups of consecutive rows that Arrow batches may cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def group_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys (not null), in tables that end where a group does; the last group of a batch waits for the next."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        same = np.logical_and.reduce([new.column(c).to_numpy() == new.column(c)[-1].as_py() for c in keys])
        at = int(np.argmax(same))  # where the batch's last group begins
        if held and (at or any(held[0].column(c)[0].as_py() != new.column(c)[0].as_py() for c in keys)):
            yield pa.concat_tables([*held, new.slice(0, at)])
            held = []
        elif at:
            yield new.slice(0, at)
        held.append(new.slice(at))
    if held:
        yield pa.concat_tables(held)


def group_cuts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a table sorted by keys begin, and its end."""
    if not table.num_rows:
        return np.zeros(1, dtype=np.int64)
    group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
    return np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]])
