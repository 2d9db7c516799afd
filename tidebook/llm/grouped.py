"""Helpers inside tasks: groups of sorted rows, connected parts of a small matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected part."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] >= 0:
            continue
        root[first] = first
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & (root < 0))
            root[front] = first
    return root


def runs_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first columns, however they fall into batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for c in range(columns):
            values = batch.column(c).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            changes[0] |= bool(held) and values[0] != held[-1].column(c)[held[-1].num_rows - 1].as_py()
        at = 0
        for end in np.flatnonzero(changes):
            if end > at:
                held.append(batch.slice(at, end - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
