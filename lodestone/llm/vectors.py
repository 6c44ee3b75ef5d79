"""What the vector operators share: whole-number matrices from Arrow batches of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers beyond this would let sums of squares leave 64 bits.
LARGEST = 1 << 26


def whole_vectors(batch: pa.RecordBatch, at: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vector (a list of doubles at position ``at``) is complete and finite, and floor(scale * x) of them.

    Vectors of unlike lengths, and numbers beyond ``LARGEST``, raise ``ValueError``.
    """
    column = batch.column(at)
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(there)) if len(there) < batch.num_rows else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    rows = np.repeat(np.arange(len(there)), sizes)
    bad = np.zeros(len(there), dtype=bool)
    bad[rows[~np.isfinite(values)]] = True
    good = ~bad
    widths = np.unique(sizes[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of unlike lengths: {widths.tolist()}")
    if not len(widths):
        return np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.int64)
    scaled = np.floor(scale * values[good[rows]]).reshape(int(good.sum()), int(widths[0]))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return there[good], scaled.astype(np.int64)
