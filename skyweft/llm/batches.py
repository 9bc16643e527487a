"""Arrow batches in slices, so that a task holds few texts as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice, and bytes of texts; a slice has one row at least, whatever its length.
SLICE_ROWS = 500
SLICE_BYTES = 8 << 20


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of up to ``rows`` and up to ``most`` bytes of texts; an empty batch gives none."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        lo = 0
        while lo < batch.num_rows:
            fit = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
            hi = min(max(fit, lo + 1), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
