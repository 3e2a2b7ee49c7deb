"""Arrow batches cut to a bounded number of rows and of bytes of text, so that memory does not depend on the length of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 12_000_000


def pieces(batch: pa.RecordBatch, text: int, rows: int, most_bytes: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts (column ``text``) have at most ``most_bytes`` in all; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
