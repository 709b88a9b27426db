"""Arrow batches taken in portions of bounded size.

Spark hands a Python step batches of many rows, whatever a session sets. What a step makes of a row can be many times the
row, so a step over texts takes a few rows at a time and gives back what they became before it takes the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text of a portion; a longer text is a portion of its own.
ROWS, BYTES = 64, 1 << 20


def portions(text: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[slice]:
    """Consecutive slices of a batch, each of at most `rows` texts and about `size` bytes; one empty slice of an empty batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(text) or start == 0:
        before = ends[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield slice(start, min(end, len(text)))
        start = end
