"""Small text helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task holds as Python objects at a time.
SLICE = 512

#: The six separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows: texts may be long, and a batch holds ten thousand of them."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def intern_words(words: list[bytes]) -> np.ndarray:
    """A small integer for each word; equal words get equal integers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
