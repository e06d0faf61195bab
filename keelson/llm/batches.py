"""What the operators on Arrow batches share: slices of texts and a hash finalizer."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
#: For work that takes many times its texts: tens of bytes for each word.
SMALL_SLICE_BYTES = 2 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it
        pass


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows whose texts have about `size` bytes together, or one longer text. Memory is released when they end."""
    for b in batches:
        texts = pc.fill_null(b.column("text"), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at), texts.slice(at, to - at)
            at = to
    release()
