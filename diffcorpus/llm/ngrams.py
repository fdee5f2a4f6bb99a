"""Hashed byte n-gram counts of whole texts, as dense rows for small blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textnum as T


def ngram_counts(data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], n_buckets: int) -> np.ndarray:
    """(rows, n_buckets) counts of the hashed n-grams that lie inside one row; ``n_buckets`` is a power of two."""
    rows, shift = len(offs) - 1, np.uint32(32 - int(n_buckets).bit_length() + 1)
    row_of = np.repeat(np.arange(rows, dtype=np.int64) * n_buckets, np.diff(offs))
    out = np.zeros(rows * n_buckets, dtype=np.int64)
    wide = data.astype(np.uint32)
    for n in sizes:
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            key = (key ^ wide[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
        key = ((key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift
        inside = row_of[: len(key)] == row_of[n - 1 :]
        out += np.bincount((row_of[: len(key)] + key)[inside], minlength=len(out))
    return out.reshape(rows, n_buckets)


def blocks(batch: pa.RecordBatch, text: str, lowered: bool, max_rows: int = 32) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of at most ``max_rows`` rows and about a megabyte."""
    data, offs = T.flat_bytes(batch.column(text))
    for i, j in T.row_blocks(offs, 1 << 20):
        for a in range(i, j, max_rows):
            b = min(a + max_rows, j)
            part = data[offs[a] : offs[b]]
            yield a, b, T.lower(part) if lowered else part, offs[a : b + 1] - offs[a]


def sparse_rows(source: Iterator[pa.RecordBatch], sizes: tuple[int, ...], n_buckets: int, lowered: bool) -> Iterator[pa.RecordBatch]:
    """(label, buckets, counts) of the rows of (label, text): what a bounded training sample sends to the driver."""
    for batch in T.batches(source, "text", 1 << 22):
        for a, b, data, offs in blocks(batch, "text", lowered):
            counts = ngram_counts(data, offs, sizes, n_buckets)
            row, bucket = np.nonzero(counts)
            at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            yield pa.record_batch(
                [batch.column("label").slice(a, b - a), pa.ListArray.from_arrays(at, bucket.astype(np.int32)), pa.ListArray.from_arrays(at, counts[row, bucket].astype(np.int32))],
                names=["label", "buckets", "counts"],
            )


def dense(buckets: list[np.ndarray], counts: list[np.ndarray], n_buckets: int) -> np.ndarray:
    out = np.zeros((len(buckets), n_buckets), dtype=np.float32)
    for i, (b, c) in enumerate(zip(buckets, counts)):
        out[i, b] = c
    return out


def list_column(col: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as numpy views."""
    out: list[np.ndarray] = []
    for chunk in col.chunks:
        values, offs = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offs[:-1], offs[1:])]
    return out
