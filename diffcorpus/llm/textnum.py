"""Numpy text primitives on Arrow string columns: whole-batch word splitting and hashing.

A batch of texts is one flat byte array with row offsets.  Words are maximal
runs of word bytes inside one row; each gets a 64-bit hash of its
lower-cased (A-Z) bytes, so equal words have equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of text handled at a time, by bytes; a longer row is a block of its own.
BLOCK_BYTES = 1 << 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words between ASCII white space: [^\x20\x09-\x0D]+.
SPACED = np.ones(256, dtype=bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False

_MULT = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on a uint64 array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def row_blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) and words per row; ``data`` is lower-cased already."""
    is_word = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    per_row = np.diff(np.searchsorted(starts, offs))
    return starts, ends, per_row


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the eight bytes from there on, as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1)).view("<u8")[:, 0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span, read eight bytes at a time; spans may overlap.  ``eight``: ``eights(data)``, if at hand."""
    eight = eights(data) if eight is None else eight
    left = ends - starts
    out = left.astype(np.uint64) * _MULT
    at, now = np.arange(len(starts)), starts
    while len(at):
        out[at] = mix(out[at] ^ (eight[now] & _KEEP[np.minimum(left, 8)])) + _MULT
        more = left > 8
        at, now, left = at[more], now[more] + 8, left[more] - 8
    return out


def hash_words(col: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, in order, and words per row."""
    data, offs = flat_bytes(col)
    data = lower(data)
    starts, ends, per_row = words(data, offs, word_bytes)
    return hash_spans(data, starts, ends), per_row


def row_sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sum of consecutive ``values`` by row; 0.0 for a row without values."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]


def batches(source: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``limit`` text bytes (one row at least)."""
    for batch in source:
        col = batch.column(text)
        lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        offs = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        for i, j in row_blocks(offs, limit):
            yield batch.slice(i, j - i)
