"""FM-index over a sequence of word codes: suffix order, wavelet matrix, backward search, locate.

Code 0 ends a match: it stands for row ends and for every word that no phrase
holds, is never searched for, and each of its places sorts on its own.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions of ``codes`` (its last is 0) in suffix order, zeros told apart by position.

    Prefix doubling that sorts again only the suffixes that still tie, so long
    copies cost rounds in the logarithm of their length.
    """
    n = len(codes)
    zero = codes == 0
    first = codes.astype(np.int64) + int(zero.sum())
    first[zero] = np.arange(int(zero.sum()))
    key = first * (int(first.max()) + 1)
    key[:-1] += first[1:]
    key[zero] = first[zero] * (int(first.max()) + 1)  # a zero is settled by itself
    sa = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    slots, span, key = np.arange(n), 2, key[sa]
    while len(slots):
        new = np.empty(len(slots), dtype=bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[sa[slots]] = start
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        at = sa[slots]
        key = rank[at] * n + rank[np.minimum(at + span, n - 1)]
        order = np.argsort(key)
        sa[slots], key, span = at[order], key[order], 2 * span
    return sa


class FMIndex:
    """Counts and places of short code sequences in ``codes``."""

    def __init__(self, codes: np.ndarray, n_codes: int, step: int = 8):
        n = len(codes)
        sa = suffix_order(codes)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n_codes))))
        bwt = codes[sa - 1]
        # sampled places: every step-th, and those after a zero, so no walk steps over one
        marked = (sa % step == 0) | (bwt == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
        self.places = sa[marked]
        self.marked = marked
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(n_codes - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1 == 1
            count = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ones, out=count[1:], dtype=np.int32)
            self.levels.append((bit, count, n - int(count[-1])))
            bwt = np.concatenate((bwt[~ones], bwt[ones]))
        self.base = self._descend(np.arange(n_codes), np.zeros(n_codes, dtype=np.int64))

    def _descend(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, count, zeros in self.levels:
            ones = count[i]
            i = np.where((code >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``code`` stands in the first ``i`` places of the transform."""
        return self._descend(code, i) - self.base[code]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases (rows of codes, padded at the end), all searched backwards together."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.below[-1], dtype=np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            go = np.flatnonzero((sizes >= back) & (hi > lo))
            code = phrases[go, sizes[go] - back]
            lo[go] = self.below[code] + self.rank(code, lo[go])
            hi[go] = self.below[code] + self.rank(code, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``codes`` of the suffixes at ``rows``: walk back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        at, row, steps = np.arange(len(rows)), rows, 0
        while len(at):
            here = self.marked[row]
            out[at[here]] = self.places[self.marks[row[here]]] + steps
            at, row, steps = at[~here], row[~here], steps + 1
            code, i = np.zeros(len(row), dtype=np.int64), row
            for bit, count, zeros in self.levels:
                one = count[i + 1] - count[i]
                code |= one.astype(np.int64) << bit
                i = np.where(one == 1, zeros + count[i], i - count[i])
            row = self.below[code] + i - self.base[code]
        return out
