"""Byte-level BPE with a merge-rank table (Q2): a batch of texts at a time.

A vocabulary file in the public ``<base64 token> <rank>`` form is read once
on the driver and travels with the function, so executors need no file of
their own.  Texts are cut into pieces by a pattern; every distinct piece of a
batch is merged once, all short pieces together in numpy rounds.
"""

from __future__ import annotations

import base64
import heapq
import sys

import numpy as np
import regex

from .tokenizers import UdfTokenizer

#: The piece pattern of the public 50k byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of more bytes are merged one at a time, with a heap.
LONG_PIECE = 64
#: Characters of text whose pieces are merged together.
BLOCK_CHARS = 1 << 20


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids are ranks."""

    def __init__(self, file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: it has no token for byte {missing[0]}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(self.ranks.values()) + 1
        # a pair may merge when its bytes together are a token, however that token came about
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``base`` for those that do not merge."""
        if not len(self.keys):
            return np.full(len(key), self.base)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.base)

    def _merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of short pieces: in every round each piece merges its pair of lowest rank, the leftmost of equal ones."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        out: list[list[int]] = [[] for _ in pieces]
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            rank = np.full(len(ids), self.base)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._rank(ids[inner] * self.base + ids[inner + 1])
            place = np.arange(len(ids))
            best = np.minimum.reduceat(rank * len(ids) + place, starts)
            pick, low = best % len(ids), best // len(ids)
            settled = low == self.base
            ends = np.append(starts[1:], len(ids))
            for k in np.flatnonzero(settled):
                out[owner[starts[k]]] = ids[starts[k] : ends[k]].tolist()
            pick, low = pick[~settled], low[~settled]
            ids[pick] = low
            keep = np.repeat(~settled, ends - starts)
            keep[pick + 1] = False
            ids, owner = ids[keep], owner[keep]
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, with a heap of pairs and links between the parts."""
        ids = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, base, pairs = len(ids), self.base, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pairs.get(rank * base + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0:
                if (r := pairs.get(ids[before[i]] * base + rank)) is not None:
                    heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of every text; null for a null text."""
        out: list[list[int] | None] = []
        block: list[str | None] = []
        chars = 0
        for text in texts:
            block.append(text)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                out += self._encode(block)
                block, chars = [], 0
        return out + self._encode(block)

    def _encode(self, texts: list[str | None]) -> list[list[int] | None]:
        cut = [None if t is None else self.pattern.findall(t) for t in texts]
        pieces = list(dict.fromkeys(p for ps in cut if ps for p in ps))
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_PIECE]
        ids = dict(zip((pieces[i] for i in short), self._merge_all([raw[i] for i in short]))) if short else {}
        ids.update((pieces[i], self._merge_long(b)) for i, b in enumerate(raw) if len(b) > LONG_PIECE)
        return [None if ps is None else [x for p in ps for x in ids[p]] for ps in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


class _Encode:
    """A batch ``encode`` that builds its vocabulary once a worker process."""

    def __init__(self, file: bytes, pattern: str):
        self.file, self.pattern = file, pattern

    def __call__(self, texts):
        loaded = sys.__dict__.setdefault("_diffcorpus_vocabularies", {})
        key = (hash(self.file), self.pattern)
        if key not in loaded:
            loaded.clear()  # one vocabulary at a time
            loaded[key] = ByteBpe(self.file, self.pattern)
        return loaded[key].encode(texts)


class BpeTokenizer(UdfTokenizer):
    """Q2 with a public byte-level vocabulary (``path`` on the driver, at most ``max_bytes``)."""

    def __init__(self, path: str, pad_id: int | None = None, eos_id: int | None = 50256, pattern: str = PATTERN, max_bytes: int = 64 << 20):
        with open(path, "rb") as f:
            file = f.read(max_bytes + 1)
        if len(file) > max_bytes:
            raise ValueError(f"{path} has more than {max_bytes} bytes")
        super().__init__(_Encode(file, pattern), pad_id, eos_id)
