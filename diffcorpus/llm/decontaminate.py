"""Benchmark decontamination: an FM-index per training shard, searched for all test phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .fmindex import FMIndex
from .stages import stage

#: Words in one index, words of test items in one block (about), and in one piece of a long item.
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
PIECE_WORDS = 1 << 16


@dataclass
class Phrases:
    """A block of test phrases: sorted word hashes, windows as codes 1.. of them, and their items."""

    vocabulary: np.ndarray
    windows: np.ndarray
    sizes: np.ndarray
    items: list[str]
    first: np.ndarray  # the items of window w: item_of[first[w]:first[w + 1]]
    item_of: np.ndarray


def phrase_block(items: list[tuple[str, np.ndarray]], window: int) -> Phrases:
    """Distinct windows of ``window`` consecutive words; a shorter item is one window."""
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    cut, who = [], []
    for name, hashes in items:
        codes = np.searchsorted(vocabulary, hashes).astype(np.int64) + 1
        rows = np.zeros((max(1, len(codes) - window + 1), window), dtype=np.int64)
        if len(codes) >= window:
            rows[:] = np.lib.stride_tricks.sliding_window_view(codes, window)
        else:
            rows[0, : len(codes)] = codes
        cut.append(rows)
        who.append(np.full(len(rows), number[name], dtype=np.int64))
    windows, which = np.unique(np.concatenate(cut), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(who)], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
    return Phrases(vocabulary, windows, (windows > 0).sum(axis=1), names, first, pairs[:, 1])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, in order."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _item_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words)``: word hashes of the test items; a long item in pieces that overlap, so that no window is lost."""
    size = max(PIECE_WORDS, 2 * window)

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, "text", 1 << 22):
            hashes, per_row = T.hash_words(batch.column("text"), T.ALNUM)
            ends = np.cumsum(per_row)
            cuts = [(row, a, min(a + size, n)) for row, n in enumerate(per_row.tolist()) for a in range(0, max(1, n - window + 1), size - window + 1) if n]
            if cuts:
                row, first, last = (np.array(x) for x in zip(*cuts))
                begin = ends[row] - per_row[row]
                words = pa.array(hashes[_ranges(begin + first, begin + last)].view(np.int64))
                offs = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
                yield pa.record_batch([batch.column("item").take(pa.array(row)), pa.ListArray.from_arrays(offs, words)], names=["item", "words"])

    src = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(hashed, "item string, words array<long>")


def _phrase_files(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[str]:
    """The test phrases in blocks of about ``BLOCK_WORDS`` words, as files that every executor fetches once.

    Tasks cut the items into blocks and write one row a block to the shared
    folder; only the names of the files come to the driver.
    """

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in source:  # one partition is one block
            words, offs = batch.column("words"), batch.column("words").offsets.to_numpy()
            flat = words.values.to_numpy().view(np.uint64)
            items += [(item, flat[a:b]) for item, a, b in zip(batch.column("item").to_pylist(), offs[:-1], offs[1:])]
        if items:
            p = phrase_block(items, window)
            held = [p.vocabulary.view(np.int64), p.windows.astype(np.int32).ravel(), p.items, p.first, p.item_of]
            yield pa.record_batch([pa.array([x]) for x in held], names=["vocabulary", "windows", "items", "first", "item_of"])

    spark = benchmark.sparkSession
    pieces = stage(_item_pieces(benchmark, item_col, text_col, window), "phrase-words")
    n_words = pieces.agg(F.sum(F.size("words"))).first()[0]
    if not n_words:
        return []
    schema = "vocabulary array<long>, windows array<int>, items array<string>, first array<long>, item_of array<long>"
    files = stage(pieces.repartition(-(-n_words // BLOCK_WORDS)).mapInArrow(blocks, schema), "phrases").inputFiles()
    for file in files:
        spark.sparkContext.addFile(file)
    return [unquote(file.rsplit("/", 1)[1]) for file in files]


_held: dict[str, Phrases | None] = {}  # of each Python worker: the block it searched last, and no other


def _block(name: str, window: int) -> Phrases | None:
    """A block from the executor's copy of its file; none if the file holds no phrase."""
    if name not in _held:
        _held.clear()
        rows = pq.ParquetFile(SparkFiles.get(name)).read()
        if rows.num_rows:
            vocabulary, windows, first, item_of = (rows[c].chunk(0).values.to_numpy() for c in ("vocabulary", "windows", "first", "item_of"))
            windows = windows.reshape(-1, window)
            _held[name] = Phrases(vocabulary.view(np.uint64), windows, (windows > 0).sum(axis=1), rows["items"][0].as_py(), first, item_of)
        else:
            _held[name] = None
    return _held[name]


def search_rows(hashes: np.ndarray, per_row: np.ndarray, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hit flag per word, and distinct (row, item) pairs, of the phrases in consecutive rows of hashed words.

    The words are indexed in pieces of ``shard_words``; pieces overlap by a
    window, so a row longer than a piece loses nothing.
    """
    n_rows, window = len(per_row), phrases.windows.shape[1]
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    code = np.where(phrases.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
    row_of = np.repeat(np.arange(n_rows), per_row)
    codes = np.zeros(len(hashes) + n_rows, dtype=np.int32)  # one zero after each row
    place = np.arange(len(hashes)) + row_of
    codes[place] = code
    row_at = np.repeat(np.arange(n_rows), per_row + 1)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for a in range(0, len(codes), shard_words):
        piece = np.append(codes[a : a + shard_words + window], np.int32(0))
        if not piece.any():
            continue
        index = FMIndex(piece, len(phrases.vocabulary) + 1)
        lo, hi = index.search(phrases.windows, phrases.sizes)
        hit = np.flatnonzero(hi > lo)
        which = np.repeat(hit, (hi - lo)[hit])
        starts = index.locate(_ranges(lo[hit], hi[hit])) + a
        edge += np.bincount(starts, minlength=len(edge)) - np.bincount(starts + phrases.sizes[which], minlength=len(edge))
        seen = np.unique(row_at[starts] * np.int64(len(phrases.windows)) + which)
        rows, which = seen // len(phrases.windows), seen % len(phrases.windows)
        many = phrases.first[which + 1] - phrases.first[which]
        items = phrases.item_of[_ranges(phrases.first[which], phrases.first[which + 1])]
        found.append(np.unique(np.stack([np.repeat(rows, many), items], axis=1), axis=0))
    return np.cumsum(edge)[place] > 0, np.unique(np.concatenate(found), axis=0)


def _spans(hit: np.ndarray, row_of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words of one row, merged: row, first byte, byte after the last."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(row_of[at]) > 0)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return row_of[at[new]], starts[at[new]], ends[at[last]]


def _scan(batch: pa.RecordBatch, blocks: list[str], window: int) -> dict[str, list | np.ndarray]:
    data, offs = T.flat_bytes(batch.column("text"))
    data = T.lower(data)
    starts, ends, per_row = T.words(data, offs, T.ALNUM)
    hashes = T.hash_spans(data, starts, ends)
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    hit = np.zeros(len(hashes), dtype=bool)
    items: list[set[str]] = [set() for _ in per_row]
    for name in blocks:
        phrases = _block(name, window)
        if phrases is None:
            continue
        flags, pairs = search_rows(hashes, per_row, phrases)
        hit |= flags
        for row, item in pairs.tolist():
            items[row].add(phrases.items[item])
    row, first, last = _spans(hit, row_of, starts, ends)
    spans: list[list[int]] = [[] for _ in per_row]
    for r, a, b in zip(row.tolist(), (first - offs[row]).tolist(), (last - offs[row]).tolist()):
        spans[r] += (a, b)
    return {"n_words": per_row, "n_hit": np.bincount(row_of[hit], minlength=len(per_row)), "items": [sorted(x) for x in items], "spans": spans}


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10
) -> DataFrame:
    """``(doc, n_words, n_hit, items, spans)`` per row of ``docs``.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is
    lower-cased.  ``items``: ids (as text) of the benchmark rows with a window
    in the text; ``spans``: merged byte ranges to remove, as start, end, start,
    end.  Null and wordless texts hit nothing; benchmark rows with a null id
    or no words take no part; rows of one item id count once.  Rows and ids of
    ``docs`` may repeat, other columns are not read, and either table may be
    empty.
    """
    blocks = _phrase_files(benchmark, item_col, item_text_col, window)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, "text", 1 << 22):
            got = _scan(batch, blocks, window)
            yield pa.record_batch(
                [batch.column("doc"), pa.array(got["n_words"]), pa.array(got["n_hit"]), pa.array(got["items"], pa.list_(pa.string())), pa.array(got["spans"], pa.list_(pa.int64()))],
                names=["doc", "n_words", "n_hit", "items", "spans"],
            )

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<long>")


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with every merged benchmark span cut out of ``text_col``; texts without one stay as they are.

    Null texts stay null, repeated rows each stay, other columns pass
    unchanged whatever their names; either table may be empty.
    """
    blocks = _phrase_files(benchmark, item_col, item_text_col, window)
    names, place = docs.columns, docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, text_col, 1 << 22):
            col = batch.column(place)
            spans = _scan(pa.record_batch([col], names=["text"]), blocks, window)["spans"]
            if any(spans):
                texts = col.to_pylist()
                for i, cut in enumerate(spans):
                    if cut:
                        raw = texts[i].encode()
                        ends = [0, *cut[1::2]]
                        texts[i] = b"".join(raw[a:b] for a, b in zip(ends, [*cut[::2], len(raw)])).decode()
                col = pa.array(texts, batch.schema.field(place).type)
            yield pa.record_batch([*batch.columns[:place], col, *batch.columns[place + 1 :]], names=names)

    return docs.mapInArrow(run, docs.schema)
