"""SentencePiece encoding and decoding by a batched numpy Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from . import textnum as T

#: Positions of a long word that are hashed at a time.
POSITIONS = 1 << 18
#: What a step of ``viterbi`` for all words of a size costs, in bytes of a word taken by its positions; and a word's own start.
STEP_COST, WORD_COST = 300, 1000

#: The mark that SentencePiece writes for a space, in UTF-8.
MARK = b"\xe2\x96\x81"


@dataclass
class Vocabulary:
    """Pieces of a model file: hashes of their bytes in order, with ids and scores beside them."""

    keys: np.ndarray
    sieve: np.ndarray  # which first 20 bits the keys have
    ids: np.ndarray
    scores: np.ndarray
    lengths: list[int]  # byte lengths of pieces, longest first
    byte_ids: np.ndarray  # id of <0x00> .. <0xFF>
    byte_score: float
    surface: list[bytes]  # bytes that an id decodes to
    prefix: bool  # a space is put before the text


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte fallback and an identity normalizer.

    Piece scores are the model's own for a unigram model.  A BPE model has no
    scores but ranks; its piece of rank r gets -log(r + 2), so fewer and more
    frequent pieces win.  A byte costs more than any piece.  A model with a
    piece across a space is refused.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a model with byte fallback and an identity normalizer is needed, so that decoding gives the text back")
    processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
    surface, byte_ids, names, ids, scores = [], np.zeros(256, np.int32), [], [], []
    for i, piece in enumerate(model.pieces):
        raw = piece.piece.encode()
        if processor.is_byte(i):
            byte_ids[int(piece.piece[3:5], 16)] = i
            surface.append(bytes([int(piece.piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            surface.append(b"")
        else:
            surface.append(raw.replace(MARK, b" "))
            if MARK in piece.piece.lstrip(MARK.decode()).encode():
                raise ValueError(f"piece {i} holds a space after another character: texts could not be cut at spaces")
            names.append(raw)
            ids.append(i)
            scores.append(-np.log(2.0 - piece.score) if bpe else piece.score)
    flat = np.frombuffer(b"".join(names), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in names])
    keys = T.hash_spans(flat, np.concatenate(([0], ends[:-1])), ends)
    order = np.argsort(keys)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces share a hash")
    low = float(min(scores)) - 10.0
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[keys >> np.uint64(44)] = True
    return Vocabulary(keys[order], sieve, np.array(ids, np.int32)[order], np.array(scores)[order], sorted({len(x) for x in names}, reverse=True), byte_ids, low, surface, model.normalizer_spec.add_dummy_prefix)


def _lookup(vocab: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are pieces, and their places in the sorted keys."""
    maybe = np.flatnonzero(vocab.sieve[hashes >> np.uint64(44)])
    at = np.minimum(np.searchsorted(vocab.keys, hashes[maybe]), len(vocab.keys) - 1)
    found = vocab.keys[at] == hashes[maybe]
    return maybe[found], at[found]


def viterbi(data: np.ndarray, eight: np.ndarray, starts: np.ndarray, size: int, vocab: Vocabulary, plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of words of ``size`` bytes at ``starts``, all advanced together: ids, and ids per word.

    At each end position the last piece is a substring of one of the pieces' lengths,
    hashed and probed for every word at once, or a single byte.  The largest
    total score wins; at a tie the longest last piece.  ``plain`` flags bytes
    of ``data`` that are no space mark even if they look like one: pieces do
    not cover them.
    """
    n = len(starts)
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0.0
    step = np.zeros((size + 1, n), dtype=np.int32)
    via = np.zeros((size + 1, n), dtype=np.int32)
    barred = None if plain is None else np.concatenate(([0], np.cumsum(plain)))
    for end in range(1, size + 1):
        for back in vocab.lengths:
            if back > end:
                continue
            word, at = _lookup(vocab, T.hash_spans(data, starts + end - back, starts + end, eight))
            if barred is not None:
                open_ = barred[starts[word] + end] == barred[starts[word] + end - back]
                word, at = word[open_], at[open_]
            total = best[end - back][word] + vocab.scores[at]
            better = total > best[end][word]
            word = word[better]
            best[end][word] = total[better]
            step[end][word] = back
            via[end][word] = vocab.ids[at[better]]
        total = best[end - 1] + vocab.byte_score
        better = total > best[end]
        best[end][better] = total[better]
        step[end][better] = 1
        via[end][better] = vocab.byte_ids[data[starts[better] + end - 1]]
    place, alive = np.full(n, size), np.arange(n)
    out_word, out_id = [], []
    while len(alive):
        out_word.append(alive)
        out_id.append(via[place[alive], alive])
        place[alive] -= step[place[alive], alive]
        alive = alive[place[alive] > 0]
    if not out_word:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    word = np.concatenate(out_word[::-1])
    order = np.argsort(word, kind="stable")
    return np.concatenate(out_id[::-1])[order], np.bincount(word, minlength=n)


def viterbi_by_positions(data: np.ndarray, eight: np.ndarray, start: int, size: int, vocab: Vocabulary, plain: np.ndarray | None = None) -> np.ndarray:
    """The ids that ``viterbi`` gives, for one word of any size: all its positions advance together in the search for pieces.

    For each piece length all substrings of the word are hashed and probed;
    what remains is one maximum over the pieces found, end by end.
    """
    barred = None if plain is None else np.concatenate(([0], np.cumsum(plain[start : start + size])))
    ends, backs, places = [], [], []
    for back in vocab.lengths:
        for low in range(0, size - back + 1, POSITIONS):
            at = np.arange(low, min(low + POSITIONS, size - back + 1), dtype=np.int64)
            word, place = _lookup(vocab, T.hash_spans(data, start + at, start + at + back, eight))
            at = at[word]
            if barred is not None:
                open_ = barred[at + back] == barred[at]
                at, place = at[open_], place[open_]
            ends.append(at + back)
            backs.append(np.full(len(at), back, dtype=np.int32))
            places.append(place)
    end, back, place = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (ends, backs, places))
    order = np.argsort(end, kind="stable")  # longest pieces first at each end, as they were found
    back, first = back[order], np.searchsorted(end[order], np.arange(size + 2)).tolist()
    scores, ids = vocab.scores[place[order]].tolist(), vocab.ids[place[order]].tolist()
    back, letters = back.tolist(), data[start : start + size].tolist()
    best, step, via = [0.0] * (size + 1), [1] * (size + 1), [0] * (size + 1)
    for e in range(1, size + 1):
        top, width, chosen = -np.inf, 1, 0
        for k in range(first[e], first[e + 1]):
            total = best[e - back[k]] + scores[k]
            if total > top:
                top, width, chosen = total, back[k], ids[k]
        total = best[e - 1] + vocab.byte_score
        if total > top:
            top, width, chosen = total, 1, int(vocab.byte_ids[letters[e - 1]])
        best[e], step[e], via[e] = top, width, chosen
    out, e = [], size
    while e:
        out.append(via[e])
        e -= step[e]
    return np.array(out[::-1], dtype=np.int32)


def _escape(texts: list[str | None], prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Texts as model bytes, a mark for each space; offsets; and which bytes are marks that the text itself held."""
    raw = [("" if t is None else t).encode() for t in texts]
    odd = any(MARK in r for r in raw)
    marked, flags = [], []
    for r in raw:
        r = b" " + r if prefix and r else r
        if odd:
            parts = [np.zeros(0, bool)]
            for k, p in enumerate(r.split(MARK)):
                if k:
                    parts.append(np.ones(3, bool))
                parts.append(np.zeros(len(p) + 2 * p.count(b" "), bool))
            flags.append(np.concatenate(parts))
        marked.append(r.replace(b" ", MARK))
    offs = np.concatenate(([0], np.cumsum([len(r) for r in marked], dtype=np.int64)))
    return np.frombuffer(b"".join(marked), dtype=np.uint8), offs, np.concatenate(flags) if odd else None


def _word_edges(data: np.ndarray, offs: np.ndarray, plain: np.ndarray | None) -> np.ndarray:
    """First bytes of words: a word is a run of space marks with all that follows up to the next mark.

    No piece holds a mark after another character, so the best segmentation
    of a text is that of its words, one after the other.
    """
    n = len(data)
    mark = np.zeros(n + 3, dtype=bool)
    if n >= 3:
        mark[: n - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    if plain is not None:
        mark[:n] &= ~plain
    new = mark[:n].copy()
    new[3:] &= ~mark[: n - 3] if n > 3 else False
    new[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(new)


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and ids per text."""
    data, offs, plain = _escape(texts, vocab.prefix)
    starts = _word_edges(data, offs, plain)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    ends = np.append(starts[1:], len(data))
    eight = T.eights(data)
    hashes = T.hash_spans(data, starts, ends, eight)
    if plain is not None:  # the same bytes with and without literal marks are different words
        total = np.concatenate(([0], np.cumsum(plain)))
        odd = total[ends] > total[starts]
        hashes[odd] = T.mix(hashes[odd] ^ starts[odd].astype(np.uint64))
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    order = np.argsort(size, kind="stable")
    ids, per = [], np.zeros(len(first), dtype=np.int64)
    cut = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        group, width = order[a:b], int(size[order[a]])
        if len(group) * (width + WORD_COST) < STEP_COST * width:  # few long words: the same ids, without a step for every byte
            alone = [viterbi_by_positions(data, eight, int(w), width, vocab, plain) for w in starts[first[group]]]
            ids += alone
            per[group] = [len(x) for x in alone]
            continue
        got, count = viterbi(data, eight, starts[first[group]], width, vocab, plain)
        ids.append(got)
        per[group] = count
    flat = np.concatenate(ids)  # words by size
    begin = np.empty(len(first), dtype=np.int64)
    begin[order] = np.cumsum(per[order]) - per[order]
    n = per[of]
    place = np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    total = np.concatenate(([0], np.cumsum(n)))
    at = np.searchsorted(starts, offs)
    return flat[place], total[at[1:]] - total[at[:-1]]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of a sequence of ids; bytes that make no character become U+FFFD, ids outside the model are left out."""
    raw = b"".join([vocab.surface[i] for i in ids.tolist() if 0 <= i < len(vocab.surface)])
    return (raw[1:] if vocab.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _shared(spark: SparkSession, path: str):
    """The vocabulary, read once by the driver and broadcast: a model file has a fixed size."""
    return spark.sparkContext.broadcast(load(path))


def _with_column(df: DataFrame, name: str, kind: T_.DataType) -> tuple[DataFrame, T_.StructType]:
    """``df`` without a column ``name``, and its schema with one at the end."""
    schema = T_.StructType([f for f in df.schema if f.name != name] + [T_.StructField(name, kind)])
    return df.select(*[F.col(f"`{c}`") for c in schema.names[:-1]]), schema


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the whole text as piece ids; an empty text has none, a null text null ids.

    Rows may repeat; a column named ``out_col`` is replaced, all others pass
    through; an empty table gives an empty result.
    """
    shared = _shared(docs.sparkSession, path)
    src, schema = _with_column(docs, out_col, T_.ArrayType(T_.IntegerType()))
    place = src.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, text_col, 1 << 22):
            texts = batch.column(place).to_pylist()
            ids, per_row = encode_texts(texts, shared.value)
            offs = pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32))
            none = pa.array([t is None for t in texts])
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(offs, ids, mask=none)], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the text of ``ids_col``; null ids give a null text, null elements are left out."""
    shared = _shared(encoded.sparkSession, path)
    src, schema = _with_column(encoded, out_col, T_.StringType())
    place = src.columns.index(ids_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vocab, texts = shared.value, []
            for row in batch.column(place):
                texts.append(decode_ids(row.values.drop_null().to_numpy(zero_copy_only=False), vocab) if row.is_valid else None)
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
