"""Language-model scoring with a hierarchical Pitman-Yor model.

Every context, which is the word before (the end of a text, for the first
word), is a restaurant of its own, and all of them share one parent, whose
base spreads evenly over the known words and one unknown.  Customers are the
training tokens; at how many tables they sit is sampled by Gibbs sweeps that
reseat all of them, and predictions, which need no more than these numbers,
are averaged over the kept samples.

Layout: texts are cut into chunks of about ``CHUNK`` tokens.  A chunk sends the
64-bit keys of its distinct (word, context) pairs to ``BUCKETS`` parts, where
they are counted over all chunks; one chunk of those that have a pair reports
it.  A pair counted once has one table whatever the sweep, so it goes into sums
by word and by context, which a chunk sends by parts of the words' hashes; pairs
counted more often are rows of a table.  A sweep joins that table with its words'
weight in the parent and its contexts' tables, both from the table of words.
Tables of pairs, and of words with their restaurants' totals, then meet the
chunks' keys part by part and go back by chunk, where the tokens wait as indexes.
Nothing that grows with the words or the contexts is in one row or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .seating import draw_tables
from .stages import drop, drop_shuffles, stage

CHUNK = 5 << 20
#: Places of a vector of contexts (``_sweep``, ``_pack``); the model of ``score`` has a restaurant for every word.
CONTEXTS = 1 << 10
_SPAN = 2 * CONTEXTS  # above any context number, for (word, context) keys
#: The end of a text, as a word of its own.
_END = np.uint64(0x5EED0E0F7E875A11)

#: Parts that the keys of pairs, and the hashes of words, are dealt to; what is in a part is counted in one task.
BUCKETS = 1 << 10
_SHIFT = np.uint64(54)
#: Pairs of a chunk that are hashed, or predicted, at a time.
BLOCK = 1 << 18
#: Rows of the model that go into parcels together.
PARCEL = 1 << 20


@dataclass
class Totals:
    """What a sweep needs to know of all words: tokens and tables per context, and the parent's totals."""

    customers: np.ndarray
    tables: np.ndarray
    tokens: int
    words: int
    root_tables: int
    discount: float
    root_discount: float
    strength: float
    root_strength: float
    all_tables: int | None = None  # where ``tables`` does not have every context

    def root_new(self) -> float:
        """Weight of a new table in the parent, for any one word."""
        return (self.root_strength + self.root_discount * self.root_tables) / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the parent, by their customers and tables there."""
        return (customers - self.root_discount * tables + self.root_new()) / (self.root_strength + (self.tables.sum() if self.all_tables is None else self.all_tables))

    def predict(self, ctx: np.ndarray, c: np.ndarray, nt: np.ndarray, parent: np.ndarray) -> np.ndarray:
        back = self.strength + self.discount * self.tables[ctx]
        return (c - self.discount * nt + back * parent) / (self.strength + self.customers[ctx])


def _lists(offs: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    offs = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], np.diff(offs)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _group_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    at = _offsets(sizes)
    return total[at[1:]] - total[at[:-1]]


def _pack(ctx: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per word its contexts and counts as bytes: a flag, two bytes a context, one a count, or four if one needs them."""
    wide = np.maximum.reduceat(n, np.cumsum(sizes) - sizes) > 255
    width = np.where(wide, 4, 1)
    offs = _offsets(1 + (2 + width) * sizes)
    out = np.zeros(int(offs[-1]), dtype=np.uint8)
    out[offs[:-1]] = wide
    nth = np.arange(len(ctx)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(offs[:-1] + 1, sizes) + 2 * nth
    out[at], out[at + 1] = ctx & 255, ctx >> 8
    at = np.repeat(offs[:-1] + 1 + 2 * sizes, sizes) + np.repeat(width, sizes) * nth
    out[at] = n & 255
    far = np.repeat(wide, sizes)
    for k in range(1, 4):
        out[at[far] + k] = (n[far] >> (8 * k)) & 255
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(out)])


def _unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, counts and pairs per word."""
    data, offs = T.flat_bytes(col)
    size = np.diff(offs)
    wide = data[offs[:-1]] > 0
    width = np.where(wide, 4, 1)
    sizes = (size - 1) // (2 + width)
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(offs[:-1] + 1, sizes) + 2 * nth
    ctx = data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8)
    at = np.repeat(offs[:-1] + 1 + 2 * sizes, sizes) + np.repeat(width, sizes) * nth
    n = data[at].astype(np.int64)
    far = np.repeat(wide, sizes)
    for k in range(1, 4):
        n[far] |= data[at[far] + k].astype(np.int64) << (8 * k)
    return ctx, n, sizes


def _squeeze(numbers: np.ndarray) -> bytes:
    """Compressed int32, its four bytes in planes."""
    return pa.Codec("zstd", compression_level=3).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unsqueeze(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<i4").ravel()


def _chunk(docs: list[pa.Array], hashes: list[np.ndarray], sizes: list[np.ndarray], learn: list[np.ndarray], number: int) -> pa.RecordBatch:
    """A chunk's row: its texts as word numbers (the commonest word is 0), and the words' hashes."""
    size = np.concatenate(sizes) + 1
    total = int(size.sum())
    is_end = np.zeros(total, dtype=bool)
    is_end[np.cumsum(size) - 1] = True
    tokens = np.full(total, _END, dtype=np.uint64)
    tokens[~is_end] = np.concatenate(hashes)
    coded = pa.array(tokens).dictionary_encode()
    word, of_word = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    often = np.bincount(of_word)
    number_of = np.empty(len(word), dtype=np.int32)
    by_count = np.argsort(-often, kind="stable")
    number_of[by_count] = np.arange(len(word))
    doc = pa.concat_arrays(docs)
    return pa.record_batch(
        [
            pa.array([number]),
            pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc),
            _lists(np.array([0, len(size)]), size.astype(np.int32)),
            pa.array([np.concatenate(learn).astype(np.uint8).tobytes()], pa.binary()),
            pa.array([word[by_count].tobytes()], pa.binary()),
            pa.array([_squeeze(number_of[of_word])], pa.binary()),
        ],
        names=["chunk", "docs", "sizes", "learn", "words", "numbers"],
    )


def _distinct(numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and of each number its place there; ``numbers`` are overwritten, and sorted with their places where both fit 63 bits."""
    shift = len(numbers).bit_length()
    if below << shift >= 1 << 63:
        values, of = np.unique(numbers, return_inverse=True)
        return values, of.ravel()
    numbers <<= shift
    numbers |= np.arange(len(numbers))
    numbers.sort()
    at = numbers & ((1 << shift) - 1)
    numbers >>= shift
    first = np.ones(len(numbers), dtype=bool)
    first[1:] = numbers[1:] != numbers[:-1]
    of = np.empty(len(numbers), dtype=np.int32)
    of[at] = np.cumsum(first, dtype=np.int32) - 1
    return numbers[first], of


class _Texts:
    """A chunk's row read back: its tokens, and its distinct pairs in the order of their keys."""

    def __init__(self, row: pa.Table):
        row = row.combine_chunks()
        self.size = _flat(row["sizes"].combine_chunks())[0].astype(np.int64)
        self.word = np.frombuffer(row["words"][0].as_py(), np.uint64)
        self.tokens = _unsqueeze(row["numbers"][0].as_py(), int(self.size.sum()))
        self.learn = np.repeat(np.frombuffer(row["learn"][0].as_py(), np.uint8) > 0, self.size)
        self.begin = np.cumsum(self.size) - self.size
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.begin] = np.flatnonzero(self.word == _END)[0]  # a text begins after an end
        pair = self.tokens.astype(np.int64)
        pair *= len(self.word)
        pair += before
        del before
        pair, of = _distinct(pair, len(self.word) ** 2)
        w, ctx, key = np.empty(len(pair), np.int32), np.empty(len(pair), np.int32), np.empty(len(pair), np.uint64)
        for a in range(0, len(pair), BLOCK):
            some = slice(a, a + BLOCK)
            w[some], ctx[some] = np.divmod(pair[some], len(self.word))
            key[some] = _key(self.word[ctx[some]], self.word[w[some]])
        del pair
        order = np.argsort(key)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.of, self.key, self.w, self.ctx = place[of], key[order], w[order], ctx[order]


def _key(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of a word and the word before it."""
    return T.mix(T.mix(ctx + np.uint64(1)) ^ w)


def _split(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second bytes, and so on: what is small compresses well."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unsplit(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _small(numbers: np.ndarray) -> bytes:
    return _split(numbers.astype("<u4"))


def _column(rows: pa.Table, name: str, kind: str = "<u4") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unsplit(x.as_buffer(), kind) for x in rows[name] if x.is_valid)])


def _samples(rows: pa.Table, name: str, kind: str, samples: int) -> np.ndarray:
    """The numbers of each sample in a row of their own."""
    return np.concatenate([np.zeros((samples, 0), kind), *(_unsplit(x.as_buffer(), kind).reshape(samples, -1) for x in rows[name] if x.is_valid)], axis=1)


def _cuts(keys: np.ndarray) -> tuple[pa.Array, list[slice]]:
    """The buckets that have some of the keys, which are in order, and where."""
    cut = np.searchsorted(keys >> _SHIFT, np.arange(BUCKETS + 1, dtype=np.uint64))
    have = np.flatnonzero(np.diff(cut))
    return pa.array(have.astype(np.int32)), [slice(cut[b], cut[b + 1]) for b in have]


def _steps(keys: np.ndarray) -> bytes:
    return _split(np.diff(keys, prepend=np.uint64(0)))


def _keys(rows: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(_unsplit(x.as_buffer(), "<u8"), dtype=np.uint64) for x in rows["keys"]]


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _each(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Texts]]:
    for batch in source:
        for i in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            yield row["chunk"][0].as_py(), _Texts(row)


def _ask(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket of keys: keys in order, as steps, and how often each pair is learnt."""
    for number, texts in _each(source):
        n = np.bincount(texts.of[texts.learn], minlength=len(texts.key))
        bucket, at = _cuts(texts.key)
        yield pa.record_batch(
            [bucket, pa.array(np.full(len(at), number)), _binary([_steps(texts.key[x]) for x in at]), _binary([_small(n[x]) for x in at])],
            names=["bucket", "chunk", "keys", "n"],
        )


def _count(asked: pa.Table) -> pa.Table:
    """A bucket: for each chunk the whole counts of its pairs, which of them it is to report, and the places of those counted twice or more."""
    keys = _keys(asked)
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    c = np.bincount(at.ravel(), weights=_column(asked, "n")).astype(np.int64)
    place = np.cumsum(c > 1) - 1
    own = np.zeros(len(at), dtype=np.uint8)
    own[first] = 1
    cut = _offsets(np.array([len(k) for k in keys]))
    counts, owns, places = [], [], []
    for a, b in zip(cut[:-1], cut[1:]):
        here = at[a:b]
        counts.append(_small(c[here]))
        owns.append(own[a:b].tobytes())
        places.append(_small(place[here[c[here] > 1]]))
    return pa.table({"bucket": asked["bucket"], "chunk": asked["chunk"], "c": pa.array(counts, pa.binary()), "own": pa.array(owns, pa.binary()), "places": pa.array(places, pa.binary())})


def _report(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's words by bucket of their hashes, with their counts and the pairs counted once by word and by context; and the pairs counted more often."""
    texts, right = _Texts(left), right.sort_by("bucket")
    c = _column(right, "c").astype(np.int64)
    own = _column(right, "own", "u1") > 0
    words, once, more = len(texts.word), np.flatnonzero(own & (c == 1)), np.flatnonzero(own & (c > 1))
    order = np.argsort(texts.word)
    bucket, at = _cuts(texts.word[order])
    by_word = {
        "n": np.bincount(texts.tokens[texts.learn], minlength=words),
        "once": np.bincount(texts.w[once], minlength=words),
        "ctx_once": np.bincount(texts.ctx[once], minlength=words),
    }
    hashes = texts.word.view(np.int64)
    return pa.concat_tables(
        [
            pa.table({"bucket": bucket, "keys": _binary([_steps(texts.word[order[x]]) for x in at]), **{k: _binary([_small(v[order[x]]) for x in at]) for k, v in by_word.items()}}),
            pa.table({"w": hashes[texts.w[more]], "ctx": hashes[texts.ctx[more]], "c": c[more]}),
        ],
        promote_options="default",
    )


def _sum_words(told: pa.Table) -> pa.Table:
    """A bucket of words: their counts over all chunks."""
    w, at = np.unique(np.concatenate(_keys(told)), return_inverse=True)
    total = lambda x: np.bincount(at.ravel(), weights=_column(told, x)).astype(np.int64)
    return pa.table({"w": w.view(np.int64), "c": total("n"), "once": total("once"), "ctx_once": total("ctx_once")})


def _ask_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket of words: their hashes in order, as steps."""
    for batch in source:
        for number, raw in zip(batch.column("chunk").to_pylist(), batch.column("words")):
            word = np.sort(np.frombuffer(raw.as_buffer(), np.uint64))
            bucket, at = _cuts(word)
            yield pa.record_batch([bucket, pa.array(np.full(len(at), number)), _binary([_steps(word[x]) for x in at])], names=["bucket", "chunk", "keys"])


def _parcels(source: Iterator[pa.RecordBatch], key: list[str], lists: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    """Rows of a word or pair by bucket: keys in order, as steps, and each list of columns one column after the other."""

    def parcel(rows: pa.Table) -> pa.RecordBatch:
        of = [rows[x].to_numpy().view(np.uint64) for x in key]
        keys = of[0] if len(of) == 1 else _key(*of)
        order = np.argsort(keys)
        keys = keys[order]
        bucket, at = _cuts(keys)
        values = {name: np.stack([rows[x].to_numpy()[order] for x in columns]) for name, columns in lists.items()}
        return pa.record_batch([bucket, _binary([_steps(keys[x]) for x in at]), *[_binary([_split(v[:, x].ravel()) for x in at]) for v in values.values()]], names=["bucket", "keys", *lists])

    held: list[pa.RecordBatch] = []
    for batch in source:
        held.append(batch)
        if sum(x.num_rows for x in held) >= PARCEL:
            yield parcel(pa.Table.from_batches(held))
            held = []
    if sum(x.num_rows for x in held):
        yield parcel(pa.Table.from_batches(held))


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held = TaskContext.get().partitionId() << 32, 0
    docs, hashes, sizes, learn = [], [], [], []
    for batch in T.batches(source, "text", 1 << 22):
        h, per_row = T.hash_words(batch.column("text"), T.SPACED)
        docs.append(batch.column("doc"))
        hashes.append(h)
        sizes.append(per_row)
        learn.append(batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64))
        held += len(h) + len(per_row)
        if held >= CHUNK:
            yield _chunk(docs, hashes, sizes, learn, number)
            docs, hashes, sizes, learn, held, number = [], [], [], [], 0, number + 1
    if held:
        yield _chunk(docs, hashes, sizes, learn, number)


def _sweep(batch: pa.RecordBatch, totals: Totals, keep: bool, rng: np.random.Generator) -> pa.RecordBatch:
    """A sweep over whole words whose contexts fit one vector: all customers leave their tables and sit down anew, then the same in the parent."""
    ctx, sizes = _flat(batch.column("ctxs"))
    c, _ = _flat(batch.column("c"))
    nt, _ = _flat(batch.column("nt"))
    root = batch.column("root").to_numpy()
    psum, _ = _flat(batch.column("psum"))
    ctx = ctx.astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    parent = totals.parent(_group_sums(nt, sizes), root)
    if keep:
        psum = psum + totals.predict(ctx, c, nt, parent[row]).astype(np.float32)
    new = (totals.strength + totals.discount * totals.tables[ctx]) * parent[row]
    nt = draw_tables(c, new, totals.discount, rng)
    root = draw_tables(_group_sums(nt, sizes), np.full(len(sizes), totals.root_new()), totals.root_discount, rng)
    offs = _offsets(sizes)
    return pa.record_batch(
        [batch.column("w"), _lists(offs, ctx.astype(np.int16)), _lists(offs, c), _lists(offs, nt.astype(np.int32)), pa.array(root.astype(np.int32)), _lists(offs, psum)],
        names=batch.schema.names,
    )


def _between(x: float) -> float:
    return float(min(max(x, 0.05), 0.95))


def _seated(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``words`` with ``seats``, their customers in the parent, and ``tables``, those of the restaurant after the word."""
    of = pairs.select("w", F.col("nt").alias("_w"), F.lit(0).alias("_ctx")).unionAll(pairs.select("ctx", F.lit(0), "nt"))
    sums = of.groupBy("w").agg(F.sum("_w").alias("_w"), F.sum("_ctx").alias("_ctx"))
    more = lambda x: F.coalesce(F.col(x), F.lit(0))
    return words.join(sums.hint("shuffle_hash"), "w", "left").withColumns({"seats": F.col("once") + more("_w"), "tables": F.col("ctx_once") + more("_ctx")}).drop("_w", "_ctx")


def _totals(words: DataFrame, strength: float, root_strength: float, discounts: tuple[float, float]) -> Totals:
    """Five sums to the driver; no vector by context."""
    tokens, known, roots, seats = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("root"), F.sum("seats")).first()
    return Totals(np.zeros(0), np.zeros(0), tokens or 0, known or 0, roots or 0, *discounts, strength, root_strength, seats or 0)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, sweeps: int = 3, burn_in: int = 2, strength: float = 1.0, root_strength: float = 1.0, seed: int = 1
) -> DataFrame:
    """``(doc, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Tokens: runs of non-white-space (ASCII) with A-Z lower-cased, then one end
    token, also for empty and null texts.  ``learn``: which rows are learnt
    from (all by default; null counts as no).  ``base_score``: log10 of the
    add-one unigram probability; ``score``: log10 of the averaged predictive
    probability, so perplexity is ``10 ** (-score / n_tokens)``.  States after
    ``burn_in`` of ``sweeps`` sweeps are averaged.  Each sweep reseats every
    customer of every (word, context), given the totals of every context and the
    parent of the sweep before (``draw_tables``).  Discounts come from the counts
    of counts.  Rows and ids may repeat or be null; other
    columns are not read; an empty table gives an empty result.
    """
    ok = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), ok.alias("learn"))
    kind = src.schema["doc"].dataType.simpleString()
    texts = stage(src.mapInArrow(_chunks, f"chunk long, docs array<{kind}>, sizes array<int>, learn binary, words binary, numbers binary"), "lm-chunks")
    asked = texts.drop("docs").mapInArrow(_ask, "bucket int, chunk long, keys binary, n binary")
    counted = stage(asked.groupBy("bucket").applyInArrow(_count, "bucket int, chunk long, c binary, own binary, places binary"), "lm-counts")
    drop_shuffles(docs.sparkSession)
    told = "bucket int, keys binary, n binary, once binary, ctx_once binary, w long, ctx long, c long"
    report = stage(texts.groupBy("chunk").cogroup(counted.select("chunk", "bucket", "c", "own").groupBy("chunk")).applyInArrow(_report, told), "lm-report")
    sums = report.where("w IS NULL").select("bucket", "keys", "n", "once", "ctx_once").groupBy("bucket").applyInArrow(_sum_words, "w long, c long, once long, ctx_once long")
    pairs, written = report.where("w IS NOT NULL").select("w", "ctx", "c", F.lit(1).alias("nt")), report
    words = stage(_seated(sums, pairs).withColumn("root", F.least("seats", F.lit(1)).cast("long")), "lm-words")
    drop_shuffles(docs.sparkSession)
    # discounts: n1 / (n1 + 2 n2), of pairs, and of words by their contexts; every pair is at one table yet
    n1, m1, m2 = (x or 0 for x in words.agg(F.sum("once"), F.count_if(F.col("seats") == 1), F.count_if(F.col("seats") == 2)).first())
    n2 = pairs.where("c = 2").count()
    discounts = _between(n1 / max(n1 + 2 * n2, 1)), _between(m1 / max(m1 + 2 * m2, 1))
    totals = _totals(words, strength, root_strength, discounts)

    def parent(now: Totals) -> Column:
        return (F.col("seats") - now.root_discount * F.col("root") + now.root_new()) / (now.root_strength + now.all_tables)

    kept: list[str] = []
    for s in range(sweeps):
        now, number = totals, s
        old_words, old_pairs = words, written
        if s >= burn_in:
            kept = [*kept, str(s)]
            words = words.withColumns({f"tables{s}": F.col("tables"), f"parent{s}": parent(now)})
            pairs = pairs.withColumn(f"nt{s}", F.col("nt"))
        columns = ["w", "ctx", "c", *(f"nt{k}" for k in kept)]

        def reseat(source: Iterator[pa.RecordBatch], now=now, number=number, columns=columns) -> Iterator[pa.RecordBatch]:
            salt = T.mix(np.array([(seed << 20) + number], np.uint64))
            for batch in source:
                w, ctx, c, back, up = (batch.column(x).to_numpy() for x in ("w", "ctx", "c", "tables", "parent"))
                chance = (T.mix(_key(ctx.view(np.uint64), w.view(np.uint64)) ^ salt) >> np.uint64(11)) * 2.0**-53
                nt = draw_tables(c, (now.strength + now.discount * back) * up, now.discount, chance)
                yield pa.record_batch([*(batch.column(x) for x in columns), pa.array(nt.astype(np.int32))], names=[*columns, "nt"])

        def root(source: Iterator[pa.RecordBatch], now=now, number=number) -> Iterator[pa.RecordBatch]:
            salt = T.mix(np.array([(seed << 20) + number], np.uint64))
            for batch in source:
                chance = (T.mix(batch.column("w").to_numpy().view(np.uint64) ^ salt) >> np.uint64(11)) * 2.0**-53
                seats = batch.column("seats").to_numpy()
                new = draw_tables(seats, np.full(len(seats), now.root_new()), now.root_discount, chance)
                yield batch.set_column(batch.schema.get_field_index("root"), "root", pa.array(new))

        up, back = words.select("w", parent(now).alias("parent")), words.select(F.col("w").alias("ctx"), "tables")
        joined = pairs.drop("nt").join(up.hint("shuffle_hash"), "w").join(back.hint("shuffle_hash"), "ctx")
        pairs = written = stage(joined.mapInArrow(reseat, pairs.select(*columns, "nt").schema), "lm-pairs")
        moved = _seated(words.drop("seats", "tables"), pairs)
        words = stage(moved.mapInArrow(root, moved.schema), "lm-words")
        drop(old_pairs)
        drop(old_words)
        totals = _totals(words, strength, root_strength, discounts)
    last, samples = totals, len(kept) + 1
    model = words.select("w", "c", *(f"tables{k}" for k in kept), "tables", *(f"parent{k}" for k in kept), parent(last).alias("parent"))
    of = lambda x: [*(f"{x}{k}" for k in kept), x]

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each chunk the tables of its pairs counted twice or more, sample by sample."""
        order = np.argsort(np.concatenate([np.zeros(0, np.uint64), *_keys(right)]))
        drawn = _samples(right, "nt", "<u4", samples)[:, order]
        nt = [_small(drawn[:, _unsplit(x.as_buffer(), "<u4")].ravel()) for x in left["places"]]
        return pa.table({"chunk": left["chunk"], "bucket": left["bucket"], "c": left["c"], "nt": _binary(nt)})

    def tell_words(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each chunk the counts of its words, and sample by sample the tables after them and their weights in the parent."""
        keys = np.concatenate([np.zeros(0, np.uint64), *_keys(right)])
        order = np.argsort(keys)
        at = [order[np.searchsorted(keys, x, sorter=order)] for x in _keys(left)]
        table = {"chunk": left["chunk"], "bucket": left["bucket"]}
        for name, kind, rows in (("count", "<i8", 1), ("tables", "<i8", samples), ("parent", "<f8", samples)):
            values = _samples(right, name, kind, rows)
            table[name] = _binary([_split(values[:, x].ravel()) for x in at])
        return pa.table(table)

    by_key = pairs.mapInArrow(lambda x: _parcels(x, ["ctx", "w"], {"nt": of("nt")}), "bucket int, keys binary, nt binary")
    by_word = model.mapInArrow(lambda x: _parcels(x, ["w"], {"count": ["c"], "tables": of("tables"), "parent": of("parent")}), "bucket int, keys binary, count binary, tables binary, parent binary")
    of_pairs = counted.select("bucket", "chunk", "c", "places").groupBy("bucket").cogroup(by_key.groupBy("bucket")).applyInArrow(tell, "chunk long, bucket int, c binary, nt binary")
    asked_words = texts.select("chunk", "words").mapInArrow(_ask_words, "bucket int, chunk long, keys binary")
    of_words = asked_words.groupBy("bucket").cogroup(by_word.groupBy("bucket")).applyInArrow(tell_words, "chunk long, bucket int, count binary, tables binary, parent binary")
    told = of_pairs.unionByName(of_words, allowMissingColumns=True)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        text, right = _Texts(left), right.sort_by("bucket")
        order = np.argsort(text.word)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        count, tables, up = (_samples(right, name, kind, rows)[:, back] for name, kind, rows in (("count", "<i8", 1), ("tables", "<i8", samples), ("parent", "<f8", samples)))
        count, c, drawn = count[0], _column(right, "c").astype(np.int64), _samples(right, "nt", "<u4", samples)
        p = np.zeros(len(c))
        for s in range(samples):
            here = Totals(count, tables[s], last.tokens, last.words, last.root_tables, last.discount, last.root_discount, strength, root_strength)
            nt = c.copy()
            nt[c > 1] = drawn[s]
            for a in range(0, len(p), BLOCK):
                some = slice(a, a + BLOCK)
                p[some] += here.predict(text.ctx[some], c[some], nt[some], up[s][text.w[some]])
        total = lambda x: np.add.reduceat(x, text.begin)
        base = np.log10((count + 1) / (last.tokens + last.words + 1))
        return pa.table(
            {
                "doc": left["docs"].combine_chunks().flatten(),
                "n_tokens": text.size,
                "n_known": total((count > 0).astype(np.int64)[text.tokens]),
                "train_tokens": np.full(len(text.size), last.tokens),
                "base_score": total(base[text.tokens]),
                "score": total(np.log10(p / samples)[text.of]),
            }
        )

    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(add_up, f"doc {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
