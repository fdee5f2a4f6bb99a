"""Spelling variants: words one edit apart, grouped under the much more frequent one.

Near words are found with a bidirectional FM-index over a delimited vocabulary
``$word$word$``: two suffix orders, of the text and of its mirror image, whose
row intervals stay in step, so that a match grows to either side.  A search
scheme of two parts covers one error: the first half matched exactly and the
second crossed with one error, or the second exactly and the first crossed.

Spark deals the vocabulary to shards by its halves, so that a word and all
words that share a half with it meet in one index of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fmindex import suffix_order
from .stages import stage

#: Words have at least this many code points, and this many occurrences.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: Words in one index, about; a half that more words share is dealt over several.
SHARD_WORDS = 1 << 14
#: Queries searched together.
QUERIES_AT_ONCE = 1 << 13

_RUN = "([A-Za-zÀ-ÿ]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the index -------------------------------------------------------------------

_DELIMITER = 1
#: Codes of a-z and U+00C0 to U+00FF, in code point order after the end (0) and the delimiter (1).
_CODES = np.zeros(256, dtype=np.int64)
_CODES[0x61:0x7B] = 2 + np.arange(26)
_CODES[0xC0:] = 28 + np.arange(64)
N_CODES = 92


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words one after the other, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return _CODES[points], np.array([len(w) for w in words], dtype=np.int64)


class _Side:
    """Suffix order of one direction: the wavelet levels of its transform."""

    def __init__(self, codes: np.ndarray):
        self.rows = suffix_order(codes)
        bwt = codes[self.rows - 1]
        counts = np.bincount(codes, minlength=N_CODES)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(int(N_CODES - 1).bit_length() - 1, -1, -1):
            ones = (bwt >> bit) & 1 == 1
            count = np.zeros(len(bwt) + 1, dtype=np.int64)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(bwt) - int(count[-1])))
            bwt = np.concatenate((bwt[~ones], bwt[ones]))
        # where the places of each code begin after the last level
        self.base = np.searchsorted(self._ranked(bwt), self._ranked(np.arange(N_CODES)))

    @staticmethod
    def _ranked(code: np.ndarray) -> np.ndarray:
        """The order in which the levels leave the codes: by their bits, lowest bit first."""
        out = np.zeros(len(code), dtype=np.int64)
        for bit in range(int(N_CODES - 1).bit_length()):
            out = out * 2 + ((code >> bit) & 1)
        return out

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the matches extended by ``code``, and how many extensions by a smaller code there are."""
        less = np.zeros(len(lo), dtype=np.int64)
        for bit, count, zeros in self.levels:
            one = (code >> bit) & 1 == 1
            lo1, hi1 = count[lo], count[hi]
            less += np.where(one, (hi - hi1) - (lo - lo1), 0)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        move = self.below[code] - self.base[code]
        return lo + move, hi + move, less

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of each match: (match, code, lo, hi, extensions by a smaller code)."""
        match = np.arange(len(lo))
        code, less = np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        for bit, count, zeros in self.levels:
            lo1, hi1 = count[lo], count[hi]
            lo0, hi0 = lo - lo1, hi - hi1
            a, b = np.flatnonzero(hi0 > lo0), np.flatnonzero(hi1 > lo1)
            less = np.concatenate((less[a], less[b] + (hi0 - lo0)[b]))
            match, code = np.concatenate((match[a], match[b])), np.concatenate((code[a], code[b] | (1 << bit)))
            lo, hi = np.concatenate((lo0[a], zeros + lo1[b])), np.concatenate((hi0[a], zeros + hi1[b]))
        move = self.below[code] - self.base[code]
        return match, code, lo + move, hi + move, less


class VocabularyIndex:
    """Bidirectional index over distinct words; ``near`` finds the words one edit away."""

    def __init__(self, words: list[str]):
        codes, lengths = encode(words)
        text = np.full(len(codes) + len(words) + 2, _DELIMITER, dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the delimiters
        text[np.arange(len(codes)) + 1 + np.repeat(np.arange(len(words)), lengths)] = codes
        text[-1] = 0
        self.text, self.size = text, len(text)
        self.forward = _Side(text)
        self.mirror = _Side(np.concatenate((text[-2::-1], [0])))

    def near(self, queries: list[str], exact: str = "ps") -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs exactly one inserted, deleted or replaced code point apart, each once.

        ``exact``: the halves to match exactly.  "p", the first half, finds
        the words that begin with it; "s", the second, the other words.
        Queries have two code points at least.
        """
        found = [self._some(queries[i : i + QUERIES_AT_ONCE], i, exact) for i in range(0, len(queries), QUERIES_AT_ONCE)]
        return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])

    def _some(self, queries: list[str], first: int, exact: str) -> tuple[np.ndarray, np.ndarray]:
        codes, lengths = encode(queries)
        width = int(lengths.max()) + 1
        grid = np.full((len(queries), width), _DELIMITER, dtype=np.int64)
        grid[np.repeat(np.arange(len(queries)), lengths), np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes
        half = lengths // 2
        place = np.arange(width)
        # both halves in the order in which a match grows, delimiters at their ends
        back = np.where(place < half[:, None], np.take_along_axis(grid, np.clip(half[:, None] - 1 - place, 0, None), 1), _DELIMITER)
        ahead = np.where(place + half[:, None] < lengths[:, None], np.take_along_axis(grid, np.minimum(half[:, None] + place, width - 1), 1), _DELIMITER)
        q, w = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if "p" in exact:
            q, w = self._scheme(back, half + 1, self.forward, ahead, lengths - half + 1, self.mirror, forward_first=True)
        if "s" in exact:
            q2, w2 = self._scheme(ahead, lengths - half + 1, self.mirror, back, half + 1, self.forward, forward_first=False)
            new = ~self._begins(w2, grid[q2], half[q2])
            q, w = np.concatenate((q, q2[new])), np.concatenate((w, w2[new]))
        return q + first, w

    def _begins(self, word: np.ndarray, grid: np.ndarray, half: np.ndarray) -> np.ndarray:
        out = np.ones(len(word), dtype=bool)
        for k in range(int(half.max(initial=0))):
            inside = k < half
            at = np.minimum(self.starts[word] + 1 + k, self.size - 1)
            out &= ~inside | (self.text[at] == grid[:, k])
        return out

    def _scheme(self, exact, exact_size, side, rest, rest_size, other, forward_first):
        """Match ``exact`` growing on ``side``, then cross ``rest`` on the other side with one error exactly."""
        n = len(exact)
        query = np.arange(n)
        at, across, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        for k in range(int(exact_size.max(initial=0))):
            go = np.flatnonzero((k < exact_size[query]) & (size > 0))
            lo, hi, less = side.step(exact[query[go], k], at[go], at[go] + size[go])
            at[go], across[go], size[go] = lo, across[go] + less, hi - lo
        alive = size > 0
        query, at, across, size = query[alive], at[alive], across[alive], size[alive]

        # without an error so far; a branch for every way to make one
        made: list[tuple[np.ndarray, ...]] = []
        for k in range(int(rest_size.max(initial=0))):
            here = k < rest_size[query]
            query, at, across, size = query[here], at[here], across[here], size[here]
            if not len(query):
                break
            want, inner = rest[query, k], k + 1 < rest_size[query]
            match, code, lo, hi, less = other.symbols(across, across + size)
            q, a, s = query[match], at[match] + less, hi - lo
            same = code == want[match]
            letter = ~same & (code > _DELIMITER)
            made.append((q[letter], a[letter], lo[letter], s[letter], np.full(int(letter.sum()), k)))  # inserted
            swap = letter & inner[match]
            made.append((q[swap], a[swap], lo[swap], s[swap], np.full(int(swap.sum()), k + 1)))  # replaced
            # of equal code points in a row the last one is deleted
            gone = inner & (rest[query, np.minimum(k + 1, rest.shape[1] - 1)] != want)
            made.append((query[gone], at[gone], across[gone], size[gone], np.full(int(gone.sum()), k + 1)))
            query, at, across, size = q[same], a[same], lo[same], s[same]
        if not made:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, at, across, size, k = (np.concatenate(part) for part in zip(*made))

        # the one error is made: the rest matches exactly
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            lo, hi, less = other.step(rest[query, k], across, across + size)
            at, across, size, k = at + less, lo, hi - lo, k + 1
            alive = size > 0
            query, at, across, size, k = query[alive], at[alive], across[alive], size[alive], k[alive]
            end = k == rest_size[query]
            if end.any():
                done.append((query[end], (at if forward_first else across)[end]))
                query, at, across, size, k = query[~end], at[~end], across[~end], size[~end], k[~end]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row = (np.concatenate(part) for part in zip(*done))
        return query, np.searchsorted(self.starts, self.forward.rows[row])


# --- the vocabulary, in Spark ----------------------------------------------------


def misspelt(doc: Column, word: Column, every: int = 199) -> Column:
    """``word``, short of one code point where ``every`` divides the crc32 of ``<doc>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word))
    k = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int | None = None) -> DataFrame:
    """``(word, n)``: words of whole texts, A-Z lower-cased, with their occurrences.

    ``dropped`` plants variants: see ``misspelt``; a null id counts as empty
    there.  Null and empty texts have no words; other columns are not read.
    Occurrences are counted in the tasks before words are shuffled.
    """
    pattern = _RUN.replace("+", f"{{{least_length},}}")  # a shorter run gives no word: nothing makes it longer
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern))).alias("run"))
    runs = runs.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    word = misspelt(F.col("doc"), F.col("run"), dropped) if dropped else F.col("run")
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _entries(vocab: DataFrame) -> DataFrame:
    """``(kind, half, role, word, n)``: a word is asked for with its own halves, and stands below those that a near word can have."""
    size = F.length("word")

    def first(h: Column) -> Column:
        return F.struct(F.lit("p").alias("kind"), F.left("word", h).alias("half"))

    def last(h: Column) -> Column:
        return F.struct(F.lit("s").alias("kind"), F.right("word", h).alias("half"))

    def half(n: Column) -> Column:
        return F.floor(n / 2).cast("int")

    firsts = F.array_distinct(F.array(*[half(size + d) for d in (-1, 0, 1)]))
    lasts = F.array_distinct(F.array(*[size + d - half(size + d) for d in (-1, 0, 1)]))
    stands = F.concat(F.transform(firsts, first), F.transform(lasts, last))
    asked = F.array(first(half(size)), last(size - half(size)))
    both = F.concat(F.transform(stands, lambda e: F.struct(e["kind"], e["half"], F.lit(0).alias("role"))), F.transform(asked, lambda e: F.struct(e["kind"], e["half"], F.lit(1).alias("role"))))
    return vocab.select(F.explode(both).alias("e"), "word", "n").select("e.*", "word", "n")


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(part: pa.Table) -> pa.Table:
    """Near words of the queries of one shard (role 1) among its words (role 0), counted, with the most frequent one."""
    kind = part["unit"][0].as_py()[0]
    role, word, n = part["role"].to_numpy(), part["word"].to_pylist(), part["n"].to_numpy()
    stands = {word[i]: n[i] for i in np.flatnonzero(role == 0)}
    words, queries = sorted(stands), [word[i] for i in np.flatnonzero(role == 1)]
    if not words or not queries:
        return _FOUND.empty_table()
    counts = np.array([stands[w] for w in words], dtype=np.int64)
    q, w = VocabularyIndex(words).near(queries, exact=kind)
    order = np.lexsort((w, -counts[w], q))  # words are in code point order
    q, w = q[order], w[order]
    firsts = np.flatnonzero(np.diff(q, prepend=-1))
    near = np.diff(np.append(firsts, len(q)))
    return pa.table([[queries[i] for i in q[firsts]], near, counts[w[firsts]], [words[i] for i in w[firsts]]], schema=_FOUND)


def near_words(vocab: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n_near, best_n, best)`` of words with near words: how many, and the most frequent one (ties: the smallest).

    ``vocab``: a written table of distinct words (2 code points or more of
    a-z and U+00C0 to U+00FF) with counts.  Halves are dealt by hash to
    shards of about ``shard_words`` words.  The words below one half that
    more of them share are split into blocks, its queries too, and every
    block of the one meets every block of the other.
    """
    n_shards = max(1, -(-2 * vocab.count() // shard_words))
    entries = _entries(vocab)
    # at most 4 * words / shard_words rows: no half with fewer words is listed
    crowded = stage(entries.where("role = 0").groupBy("kind", "half").count().where(F.col("count") > shard_words), "crowded-halves")
    blocks = crowded.select("kind", "half", F.ceil(F.col("count") / shard_words).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("word"), F.col("k")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.when(F.col("role") == 0, F.concat_ws(".", mine, o)).otherwise(F.concat_ws(".", o, mine)))
    shard = F.concat(F.col("kind"), F.pmod(F.xxhash64("half"), F.lit(n_shards)).cast("string"))
    units = F.when(F.col("k").isNull(), F.array(shard)).otherwise(F.transform(cells, lambda c: F.concat_ws("/", "kind", "half", c)))
    dealt = entries.join(blocks, ["kind", "half"], "left").select(F.explode(units).alias("unit"), "role", "word", "n")
    parts = dealt.groupBy("unit").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variants(vocab: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``vocab``, a written table.

    The form is the most frequent near word when it is ``ratio`` times as
    frequent as the word, or more; the root is the last form on the way.
    Forms grow in frequency by ``ratio`` (above 1), so the way ends after a
    logarithmic number of rounds.  A round joins words with forms settled in
    the round before; a word has few neighbours, so no key is hot.
    """
    near = near_words(vocab, shard_words)
    formed = F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False))
    named = vocab.join(near, "word", "left").select(
        "word",
        F.when(formed, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    )
    named = stage(named, "forms")
    settled = named.where("form IS NULL").select("word", F.col("word").alias("root"))
    rounds, open_ = [settled], named.where("form IS NOT NULL").select("word", "form")
    while not open_.isEmpty():
        latest = settled.select(F.col("word").alias("form"), "root")
        both = stage(open_.join(latest, "form", "left").select("word", "form", "root"), "roots")
        settled = both.where("root IS NOT NULL").select("word", "root")
        open_ = both.where("root IS NULL").select("word", "form")
        rounds.append(settled)
    roots = rounds[0]
    for more in rounds[1:]:
        roots = roots.unionByName(more)
    return named.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dropped: int | None = None) -> DataFrame:
    """Vocabulary of ``docs``, written once, and its ``variants``.  An empty table has none."""
    return variants(stage(vocabulary(docs, id_col, text, dropped=dropped), "vocabulary"))
