import random
import re
import zlib
from collections import Counter

import pytest

from diffcorpus.llm import spelling
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def near(a, b):
    """Exactly one edit apart, by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def brute(vocab):
    """Rows of the answer: neighbours by one-gap patterns of every word, checked edit by edit."""
    gaps = {}
    for w in vocab:
        for i in range(len(w)):
            gaps.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
            gaps.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        gaps.setdefault(w, set()).add(w)
    around = {w: set() for w in vocab}
    for group in gaps.values():
        for a in group:
            around[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(around[w]), vocab[form[w]] if form[w] else None))
    return out


def answer(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "aàÿz", "abcdefgh"])
def test_index_finds_every_near_word_once(alphabet):
    rng = random.Random(alphabet)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(300)})
    asked = rng.sample(words, len(words) // 2) + ["".join(rng.choices(alphabet, k=7)) for _ in range(40)]
    q, w = spelling.VocabularyIndex(words).near(asked)
    assert sorted(zip(q.tolist(), w.tolist())) == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(words_of(rows))
    assert any(f for _, f, *_ in want) and len(want) > 500
    assert answer(QUERIES["op13_spelling_variants"](spark, SF)) == want


@pytest.mark.parametrize("shard_words", [8, 1 << 14])
def test_crowded_halves_and_chains(spark, shard_words):
    """Blocks of a half that many words share give the same pairs; forms lead over several steps."""
    rng = random.Random(7)
    vocab = {"abc" + "".join(rng.choices("abc", k=rng.randint(3, 5))): rng.choice([5, 6, 30, 200, 5000]) for _ in range(150)}
    vocab |= {"".join(rng.choices("ab", k=rng.randint(3, 5))) + "cab": 7 for _ in range(30)}
    vocab |= {"kettle" + "x" * i: 5**(i + 1) for i in range(6)}
    df = spelling.stage(spark.createDataFrame(list(vocab.items()), "word string, n long"), "vocab")
    got = answer(spelling.variants(df, shard_words=shard_words))
    assert got == brute(vocab)
    assert ("kettle", "kettlex", "kettlexxxxx", 5, 1, 25) in got


def test_odd_rows(spark, odd, empty):
    assert spelling.group(empty).count() == 0
    got = answer(spelling.group(odd, dropped=199))
    assert got == brute(words_of([(r.doc_id, r.text) for r in odd.collect()]))
    assert {r[0] for r in got} >= {"passage"}
    # only A-Z become small, and a letter outside the range ends a run
    one = spark.createDataFrame([(1, "Schröder SCHRÖDER schröder " * 5 + "œuvres " * 9 + "worłdly " * 9 + "worłdlyish " * 5), (2, None)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.vocabulary(one).collect()} == {"schröder": 10, "schrÖder": 5, "dlyish": 5}
