"""Every word is a context of its own in the language model, however many there are."""

import collections
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from diffcorpus.llm import pitman_yor
from diffcorpus.llm import textnum as T


def same_bucket():
    """Two words whose hashes agree modulo 1,024."""
    words = [f"left{i}" for i in range(200)]
    h, _ = T.hash_words(pa.array(words), T.SPACED)
    seen = {}
    for word, k in zip(words, (h % np.uint64(1024)).tolist()):
        if k in seen:
            return seen[k], word
        seen[k] = word
    raise AssertionError


def brute(rows, learn, strength=1.0, root_strength=1.0):
    """Scores of the state where every pair sits at one table, with dictionaries."""
    texts = [(t or "").encode().lower().split() + [None] for _, t in rows]
    grams = [list(zip([None, *ws[:-1]], ws)) for ws in texts]
    c = collections.Counter(g for gs, ok in zip(grams, learn) if ok for g in gs)
    customers, tables, seats = collections.Counter(), collections.Counter(), collections.Counter()
    for (ctx, w), n in c.items():
        customers[ctx] += n
        tables[ctx] += 1
        seats[w] += 1
    between = lambda a, b: min(max(a / max(a + 2 * b, 1), 0.05), 0.95)
    often, spread = list(c.values()), list(seats.values())
    d, rd = between(often.count(1), often.count(2)), between(spread.count(1), spread.count(2))
    new = (root_strength + rd * len(seats)) / (len(seats) + 1)
    total = sum(seats.values())

    def p(ctx, w):
        up = (seats[w] - rd * (seats[w] > 0) + new) / (root_strength + total)
        n = c[ctx, w]
        return (n - d * (n > 0) + (strength + d * tables[ctx]) * up) / (strength + customers[ctx])

    return [sum(math.log10(p(*g)) for g in gs) for gs in grams]


def test_words_of_one_bucket_do_not_share_a_restaurant(docs):
    a, b = same_bucket()
    rows = [(i, f"{a} cat") for i in range(30)] + [(30 + i, f"{b} dog") for i in range(30)] + [(60, f"{a} dog")]
    got = {r.doc: r.score for r in pitman_yor.score(docs(rows), learn=F.col("doc_id") < 60).collect()}
    assert got[0] > got[60] + 0.5


def test_scores_equal_brute_force_over_many_chunks(docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.3, 40) % 3000)) for i in range(300)]
    rows += [*rows[:20], (900, None), (901, ""), (None, "w1 w2"), (902, "never seen w1")]
    learn = [d is not None and d % 7 != 2 for d, _ in rows]
    out = pitman_yor.score(docs(rows).repartition(7), learn=F.col("doc_id") % 7 != 2, sweeps=0).collect()
    want = sorted(zip((str(d) for d, _ in rows), brute(rows, learn)))
    got = sorted((str(r.doc), r.score) for r in out)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert max(abs(x - y) for (_, x), (_, y) in zip(got, want)) < 1e-9


def test_sweeps_do_not_depend_on_how_rows_are_dealt(docs):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k % 50}" for k in rng.zipf(1.5, 30))) for i in range(200)]
    one, many = ({r.doc: r.score for r in pitman_yor.score(docs(rows).repartition(n)).collect()} for n in (1, 5))
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9
