import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from diffcorpus.llm import pitman_yor
from diffcorpus.llm.queries import QUERIES
from diffcorpus.llm.seating import Seating

SF = "/root/testdata/sf0.001"


def base_scores(rows, learn):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    seen = collections.Counter(w for (d, ws), ok in zip(tokens, learn) if ok for w in ws)
    n, v = sum(seen.values()), len(seen)
    return [(d, len(ws), sum(seen[w] > 0 for w in ws), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens]


def close(got, want):
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6


def test_query_base_and_held_out_perplexity(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op7_lm_scoring"](spark, SF).collect()
    close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], base_scores(rows, [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]))
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in out)


def test_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = pitman_yor.score(odd, learn=F.col("doc_id") != 6).collect()
    close([(r.doc, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], base_scores(rows, [d is not None and d != 6 for d, _ in rows]))
    assert pitman_yor.score(empty).count() == 0
    nothing = pitman_yor.score(odd, learn=F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-6 for r in nothing)


def test_a_word_in_most_chunks_and_wide_counts(docs, monkeypatch):
    text = "the " * 700 + "end"
    df = docs([(i, f"{text} w{i}") for i in range(40)])
    whole = {r.doc: (r.n_tokens, r.n_known, r.base_score) for r in pitman_yor.score(df).collect()}
    monkeypatch.setattr(pitman_yor, "CHUNK", 500)
    cut = {r.doc: (r.n_tokens, r.n_known, r.base_score) for r in pitman_yor.score(df).collect()}
    assert whole == cut and len(whole) == 40


def test_predictions_sum_to_one():
    """Over all known words and the unknown one, in any context, known or not."""
    rng = np.random.default_rng(0)
    words, contexts = 50, pitman_yor.CONTEXTS + 1
    c = np.zeros((words, 4), np.int64)
    c[rng.integers(0, words, 300), rng.integers(0, 4, 300)] += rng.integers(1, 6, 300)
    c = c[c.sum(axis=1) > 0]
    nt = np.minimum(c, rng.integers(1, 3, c.shape))
    root_tables = np.maximum(1, nt.sum(axis=1) // 2)
    customers, tables = np.zeros(contexts), np.zeros(contexts)
    customers[:4], tables[:4] = c.sum(axis=0), nt.sum(axis=0)
    totals = pitman_yor.Totals(customers, tables, int(c.sum()), len(c), int(root_tables.sum()), 0.6, 0.7, 1.0, 2.0)
    parent = totals.parent(nt.sum(axis=1), root_tables)
    unknown = totals.parent(np.zeros(1), np.zeros(1))
    assert abs(parent.sum() + unknown.sum() - 1) < 1e-12
    for k in (0, 3, 9):
        have = c[:, k] if k < 4 else np.zeros(len(c))
        seats = nt[:, k] if k < 4 else np.zeros(len(c))
        at = np.full(len(c), k)
        total = totals.predict(at, have, seats, parent).sum() + totals.predict(at[:1], np.zeros(1), np.zeros(1), unknown).sum()
        assert abs(total - 1) < 1e-12


def test_seating_keeps_customers_and_follows_the_restaurant():
    rng = np.random.default_rng(5)
    groups = np.arange(4000)
    seating = Seating(np.ones(4000, np.int64), np.ones(4000, np.int64), 12)
    for _ in range(9):
        seating.add(groups, np.full(4000, 0.8), 0.3, rng)
    assert (seating.customers == 10).all() and seating.sizes().sum() == 40_000
    # expected tables of a restaurant with strength a = 0.8 - 0.3 t: by its own recursion
    dist = np.zeros(12)
    dist[1] = 1
    for n in range(1, 10):
        t = np.arange(12)
        new = 0.8 / (0.8 + n - 0.3 * t)
        dist = dist * (1 - new) + np.roll(dist * new, 1)
    assert abs(seating.tables.mean() - (dist * np.arange(12)).sum()) < 0.05
    for _ in range(10):
        seating.remove(groups, rng)
    assert not seating.seats.any() and not seating.tables.any()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 6, 500)
    ctx, n = rng.integers(0, 1025, sizes.sum()), rng.choice([0, 1, 200, 255, 256, 70_000, 2_000_000], sizes.sum())
    a, b, c = pitman_yor._unpack(pitman_yor._pack(ctx, n, sizes))
    assert (a == ctx).all() and (b == n).all() and (c == sizes).all()
    assert (pitman_yor._unsqueeze(pitman_yor._squeeze(n.astype(np.int32)), len(n)) == n).all()
