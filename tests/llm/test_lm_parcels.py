"""The language model's words and pairs travel by bucket, not as a row for every word of every chunk."""

import numpy as np
import pyarrow as pa
import pytest

from diffcorpus.llm import pitman_yor


@pytest.fixture()
def rows():
    rng = np.random.default_rng(8)
    return [(i, " ".join(f"w{k % 400}" for k in rng.zipf(1.3, 30))) for i in range(120)] + [(None, None), (7, "w1 w1"), (7, "w1 w1"), (900, "")]


def test_no_join_or_array_by_word_of_a_chunk(docs, rows):
    plan = pitman_yor.score(docs(rows).repartition(5))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "seen_tables" not in plan


def test_a_chunk_asks_for_its_words_by_bucket():
    words = [np.arange(1, 4001, dtype=np.uint64) << np.uint64(52), np.zeros(0, np.uint64)]
    chunk = pitman_yor._chunk([pa.array([1, 2])], words, [np.array([4000, 0])], [np.ones(2, np.int64)], 7)
    asked = pa.Table.from_batches(pitman_yor._ask_words(iter([chunk])))
    assert asked.num_rows <= pitman_yor.BUCKETS
    assert (np.concatenate(pitman_yor._keys(asked)) == np.unique(np.append(words[0], pitman_yor._END))).all()


@pytest.mark.parametrize("parcel", [1, 50, 1 << 20])
def test_parcels_hold_every_row(parcel, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PARCEL", parcel)
    rng = np.random.default_rng(2)
    w, ctx = (rng.integers(-(2**63), 2**63, 300, dtype=np.int64) for _ in range(2))
    nt, back = rng.integers(0, 2**32, 300), rng.random(300)
    source = [pa.record_batch([pa.array(x[a : a + 40]) for x in (w, ctx, nt, back)], names=["w", "ctx", "nt", "back"]) for a in range(0, 300, 40)]
    out = pa.Table.from_batches(pitman_yor._parcels(iter(source), ["ctx", "w"], {"one": ["nt"], "two": ["back", "back"]}))
    keys = np.concatenate(pitman_yor._keys(out))
    assert (np.repeat(out["bucket"].to_numpy(), [len(k) for k in pitman_yor._keys(out)]) == (keys >> pitman_yor._SHIFT).astype(int)).all()
    want = pitman_yor._key(ctx.view(np.uint64), w.view(np.uint64))
    order, there = np.argsort(keys), np.argsort(want)
    assert (keys[order] == want[there]).all()
    assert (pitman_yor._samples(out, "one", "<i8", 1)[0][order] == nt[there]).all()
    assert (pitman_yor._samples(out, "two", "<f8", 2)[:, order] == back[there]).all()


@pytest.mark.parametrize("below", [50, 1 << 40, 1 << 62])
def test_distinct_equals_numpy(below):
    """Numbers sorted with their places, and numbers too large for that."""
    x = np.random.default_rng(3).integers(0, below, 5000)
    x[100:200] = below - 1
    values, of = np.unique(x, return_inverse=True)
    got, at = pitman_yor._distinct(x.copy(), below)
    assert (got == values).all() and (at == of).all()
