import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diffcorpus.llm import decontaminate
from diffcorpus.llm.fmindex import FMIndex, suffix_order
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    places = {}
    for item, text in items:
        ws = words(text)
        if item is not None and ws:
            for k in range(max(1, len(ws) - window + 1)):
                places.setdefault(tuple(ws[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for size in {len(w) for w in places}:
            for k in range(len(ws) - size + 1):
                if items := places.get(tuple(ws[k : k + size])):
                    found |= items
                    hit |= set(range(k, k + size))
        out.append((doc, len(ws), len(hit), sorted(found)))
    return out


def test_query_equals_brute_force(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_odd_rows_short_items_and_removal(spark, odd, empty, docs):
    items = [(1, "Gamma, DELTA"), (2, "word3 passage3 word4 passage4 word5 Passage5 word6 Passage6 word7 Passage7 word8"), (2, "one"), (None, "alpha beta"), (3, None), (4, "..."), (5, "日本 😀")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted(((r.doc, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, bench).collect()), key=str)
    assert got == sorted(brute(rows, items), key=str)
    cut = decontaminate.remove_passages(odd, bench)
    assert cut.columns == odd.columns and decontaminate.contamination(cut, bench).where("n_hit > 0").count() == 0
    assert cut.where("doc_id = 1").select("text").first()[0] == "alpha beta "
    assert cut.where("doc_id IS NULL").count() == 2
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0 OR size(items) > 0").count() == 0


def test_blocks_of_items_and_pieces_of_rows(spark, docs, monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(400))
    df, bench = docs([(1, text), (2, "w1 w2 w3")]), spark.createDataFrame([(i, " ".join(f"w{(i + k) % 50}" for k in range(12))) for i in range(20)], "item_id long, text string")
    want = decontaminate.contamination(df, bench).orderBy("doc").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert decontaminate.contamination(df, bench).orderBy("doc").collect() == want
    assert len(decontaminate._phrase_files(bench, "item_id", "text", 10)) > 4
    hashes = np.array([hash(w) % (1 << 63) for w in text.split()], dtype=np.uint64)
    items = [("a", hashes[5:17]), ("b", hashes[45:52])]
    block = decontaminate.phrase_block(items, 10)
    whole = decontaminate.search_rows(hashes, np.array([400]), block)
    small = decontaminate.search_rows(hashes, np.array([400]), block, shard_words=37)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all() and whole[0].any()


def test_long_items_come_in_pieces(spark, docs, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    df = docs([(1, " ".join(words[38:61])), (2, " ".join(words)), (3, " ".join(words[7:16])), (4, "w1 w2"), (5, " ".join(words[290:]))])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2"), (3, ""), (4, " ".join(words[:10]))], "item_id long, text string")
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()], [tuple(r) for r in bench.collect()]))
    for size in (20, 33, 1 << 16):
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", size)
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3 * size)
        got = sorted((r.doc, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect())
        assert got == want and got[0][2] == 23 and got[2][2] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=8), st.sampled_from([1, 3, 8]))
def test_index_finds_every_place(codes, phrases, step):
    codes = np.array([*codes, 0], dtype=np.int32)
    index = FMIndex(codes, 4, step)
    table = np.zeros((len(phrases), 5), dtype=np.int64)
    for row, p in zip(table, phrases):
        row[: len(p)] = p
    lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(codes) - len(p) + 1) if list(codes[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_of_long_copies():
    codes = np.array([*([1, 2, 3, 1, 2] * 200), 0, *([1, 2, 3, 1, 2] * 200), 0], dtype=np.int32)
    sa = suffix_order(codes)
    ranked = codes.astype(np.int64) + 2
    ranked[codes == 0] = [0, 1]
    keys = [tuple(ranked[i:]) for i in range(len(codes))]
    assert sa.tolist() == sorted(range(len(codes)), key=keys.__getitem__)


@pytest.mark.parametrize("text", ["a" * 9, "a" * 8, "", "ab " * 5])
def test_hash_depends_on_bytes_only(text):
    import pyarrow as pa

    from diffcorpus.llm import textnum as T

    one, _ = T.hash_words(pa.array([text]), T.ALNUM)
    two, per = T.hash_words(pa.array(["zz " + text.upper() + " yy", None]), T.ALNUM)
    assert one.tolist() == two[1:-1].tolist() and per.tolist() == [len(text.split()) + 2, 0]
