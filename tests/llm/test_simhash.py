import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from diffcorpus.llm import simhash
from diffcorpus.llm.components import connected_components
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text, n=3):
    ws = (text or "").encode().lower().split()
    parts = [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """Smallest id reachable over links of two bits or fewer, per row."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, "%016x" % f, least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def told(df):
    return sorted(((r.doc, "%016x" % (r.fp % (1 << 64)), r.component) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert told(simhash.simhash_components(odd)) == brute(rows)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6, 7, 8, None}


@pytest.mark.parametrize("max_bits,blocks", [(1, 4), (2, 6), (3, 6)])
def test_pairs_equal_brute_force(spark, max_bits, blocks):
    rng = random.Random(max_bits)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randint(0, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    got = sorted((r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits, blocks).collect())
    want = sorted((a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits)
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none).count() == 0


def test_masks_cover_close_pairs():
    masks = [m % (1 << 64) for m in simhash.block_masks(2, 6)]
    rng = np.random.default_rng(1)
    for _ in range(300):
        i, j = rng.integers(0, 64, 2)
        assert any(not ((1 << int(i)) | (1 << int(j))) & m for m in masks)


def test_a_large_group_of_copies_is_one_representative(spark, docs):
    df = docs([(i, "the same text over and over") for i in range(300)] + [(900, "quite another text it is")])
    out = simhash.simhash_components(df)
    assert out.groupBy("component").count().orderBy("component").collect() == [(0, 300), (900, 1)]
    assert simhash.keep_first(df).select(F.collect_set("doc_id")).first()[0] in ([0, 900], [900, 0])


def test_crowded_fingerprints_are_dealt_to_many_tasks(spark, docs):
    """A third of all rows are copies of one text: the join that names them cuts their rows into pieces and loses none."""
    rows = [(i, "one text that very many documents share" if i % 3 == 0 else f"text number {i} of its own, {i * i} words {i + 7} apart") for i in range(3000)]
    marked = simhash.fingerprints(docs(rows))
    classes = marked.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("rows"))
    named = classes.select("fp", F.col("least").alias("component"))
    joined = simhash._spread_join(marked, named, classes)
    hot = classes.orderBy(F.desc("rows")).first()
    assert hot.rows >= 1000
    pieces = {r.piece: r["count"] for r in joined.where(F.col("fp") == hot.fp).groupBy("piece").count().collect()}
    assert len(pieces) > 200 and max(pieces.values()) < 20 and sum(pieces.values()) == hot.rows
    got = sorted((r.doc, r.fp, r.component) for r in joined.collect())
    assert got == sorted((r.doc, r.fp, r.component) for r in marked.join(named, "fp").collect()) and len(got) == len(rows)
