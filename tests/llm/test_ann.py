import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffcorpus.llm.hilbert_ann import hilbert_keys, nearest
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(rows, asks, k=5):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if asks(i):
            near = sorted((-np.dot(v, w) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(w, w)), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def told(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_recall(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = told(QUERIES["op3_nearest"](spark, SF)), brute(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want]) >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        for j, s in found:
            a, b = np.array(exact[q]), np.array(exact[j])
            assert abs(s - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 400, 2)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 200, 2)]
    rows += [(2, [1.0, 2.0, 0.5]), (1000, None), (1001, []), (1002, [0.0, 0.0, 0.0]), (1003, [1.0, None, 2.0]), (1004, [math.nan, 1.0, 1.0]), (1005, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1006, [1.0, 1.0]), (1050, [-1.0, -2.0, -0.5])]
    df = spark.createDataFrame([(i, v, 7, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, cid int, h int, q string")
    got = told(nearest(df, F.col("vec_id") % 50 == 0))
    want = brute([(i, v) for i, v in rows if not v or len(v) == 3], lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    ask = F.col("vec_id") % 50 == 0
    assert nearest(spark.createDataFrame([], schema), ask).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0])], schema), ask).count() == 0
    assert nearest(spark.createDataFrame([(50, [1.0, 0.0])], schema), ask).count() == 0
    got = nearest(spark.createDataFrame([(50, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [3.0, 3.0])], schema), ask).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4), (2, 3)]


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
