import math
from fractions import Fraction

import numpy as np
import pytest

from diffcorpus.llm import whitening
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, doc string, at int, x long, _x long, deviation long, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, 5, 0.5) for i, v in rows], VECTORS)


def brute(rows, k):
    """{row number: (id, deviation, whitened)}, explained; exact sums, then a dense eigensolver."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(dim)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(dim)] for _, x in good])
    matrix = centred.T @ centred / n
    e, v = np.linalg.eigh(matrix)
    e, v = e[::-1], v[:, ::-1]
    keep = [c for c in range(min(k, dim)) if e[c] > e[0] * 1e-11]
    dev = [sum((n * x[j] - sums[j]) ** 2 for j in range(dim)) for _, x in good]
    return [i for i, _ in good], dev, centred @ v[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(matrix)


def check(spark, rows, k=32):
    df = table(spark, rows)
    model = whitening.fit(df, k)
    out = whitening.transform(df, model)
    got = sorted(((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in out.collect()), key=lambda r: (r[0], r[1], [abs(w) for w in r[2]]))
    ids, dev, white, explained = brute(rows, k)
    want = sorted(((i if i is not None else -1, d, list(w)) for i, d, w in zip(ids, dev, white)), key=lambda r: (r[0], r[1], [abs(w) for w in r[2]]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert len(model.values) == len(explained)
    assert np.allclose(model.values / model.trace, explained, rtol=1e-6)
    if got and len(explained):
        a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
        assert np.abs(np.abs(a) - np.abs(b)).max() < 1e-5
        assert (np.abs(a - b * np.sign((a * b).sum(axis=0))) < 1e-5).all()  # one sign a component
        assert whitening.identity_error(out, len(explained)) < 1e-6
    return model


def test_against_a_dense_eigensolver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    model = check(spark, rows)
    assert len(model.values) == 32


def test_correlated_far_and_rank_poor_vectors(spark):
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 10)) * 3
    check(spark, [(i, [*map(float, v), 2.5, float(v[0]) * 2]) for i, v in enumerate(wide)])
    far = rng.standard_normal((200, 6)) * [100, 1, 1, 0.1, 5, 5] + 3000
    check(spark, [(i, list(map(float, v))) for i, v in enumerate(far)], k=4)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((60, 5)))]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, [])]
    check(spark, rows)
    short = table(spark, rows + [(95, [1.0, 2.0])])
    assert whitening.transform(short, whitening.fit(short)).where("vec_id = 95").count() == 0
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        df = table(spark, few)
        model = whitening.fit(df)
        assert len(model.values) == 0 and whitening.identity_error(whitening.transform(df, model), 0) is None
        assert whitening.transform(df, model).count() == len([1 for _, v in few if v])
    with pytest.raises(Exception, match="too large"):
        whitening.fit(table(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0])]))


@pytest.mark.parametrize(
    "spectrum",
    [np.linspace(1, 1.2, 40), 10.0 ** (-np.arange(40) / 6), np.repeat([5, 3, 1, 0.5], 10), np.r_[np.ones(6) * 7, np.zeros(34)], np.r_[1e6, np.ones(20), np.linspace(0.1, 0.2, 19)], np.ones(40), np.r_[3.0, np.zeros(39)]],
)
def test_eigenpairs_by_contours(spectrum):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    matrix = (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    e, v = whitening.leading(matrix, 25)
    want = np.sort(spectrum)[::-1][: min(25, int((spectrum > 0).sum()))]
    assert np.allclose(e, want, rtol=1e-8)
    scaled = v / np.sqrt(e)
    assert np.abs(scaled.T @ matrix @ scaled - np.eye(len(e))).max() < 1e-7
    for x in (0.05, 0.3, 0.999, 2.0, 6.0):
        if np.abs(spectrum - x).min() > 1e-6:
            assert whitening.count_above(matrix, x) == (spectrum > x).sum()


def test_query(spark):
    out = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 32 * n and out.where("identity_error > 1e-9 OR explained <= 0").count() == 0
