import numpy as np
import pyarrow as pa
import pytest

from diffcorpus.llm import pitman_yor, seating
from diffcorpus.llm.seating import Seating, draw_tables


def chances(c, new, d):
    """Number of tables of c customers: new ** t times the weight of all seatings at t tables."""
    w = seating._arrangements(d)[c] + np.arange(1, c + 1) * np.log(new)
    w = np.exp(w - w.max())
    return w / w.sum()


def test_weights_equal_single_customer_gibbs():
    rng, n, c, new, d = np.random.default_rng(1), 3000, 12, 1.7, 0.6
    rows = Seating(np.full(n, c), np.ones(n, np.int64), 400)
    every = np.arange(n)
    for _ in range(300):
        rows.remove(every, rng)
        rows.add(every, np.full(n, new), d, rng)
    want = chances(c, new, d)
    drawn = draw_tables(np.full(n, c), np.full(n, new), d, rng)
    for got in (rows.tables, drawn):
        assert abs(np.bincount(got, minlength=c + 1)[1 : c + 1] / n - want).max() < 0.04
    assert (draw_tables(np.array([0, 1]), np.ones(2), d, rng) == [0, 1]).all()


@pytest.mark.parametrize("c", [300, 2000])
@pytest.mark.parametrize("new", [1e-6, 0.02, 2.0, 40.0, 700.0, 1e5])
@pytest.mark.parametrize("d", [0.05, 0.6, 0.95])
def test_the_integral_equals_the_recursion(c, new, d):
    least, w = seating._chances(c, new, d)
    got = np.zeros(c)
    got[least - 1 : least - 1 + len(w)] = w / w.sum()
    assert abs(got - chances(c, new, d)).sum() < 1e-7


def test_a_sweep_reseats_every_customer_of_a_common_pair():
    """100,000 customers at one table: reseating a constant number of them leaves a dozen tables at most."""
    tables = np.full(pitman_yor.CONTEXTS + 1, 20.0)
    tables[3] = 2e4
    totals = pitman_yor.Totals(np.full(pitman_yor.CONTEXTS + 1, 1e6), tables, 10**8, 1000, 100, 0.7, 0.7, 1.0, 1.0)
    lists = [pa.array([[x]], pa.list_(k)) for x, k in ((3, pa.int16()), (100_000, pa.int64()), (500, pa.int32()))]
    state = pa.record_batch([pa.array([5]), *lists, pa.array([9], pa.int32()), pa.array([[0.0]], pa.list_(pa.float32()))], names=["w", "ctxs", "c", "nt", "root", "psum"])
    new = (1 + 0.7 * 2e4) * totals.parent(np.array([500]), np.array([9]))[0]
    got = [pitman_yor._sweep(state, totals, False, np.random.default_rng(k)).column("nt")[0][0].as_py() for k in range(20)]
    least, w = seating._chances(100_000, new, 0.7)
    mean = (w * (least + np.arange(len(w)))).sum() / w.sum()
    assert mean > 100 and abs(np.mean(got) / mean - 1) < 0.1
