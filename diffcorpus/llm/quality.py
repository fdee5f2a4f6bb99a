"""Quality by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .ngrams import blocks, dense, list_column, ngram_counts, sparse_rows
from .stages import sampled

SIZES, BUCKETS = (2, 3), 1 << 13
#: Rated texts learnt from, about.
MAX_RATED = 6_000


def _rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of n-gram shares: unit rows, zero for a text without n-grams."""
    return np.sqrt(counts.astype(np.float32) / np.maximum(counts.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """``P(grade > levels[k]) = sigmoid(x . weights - cuts[k])`` with ascending cuts."""

    weights: np.ndarray
    cuts: np.ndarray
    levels: list[int] = field(default_factory=list)

    def tails(self, counts: np.ndarray) -> np.ndarray:
        z = (_rows(counts) @ self.weights)[:, None].astype(np.float64) - self.cuts
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], grades: list[int], epochs: int = 15, rate: float = 0.1, batch: int = 64, l2: float = 1e-5, seed: int = 5) -> Model:
    """Maximum likelihood of the proportional-odds model by minibatch Adagrad.

    One weight vector serves all thresholds; they are kept in order as a first
    cut and positive steps (exponentials of free parameters).
    """
    levels = sorted(set(grades))
    model = Model(np.zeros(BUCKETS, np.float32), np.zeros(max(0, len(levels) - 1)), levels)
    if len(levels) < 2:
        return model
    y = np.searchsorted(levels, grades)
    n, k = len(y), len(levels) - 1
    above = np.clip(np.array([(y > j).mean() for j in range(k)]), 1 / (n + 1), n / (n + 1))
    cuts = -np.log(above / (1 - above))
    free = np.concatenate((cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))))
    w, rng = np.zeros(BUCKETS, np.float32), np.random.default_rng(seed)
    sum_w, sum_f = np.full(BUCKETS, 1e-8, np.float32), np.full(k, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            x = _rows(dense([buckets[i] for i in rows], [counts[i] for i in rows], BUCKETS))
            cuts = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
            edge = np.concatenate(([-1e9], cuts, [1e9]))
            s = (x @ w).astype(np.float64)
            hi, lo = (1 / (1 + np.exp(np.clip(s - edge[y[rows] + d], -500, 500))) for d in (1, 0))
            p = np.maximum(hi - lo, 1e-9)  # P(grade = y) = P(<= y) - P(<= y - 1)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g = x.T @ ((dhi - dlo) / len(rows)).astype(np.float32) + l2 * w
            dcut = np.zeros(k + 2)
            np.add.at(dcut, y[rows] + 1, -dhi / len(rows))
            np.add.at(dcut, y[rows], dlo / len(rows))
            tail = np.cumsum(dcut[1:-1][::-1])[::-1]  # a step moves all later cuts
            gf = np.concatenate((tail[:1], tail[1:] * np.exp(free[1:])))
            sum_w += g * g
            sum_f += gf * gf
            w -= rate * g / np.sqrt(sum_w)
            free -= rate * gf / np.sqrt(sum_f)
    model.weights, model.cuts = w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
    return model


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", usable: Column | None = None, max_rated: int = MAX_RATED) -> Model:
    """Fit on whole texts of about ``max_rated`` rated ids of ``ratings(id, grade)``, chosen by a hash of the id.

    Grades are integers of any number of levels.  Null ids and grades are left
    out; an id rated twice counts with its lower grade.
    """
    ok = F.col(id_col).isNotNull() if usable is None else F.col(id_col).isNotNull() & usable
    marks = ratings.where(ok & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.min(F.col(grade_col).cast("int")).alias("label"))
    chosen = sampled(marks, "doc", max_rated, marks.count())
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rated = texts.join(F.broadcast(chosen), "doc").select("label", "text")  # max_rated rows, a documented bound
    got = rated.mapInArrow(lambda it: sparse_rows(it, SIZES, BUCKETS, False), "label int, buckets array<int>, counts array<int>").toArrow()
    buckets, counts, grades = list_column(got["buckets"]), list_column(got["counts"]), got["label"].to_pylist()
    order = sorted(range(len(grades)), key=lambda i: (grades[i], len(buckets[i]), buckets[i].tobytes(), counts[i].tobytes()))
    return fit([buckets[i] for i in order], [counts[i] for i in order], [grades[i] for i in order])


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, expected_grade, tails)`` per row; ``tails[k]``: probability of a grade above the k-th level.

    Empty and null texts are graded by the thresholds alone; with fewer than
    two learnt levels ``tails`` is empty and the grade the only level (or
    null).  Rows may repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        steps = np.diff(np.array(m.levels, dtype=np.float64))
        for batch in T.batches(source, "text", 1 << 22):
            tails = np.zeros((len(batch), len(m.cuts)))
            if len(m.cuts):
                for a, b, data, offs in blocks(batch, "text", False):
                    tails[a:b] = m.tails(ngram_counts(data, offs, SIZES, BUCKETS))
            offs = (np.arange(len(batch) + 1) * len(m.cuts)).astype(np.int32)
            mean = m.levels[0] + tails @ steps if m.levels else np.full(len(batch), np.nan)
            yield pa.record_batch([batch.column("doc"), pa.array(mean, from_pandas=True), pa.ListArray.from_arrays(offs, tails.ravel())], names=["doc", "expected_grade", "tails"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, expected_grade double, tails array<double>")
