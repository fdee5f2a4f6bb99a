"""Toxicity by non-negative positive-unlabelled learning on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .ngrams import list_column
from .stages import sampled

BUCKETS = 1 << 22
#: Bounds of the training sample: confirmed positives, and unlabelled texts.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000


@dataclass
class Model:
    """Weights of word buckets (presence in the text), intercept."""

    weights: np.ndarray
    bias: float


def _buckets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, per_row = T.hash_words(col, T.ALNUM)
    return (hashes >> np.uint64(42)).astype(np.int64), per_row


def _present(keys: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs."""
    both = np.unique(row_of * BUCKETS + keys)
    return both // BUCKETS, both % BUCKETS


def _features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.batches(source, "text", 1 << 22):
        keys, per_row = _buckets(batch.column("text"))
        row, key = _present(keys, np.repeat(np.arange(len(per_row)), per_row))
        at = np.searchsorted(row, np.arange(len(per_row) + 1)).astype(np.int32)
        yield pa.record_batch([batch.column("positive"), pa.ListArray.from_arrays(at, key.astype(np.int32))], names=["positive", "keys"])


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """Of each whole text; every word with a weight counts once."""
    keys, per_row = _buckets(texts)
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    known = model.weights[keys] != 0
    row, key = _present(keys[known], row_of[known])
    return 1 / (1 + np.exp(-(model.bias + np.bincount(row, weights=model.weights[key], minlength=len(per_row)))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.3, l2: float = 1e-4, min_chi2: float = 25.0) -> Model:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss, by full-batch Adagrad.

    When the unlabelled risk, corrected by the class prior, falls below zero,
    the step goes up that term instead (the non-negative rule) and, so
    the model cannot gain by driving unlabelled positives to the negative
    side.  Only buckets whose presence tells positives from unlabelled texts
    (chi-square of ``min_chi2`` or more) are learnt: rare words of single
    positives would be learnt by heart.
    """
    model = Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -20.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return model
    def spread(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.int32), *lists]), return_counts=True)

    (seen_p, n_p), (seen_u, n_u) = spread(positive), spread(unlabelled)
    seen = np.union1d(seen_p, seen_u)
    df_p, df_u = np.zeros(len(seen)), np.zeros(len(seen))
    df_p[np.searchsorted(seen, seen_p)], df_u[np.searchsorted(seen, seen_u)] = n_p, n_u
    share = (df_p + df_u) / (len(positive) + len(unlabelled))
    apart = df_p / len(positive) - df_u / len(unlabelled)
    chi2 = apart**2 / np.maximum(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)), 1e-12)
    known = seen[chi2 >= min_chi2]
    if not len(known):
        return model

    def rows(lists: list[np.ndarray]) -> list[np.ndarray]:
        places = (np.minimum(np.searchsorted(known, k), len(known) - 1) for k in lists)
        return [at[known[at] == k] for at, k in zip(places, lists)]

    pos, unl = rows(positive), rows(unlabelled)
    at_p, at_u = (np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (pos, unl))
    flat_p, flat_u = np.concatenate(pos), np.concatenate(unl)
    w, b = np.zeros(len(known)), model.bias
    sum_w, sum_b = np.full(len(known), 1e-6), 1e-6
    for _ in range(steps):
        zp = b + np.bincount(at_p, w[flat_p], len(pos))
        zu = b + np.bincount(at_u, w[flat_u], len(unl))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = su / len(unl), -prior * sp / len(pos)  # of R_u(-) - prior * R_p(-)
        if rest < 0:
            gu, gp = -gu, -gp
        gp = gp + prior * (sp - 1) / len(pos)  # of prior * R_p(+)
        g = np.bincount(flat_u, gu[at_u], len(w)) + np.bincount(flat_p, gp[at_p], len(w)) + l2 * w
        gb = gu.sum() + gp.sum()
        sum_w += g * g
        sum_b += gb * gb
        w -= rate * g / np.sqrt(sum_w)
        b -= rate * gb / np.sqrt(sum_b)
    w[np.abs(w) < 1e-2] = 0
    model.weights[known], model.bias = w, float(b)
    return model


def _distinct(ordered: list[np.ndarray]) -> list[np.ndarray]:
    """Copies of one text teach nothing more."""
    return [x for k, x in enumerate(ordered) if not k or not np.array_equal(x, ordered[k - 1])]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most about ``max_positive`` confirmed toxic and ``max_unlabelled`` unlabelled texts of ``docs``.

    ``usable``: which ids may be learnt from (on ``id_col`` of either table).
    The class prior is the share of positives among all usable labels; the
    label 0 is used for nothing else.  Null ids and labels are left out; an id
    labelled twice counts as toxic if one label says so.
    """
    ok = F.col(id_col).isNotNull() if usable is None else F.col(id_col).isNotNull() & usable
    marks = labels.where(ok & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    n, n_pos = marks.agg(F.count("*"), F.count(F.when(F.col("label") == 1, 1))).first()
    texts = docs.where(ok).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    total = docs.where(ok).count()
    # at most max_positive ids (a documented bound), so the broadcast is small at any size
    chosen = sampled(marks.where("label = 1").select(F.col(id_col).alias("doc")), "doc", max_positive, n_pos)
    pos = texts.join(F.broadcast(chosen), "doc", "left_semi").select(F.lit(True).alias("positive"), "text")
    unl = sampled(texts, "doc", max_unlabelled, total).select(F.lit(False).alias("positive"), "text")
    got = pos.unionByName(unl).mapInArrow(_features, "positive boolean, keys array<int>").toArrow()
    keys, flag = list_column(got["keys"]), got["positive"].to_numpy()
    order = sorted(range(len(keys)), key=lambda i: (len(keys[i]), keys[i].tobytes()))  # the same fit whatever order rows came in
    positive, unlabelled = _distinct([keys[i] for i in order if flag[i]]), [keys[i] for i in order if not flag[i]]
    return fit_nnpu(positive, unlabelled, n_pos / n if n else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, score)`` per row: probability that the whole text is toxic.

    Empty and null texts get the score of a text without words.  Rows and ids
    may repeat or be null, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, 16 MB

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, "text", 1 << 22):
            yield pa.record_batch([batch.column("doc"), pa.array(probabilities(batch.column("text"), shared.value))], names=["doc", "score"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose toxicity is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, text_col, 1 << 22):
            yield batch.filter(pa.array(probabilities(batch.column(place), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
