"""Language ID: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .ngrams import blocks, dense, list_column, ngram_counts, sparse_rows

SIZES, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 14, 16
#: Training texts of one language at most, about.
MAX_PER_LANGUAGE = 1_000
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Embeddings (BUCKETS, WIDTH), softmax weights and bias, classes, temperature, least accepted probability."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        size = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return ((counts @ self.embed) / size) @ self.out + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], labels: list[str], epochs: int = 6, rate: float = 0.1, batch: int = 32, error: float = 0.01, seed: int = 11) -> Model:
    """Stochastic gradient descent (Adagrad step sizes) on nine tenths of the sample; the rest sets temperature and rejection.

    The temperature has the least log loss on the tenth kept back; texts whose
    best probability is below ``accept`` are rejected, where ``accept`` is the
    lowest level with at most ``error`` wrong answers among those accepted.
    """
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = max(1, len(classes))
    model = Model(rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32), classes)
    if len(classes) < 2:
        return model
    y = np.searchsorted(classes, labels)
    order = rng.permutation(len(y))
    kept, train = order[: len(y) // 10], order[len(y) // 10 :]
    params = [model.embed, model.out, model.bias]
    sums = [np.full_like(p, 1e-8) for p in params]
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), batch):
            rows = train[a : a + batch]
            x = dense([buckets[i] for i in rows], [counts[i] for i in rows], BUCKETS)
            x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
            hidden = x @ model.embed
            g = softmax(hidden @ model.out + model.bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            for p, s, step in zip(params, sums, (x.T @ (g @ model.out.T), hidden.T @ g, g.sum(axis=0))):
                s += step * step
                p -= rate * step / np.sqrt(s)
    if len(kept):
        z = np.concatenate([model.logits(dense([buckets[i]], [counts[i]], BUCKETS)) for i in kept])
        scales = np.geomspace(0.5, 20, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean() for t in scales]
        model.temperature = float(scales[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y[kept]
        down = np.argsort(-best)
        wrong = np.cumsum(~right[down]) / np.arange(1, len(kept) + 1)
        fine = np.flatnonzero(wrong <= error)
        model.accept = float(best[down[fine[-1]]]) if len(fine) else 1.0
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", usable: Column | None = None, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Fit on whole texts, at most about ``max_per_language`` of each language, chosen by a hash of the id.

    Rows with a null text or language are not learnt from.
    """
    ok = F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    src = docs.where(ok if usable is None else ok & usable).select(F.col(id_col).cast("string").alias("doc"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    sizes = src.groupBy("label").count()
    spread = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 32)) / (1 << 32)
    chosen = src.join(F.broadcast(sizes), "label").where(F.coalesce(spread, F.lit(0.0)) * F.col("count") < max_per_language).select("label", "text")
    got = chosen.mapInArrow(lambda it: sparse_rows(it, SIZES, BUCKETS, True), "label string, buckets array<int>, counts array<int>").toArrow()
    buckets, counts, labels = list_column(got["buckets"]), list_column(got["counts"]), got["label"].to_pylist()
    order = sorted(range(len(labels)), key=lambda i: (labels[i], len(buckets[i]), buckets[i].tobytes(), counts[i].tobytes()))
    return fit([buckets[i] for i in order], [counts[i] for i in order], [labels[i] for i in order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, lang_pred, score, accepted)`` per row, from the whole text.

    A null text and one without a letter get ``und``, score 0, not accepted;
    so does every text when no language was learnt.  ``accepted`` is the
    calibrated rejection.  Rows may repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH floats, 1 MB

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.classes, "und"], dtype=object)
        for batch in T.batches(source, "text", 1 << 22):
            col = batch.column("text")
            best, pick = np.zeros(len(batch)), np.full(len(batch), len(m.classes))
            if m.classes:
                for a, b, data, offs in blocks(batch, "text", True):
                    p = softmax(m.logits(ngram_counts(data, offs, SIZES, BUCKETS).astype(np.float32)) / m.temperature)
                    best[a:b], pick[a:b] = p.max(axis=1), p.argmax(axis=1)
            none = np.array([x is None or not _LETTER.search(x) for x in col.to_pylist()], dtype=bool)
            best[none], pick[none] = 0.0, len(m.classes)
            yield pa.record_batch(
                [batch.column("doc"), pa.array(names[pick], pa.string()), pa.array(best), pa.array((best >= m.accept) & (pick < len(m.classes)))],
                names=["doc", "lang_pred", "score", "accepted"],
            )

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
