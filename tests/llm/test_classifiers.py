import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffcorpus.llm import langid, quality, toxicity
from diffcorpus.llm.ngrams import ngram_counts
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def prose(rng, n, extra=()):
    ws = ["".join(rng.choices("abdeginorst", k=rng.randint(2, 6))) for _ in range(n)]
    for w in extra:
        ws.insert(rng.randrange(len(ws)), w)
    return " ".join(ws)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(4)
    bad = ["vile", "nasty", "scorn", "filth"]
    rows, marks = [], []
    for i in range(600):
        is_bad = i % 6 == 0
        rows.append((i, prose(rng, 60, rng.sample(bad, 2) if is_bad else ())))
        if i % 5 < 3:  # as often toxic as the rest: the prior is theirs
            marks.append((i, int(is_bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_learns_from_positives_and_unlabelled(spark, toxic, odd, empty):
    docs, labels = toxic
    model = toxicity.train(docs, labels, usable=F.col("doc_id") < 450)
    got = {r.doc: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in range(450, 600)) >= 147
    assert toxicity.keep_clean(docs, model).count() == sum(s < 0.5 for s in got.values())
    # labels of ids that may not be learnt from change nothing
    other = toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id") >= 450, 1 - F.col("toxic")).otherwise(F.col("toxic"))), usable=F.col("doc_id") < 450)
    assert (other.weights == model.weights).all() and other.bias == model.bias
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).count() == 0
    same = [r.score for r in out.where("doc = 1").collect()]
    assert len(same) == 2 and same[0] == same[1]


def test_toxicity_without_positives_or_rows(spark, toxic, empty):
    docs, labels = toxic
    none = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("toxic"))
    for d, l in ((empty, labels), (docs, labels.limit(0)), (docs, nulls)):
        toxicity.score(docs, toxicity.train(d, l)).count()


def test_nnpu_risk_stays_off_the_positives():
    """With a prior a little above the truth plain PU risk goes below zero; the fit stays finite and still separates."""
    rng = np.random.default_rng(0)
    pos = [np.array([7, *rng.integers(100, 400, 5)], np.int32) for _ in range(80)]
    unl = [np.array([*([7] if i % 10 == 0 else []), *rng.integers(100, 400, 5)], np.int32) for i in range(400)]
    model = toxicity.fit_nnpu(pos, unl, 0.12)
    assert np.isfinite(model.weights).all() and model.weights[7] > 2 and model.bias < 0


def accuracy(p, y):
    return np.mean(np.array(p) == np.array(y))


def test_ordinal_levels_are_ordered_and_learnt(spark, odd, empty):
    rng = random.Random(2)
    marks = {0: "###", 1: "&&&", 2: ""}
    rows = [(i, " ".join(w + marks[i % 3] for w in prose(rng, 40).split()), i % 3 + 1) for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(docs, docs.select("doc_id", "grade"), usable=F.col("doc_id") < 270)
    assert model.levels == [1, 2, 3] and (np.diff(model.cuts) > 0).all()
    out = quality.grade(docs, model).collect()
    assert all(list(r.tails) == sorted(r.tails, reverse=True) and 1 <= r.expected_grade <= 3 for r in out)
    assert accuracy([round(r.expected_grade) for r in out if r.doc >= 270], [r.doc % 3 + 1 for r in out if r.doc >= 270]) > 0.9
    got = quality.grade(odd, model)
    assert got.count() == odd.count() and got.where("expected_grade IS NULL").count() == 0
    assert quality.grade(empty, model).count() == 0
    for ratings in (docs.select("doc_id", "grade").limit(0), docs.select("doc_id", F.lit(2).alias("grade")), docs.select("doc_id", F.lit(None).cast("int").alias("grade"))):
        flat = quality.grade(docs, quality.train(docs, ratings)).select("expected_grade", "tails").distinct().collect()
        assert len(flat) == 1 and flat[0].tails == []


def test_language_id(spark, odd, empty):
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "abcfg", "cc": "äöüß"}
    rows = [(i, " ".join("".join(rng.choices(alphabets[k], k=5)) for _ in range(30)), k) for i, k in enumerate(rng.choices(list(alphabets), k=300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, usable=F.col("doc_id") < 240)
    assert model.classes == ["aa", "bb", "cc"]
    got = {r.doc: r for r in langid.predict(docs, model).collect()}
    assert accuracy([got[i].lang_pred for i in range(240, 300)], [rows[i][2] for i in range(240, 300)]) > 0.95
    out = langid.predict(odd, model).collect()
    und = {r.doc for r in out if r.lang_pred == "und"}
    assert len(out) == odd.count() and und == {2, 3, 4, 5, None} and all((r.score == 0 and not r.accepted) == (r.lang_pred == "und") for r in out if r.lang_pred == "und")
    assert langid.predict(empty, model).count() == 0
    nothing = langid.predict(odd, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_counts_stay_inside_rows():
    data = np.frombuffer(b"abcab", np.uint8)
    whole = ngram_counts(data, np.array([0, 3, 3, 5]), (1, 2, 3), 1 << 10)
    assert whole.sum(axis=1).tolist() == [6, 0, 3]
    assert (whole[2] == ngram_counts(data[3:], np.array([0, 2]), (1, 2, 3), 1 << 10)[0]).all()


@pytest.mark.parametrize("name,column,least", [("op1_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.93)])
def test_queries_score_held_out_labels(spark, name, column, least):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", column).toPandas()
    rank, y = got.score.rank().to_numpy(), got[column].to_numpy()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > least - 0.15  # 80 labelled rows are held out here, a handful of one class


def test_language_query_on_held_out_rows(spark):
    got = QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
