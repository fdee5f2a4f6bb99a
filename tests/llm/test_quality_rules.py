import math
import random
import re

import pytest
from pyspark.sql import functions as F

from diffcorpus.llm import quality_rules
from diffcorpus.llm.queries import QUERIES

SPACE = "[\x20\x09-\x0d]+"


def base(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def rows_of(df):
    return df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_numbers_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b", "ab", "é", "日本", "😀", "#", "a|b", "!", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\r\n", " ", " ", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", " \n ", "a b c a b c", "a a a a", "x y z", "one\none\n one\none"]
    texts += [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij"], k=30_000)), "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: tuple(r)[2:7] for r in quality_rules.measure(df).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i] == want, (i, t[:80] if t else t)


@pytest.mark.parametrize("p", [0.05, 0.3])
def test_binomial_tail(spark, p):
    cases = [(k, n) for n in (0, 1, 5, 86, 200, 900) for k in (0, 1, 3, 9, 40) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("v"))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)) if r.n and r.k < r.n * p else 1.0
        assert math.isclose(r.v, exact, rel_tol=1e-9)
    # a tail of a large sample agrees with the normal curve
    n = 100_000_000
    k = int(n * p - 8 * math.sqrt(n * p * (1 - p)))
    big = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("v")).first().v
    z = (k + 0.5 - n * p) / math.sqrt(n * p * (1 - p))
    assert abs(math.log(big) / math.log(0.5 * math.erfc(-z / math.sqrt(2))) - 1) < 0.02


def corpus(spark, n, seed, noise=0.0):
    """Good prose, and junk of symbols; of the good, ``noise`` holds some symbols too."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(60)]
        if bad or rng.random() < noise:
            words = [w + "%%" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), "xx" if i % 3 else None))
        marks.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_certified_cutoffs(spark):
    docs, labels = corpus(spark, 1600, 1)
    measured = quality_rules.stage(quality_rules.measure(docs, stratum=F.col("lang")), "m")
    cutoffs = quality_rules.certify(measured, labels).collect()
    assert {r.stratum for r in cutoffs} == {"xx", "\0none"}
    for r in cutoffs:
        assert r.p_value <= quality_rules.RISK / 2 and r.cutoffs[0] is not None
    out = quality_rules.judge(docs, labels, stratum=F.col("lang"))
    got = {r.doc: r.kept for r in out.collect()}
    assert sum(not got[i] for i in range(0, 1600, 4)) > 380 and sum(got[i] for i in range(1600) if i % 4) > 1150


def test_a_bound_that_fails_rejects_nothing(spark):
    """Good documents with junk symbols in one of eight: no cutoff on symbols keeps 95 % of them, so none stands."""
    docs, labels = corpus(spark, 1600, 3, noise=0.125)
    measured = quality_rules.stage(quality_rules.measure(docs), "m")
    assert all(r.cutoffs[0] is None or r.n_lost <= 0.05 * r.n_good for r in quality_rules.certify(measured, labels, ladder=(0.3,)).collect())
    assert quality_rules.judge(docs, labels).where("NOT kept").count() < 1600 * 0.3
    # few labels certify nothing either
    few = quality_rules.judge(docs, labels.where("doc_id < 100"))
    assert few.where("NOT kept").count() == 0


def test_odd_rows(spark, odd, empty):
    docs, labels = corpus(spark, 400, 5)
    none = labels.limit(0)
    out = quality_rules.judge(odd, none, stratum=F.col("lang"))
    assert out.count() == odd.count() and out.where("kept IS NULL OR kept = base_failed").count() == 0
    assert quality_rules.judge(empty, labels).count() == 0
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 0)], "doc_id long, quality int"))
    assert quality_rules.judge(docs, twice).exceptAll(quality_rules.judge(docs, labels)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
