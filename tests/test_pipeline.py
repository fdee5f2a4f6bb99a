"""Golden counts (FIXTURES.md section 5) and end-to-end plans."""

from pyspark.sql import functions as F

from helpers import SF001, SF01
from diffcorpus.operators import curate, scoring, splits
from diffcorpus.plans import evaluate as E
from diffcorpus.plans import prepare as P
from diffcorpus.sources import driver_tables as dt


def _counts(df, col="split"):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_entry_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["row_id", "split", "messages"]
    assert df.count() == 78


def test_funnel_sf001(spark):
    row = curate.filter_funnel(dt.commits(spark, SF001)).first()
    assert (row.rows_loaded, row.after_not_null, row.after_diff_len, row.after_msg_len, row.after_dedup, row.after_clean) == (
        200, 185, 182, 152, 145, 86
    )


def test_prepare_curated_counts(spark):
    for sf, want in ((SF001, {"train": 54, "valid": 17, "test": 7}), (SF01, {"train": 263, "valid": 86, "test": 43})):
        assert _counts(P.prepare(dt.commits(spark, sf))) == want


def test_random_split_counts_and_clean_survivors(spark):
    clean = curate.curate(dt.commits(spark, SF01))
    assert {r[0] for r in clean.select(F.col("row_id") % 13).distinct().collect()} == {0, 1, 5, 10, 11, 12}
    out = splits.split_random(clean.drop("split"))
    assert _counts(out) == {"train": 349, "valid": 43, "test": 45}


def test_fence_and_long_diffs(spark):
    clean = curate.curate(dt.commits(spark, SF01))
    assert clean.where(F.length("diff") > 12_000).count() == 9
    assert clean.where(F.col("diff").contains("```")).count() == 12


def test_eval_golden(spark):
    prepared = P.prepare(dt.commits(spark, SF01))
    test = prepared.where(F.col("split") == "test")
    gold = E.gold_rows(test)
    pred = dt.predictions(spark, SF01)
    summary = {r.run_id: (r.n, r.conventional, r.exact) for r in scoring.compare_runs(scoring.score(scoring.pair(gold, pred))).collect()}
    assert summary == {"base": (43, 28, 0), "tuned": (41, 16, 7)}
    tuned = pred.where(F.col("run_id") == "tuned")
    assert scoring.missing_predictions(gold, tuned).count() == 2
    scored = scoring.score(scoring.pair(gold, tuned))
    assert scored.where("exact_match AND NOT conventional").count() == 2


def test_evaluate_plan(spark):
    prepared = P.prepare(dt.commits(spark, SF001))
    ev = E.evaluate(prepared.where(F.col("split") == "test"), dt.predictions(spark, SF001))
    got = {r.run_id: (r.n, r.conventional, r.exact) for r in ev.summary.collect()}
    assert got == {"base": (7, 5, 0), "tuned": (6, 3, 1)}
    ex = ev.examples.collect()
    assert all(r.pos <= 5 for r in ex)
    assert {(r.run_id, r.row_id) for r in ev.missing.collect()} == {
        (r.run_id, r.row_id) for r in ev.scored.where("false").collect()
    } | {("tuned", rid) for rid in {r.row_id for r in ev.scored.where("run_id = 'base'").collect()}
         - {r.row_id for r in ev.scored.where("run_id = 'tuned'").collect()}}


def test_split_report_golden(spark):
    for sf, want in (
        (SF001, {"train": 54, "valid": 17, "test": 7, "dropped": 8}),
        (SF01, {"train": 263, "valid": 86, "test": 43, "dropped": 45}),
    ):
        got = {r.split: r.rows for r in splits.split_report(curate.curate(dt.commits(spark, sf))).collect()}
        assert got == want


def test_golden_sf01_largest(spark):
    sf = "/root/testdata/sf0.1"
    c = dt.commits(spark, sf)
    row = curate.filter_funnel(c).first()
    assert (row.rows_loaded, row.after_not_null, row.after_diff_len, row.after_msg_len, row.after_dedup, row.after_clean) == (
        10_000, 9_231, 9_200, 7_670, 7_276, 4_372
    )
    clean = curate.curate(c)
    got = {r.split: r.rows for r in splits.split_report(clean).collect()}
    assert got == {"train": 2_635, "valid": 863, "test": 435, "dropped": 439}
    rnd = {r[0]: r[1] for r in splits.split_random(clean.drop("split")).groupBy("split").count().collect()}
    assert rnd == {"train": 3_497, "valid": 437, "test": 438}


def test_one_conversation_with_a_third_of_all_turns(spark):
    """Histories end at a reset, so a long conversation costs what its parts cost; one exchange in all."""
    from diffcorpus.operators.contexts import conversation_contexts

    rows = []
    for i in range(1500):
        what = "r" if i % 20 == 19 else f"ask {i}"
        rows += [(1, 2 * i, "user", what), (1, 2 * i + 1, "assistant", None if i % 7 == 0 else f"say {i}")]
    rows += [(c, t, "user", f"hello {c} {t}") for c in range(2, 3002) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    out = conversation_contexts(df, system_prompt="SYS")
    p = out._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1
    got = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.messages[1:]] for r in out.collect()}
    want, history = {}, []
    for c, t, role, text in rows[:3000]:
        if role == "user" and text == "r":
            history = []
            continue
        history = [*history, (role, text)]
        if role == "user":
            want[c, t] = history
    want |= {(c, t): [("user", f"hello {c} {k}") for k in range(t + 1)] for c in range(2, 3002) for t in range(2)}
    assert got == want
