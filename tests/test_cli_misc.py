"""CLI round trip, F8, A8, pluggable tokenizer, hot-key skew."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import SF001, SF01
from diffcorpus import cli
from diffcorpus.operators import curate, scoring, sequences
from diffcorpus.sources import driver_tables as dt


def test_cli_prepare_evaluate_sequences(spark, tmp_dir, capsys):
    raw = os.path.join(tmp_dir, "raw")
    dt.commits(spark, SF001).drop("row_id").coalesce(1).write.parquet(raw)
    out = os.path.join(tmp_dir, "processed")
    cli.main(["prepare", "--input", raw, "--out", out, "--with-ids", "--funnel"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert json.loads(lines[0])["after_clean"] == 86
    assert json.loads(lines[-1]) == {"train": 54, "valid": 17, "test": 7}
    test = spark.read.json(os.path.join(out, "split=test"))
    preds = os.path.join(tmp_dir, "preds")
    test.select("row_id", F.expr("messages[2].content").alias("prediction")).write.parquet(preds)
    cli.main(["evaluate", "--data", out, "--predictions", preds, "--out", os.path.join(tmp_dir, "report")])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["n"] == 7 and summary["exact"] == 7
    cli.main(["--mode", "overwrite", "evaluate", "--data", out, "--generator", "__spark_entry__:_stub_generator",
              "--out", os.path.join(tmp_dir, "report2"), "--run-id", "stub"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary == {"run_id": "stub", "n": 7, "conventional": 7, "conventional_rate": 1.0, "exact": 0, "exact_rate": 0.0}
    cli.main(["sequences", "--data", out, "--out", os.path.join(tmp_dir, "seq")])
    seq = spark.read.parquet(os.path.join(tmp_dir, "seq"))
    assert seq.where("dataset = 'eval'").count() == 17 and seq.where("dataset = 'train'").count() == 54


def test_require_rows_and_peek(spark):
    empty = dt.commits(spark, SF001).where("false")
    with pytest.raises(ValueError, match="leave no"):
        curate.require_rows(empty)
    assert scoring.peek(dt.commits(spark, SF001)).first().row_id == 0


def test_pluggable_tokenizer(spark):
    tok = sequences.tokenizer_udf(lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = spark.createDataFrame([("ab c def",), ("",)], "s STRING")
    assert [r.t for r in df.select(tok("s").alias("t")).collect()] == [[2, 1, 3], []]


def test_hot_key_dedup_and_funnel(spark):
    """One diff holds a third of the rows: results stay exact."""
    base = dt.commits(spark, SF01)
    hot = base.withColumn("diff", F.when(F.col("row_id") % 3 == 0, F.lit("x" * 50)).otherwise(F.col("diff")))
    out = curate.dedup_keep_first(curate.basic_filters(hot))
    first = curate.basic_filters(hot).groupBy("diff").agg(F.min("row_id").alias("row_id"))
    assert {r.row_id for r in out.collect()} == {r.row_id for r in first.collect()}
    kept = {r.row_id for r in out.where(F.col("diff") == "x" * 50).collect()}
    first_hot = curate.basic_filters(hot).where(F.col("diff") == "x" * 50).agg(F.min("row_id")).first()[0]
    assert kept == {first_hot}
    row = curate.filter_funnel(hot).first()
    assert row.after_dedup == out.count()


def test_prepare_raises_when_nothing_survives(spark):
    from diffcorpus.plans.prepare import prepare

    bad = dt.commits(spark, SF001).withColumn("message", F.lit("Update things"))
    with pytest.raises(ValueError, match="leave no"):
        prepare(bad)


def test_cli_combine(spark, tmp_dir, capsys):
    c = dt.commits(spark, SF001).drop("row_id")
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    c.where("split = 'train'").write.parquet(a)
    c.where("split <> 'train'").write.parquet(b)
    out = os.path.join(tmp_dir, "combined")
    cli.main(["combine", "--inputs", a, b, "--out", out])
    values = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["split_values"]
    assert sorted(values) == ["holdout", "test", "train", "val", "validation"]
    assert spark.read.parquet(out).count() == 200


def test_cli_prompts_and_contexts(spark, tmp_dir):
    d = os.path.join(tmp_dir, "incoming")
    os.makedirs(d)
    for i, text in enumerate(["--- a\n+x\n", "  \n"]):
        with open(os.path.join(d, f"{i}.diff"), "w", encoding="utf-8") as f:
            f.write(text)
    out = os.path.join(tmp_dir, "prompts")
    cli.main(["prompts", "--diffs", d, "--out", out, "--generator", "__spark_entry__:_stub_generator"])
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].prediction.startswith("chore: update ")
    sout = os.path.join(tmp_dir, "prompts-stream")
    cli.main(["prompts", "--diffs", d, "--out", sout, "--stream", "--checkpoint", os.path.join(tmp_dir, "ck")])
    assert spark.read.parquet(sout).count() == 1
    cout = os.path.join(tmp_dir, "contexts")
    cli.main(["contexts", "--input", os.path.join(SF001, "conversations.parquet"), "--out", cout])
    assert spark.read.parquet(cout).count() == spark.read.parquet(os.path.join(SF001, "conversations.parquet")).where(
        "role = 'user'"
    ).count()
