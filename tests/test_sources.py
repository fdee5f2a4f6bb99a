"""S1-S8 round trips and error paths."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import SF001
from diffcorpus.plans import prepare as P
from diffcorpus.sources import chat_jsonl as J
from diffcorpus.sources import commits as SC
from diffcorpus.sources import driver_tables as dt


def test_read_commits_checks_columns_and_orders(spark, tmp_dir):
    c = dt.commits(spark, SF001).drop("row_id")
    path = os.path.join(tmp_dir, "raw")
    SC.write_commits(c.coalesce(1).orderBy(F.length("diff")), path)
    df = SC.read_commits(spark, path)
    assert df.count() == 200 and df.select("row_id").distinct().count() == 200
    with pytest.raises(ValueError, match="has no"):
        SC.read_commits(spark, path, diff_col="patch")


def test_file_order_id_follows_file_then_row(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "t", "a"), os.path.join(tmp_dir, "t", "b")
    spark.createDataFrame([(f"x{i}",) for i in range(5)], "v STRING").coalesce(1).write.parquet(a)
    spark.createDataFrame([(f"y{i}",) for i in range(3)], "v STRING").coalesce(1).write.parquet(b)
    df = SC.with_file_order_id(spark.read.parquet(a, b), spark)
    got = [r.v for r in df.orderBy("row_id").collect()]
    assert got == [f"x{i}" for i in range(5)] + [f"y{i}" for i in range(3)]


def test_union_splits_requires_same_columns(spark):
    a = spark.createDataFrame([("d", "m")], "diff STRING, message STRING")
    b = spark.createDataFrame([("m2", "d2")], "message STRING, diff STRING")
    assert SC.union_splits([a, b]).where("diff = 'd2'").count() == 1
    with pytest.raises(Exception):
        SC.union_splits([a, b.drop("message")]).collect()


def test_write_splits_round_trip(spark, tmp_dir):
    prepared = P.prepare(dt.commits(spark, SF001))
    out = os.path.join(tmp_dir, "jsonl")
    J.write_splits(prepared, out)
    assert {d for d in os.listdir(out) if d.startswith("split=")} == {"split=train", "split=valid", "split=test"}
    back = J.read_split(spark, out, "train")
    assert back.count() == 54
    line = spark.read.text(os.path.join(out, "split=train")).first().value
    rec = json.loads(line)
    assert [m["role"] for m in rec["messages"]] == ["system", "user", "assistant"]
    assert ": " not in line.split('"content"')[0]  # compact separators


def test_read_chat_jsonl_failfast_and_recursive(spark, tmp_dir):
    good = os.path.join(tmp_dir, "deep", "x", "data")
    os.makedirs(good)
    with open(os.path.join(good, "test.jsonl"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"messages": [{"role": "user", "content": "é"}]}, ensure_ascii=False) + "\n")
    df = J.read_chat_jsonl(spark, os.path.join(tmp_dir, "deep"), recursive=True, name="test.jsonl")
    assert df.first().messages[0].content == "é"
    other = os.path.join(tmp_dir, "deep", "y")
    os.makedirs(other)
    with open(os.path.join(other, "test.jsonl"), "w", encoding="utf-8") as f:
        f.write('{"messages": []}\n')
    with pytest.raises(ValueError, match="more than one folder"):
        J.read_chat_jsonl(spark, os.path.join(tmp_dir, "deep"), recursive=True, name="test.jsonl")
    bad = os.path.join(tmp_dir, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"messages": [}\n')
    with pytest.raises(Exception):
        J.read_chat_jsonl(spark, bad).collect()
    empty = os.path.join(tmp_dir, "empty.jsonl")
    open(empty, "w").close()
    with pytest.raises(ValueError, match="no chat records"):
        J.read_chat_jsonl(spark, empty, require_rows=True)


def test_read_diffs_whole_file_and_blank(spark, tmp_dir):
    d = os.path.join(tmp_dir, "diffs")
    os.makedirs(d)
    with open(os.path.join(d, "a.diff"), "w", encoding="utf-8") as f:
        f.write("--- a\n+++ b\n+x\n")
    with open(os.path.join(d, "b.diff"), "w", encoding="utf-8") as f:
        f.write("  \n\t\n")
    rows = SC.read_diffs(spark, d, strict=False).collect()
    assert [r.diff for r in rows] == ["--- a\n+++ b\n+x\n"]
    with pytest.raises(Exception):
        SC.read_diffs(spark, d, strict=True).collect()


def test_read_diffs_refuses_a_file_without_a_byte(spark, tmp_dir):
    d = os.path.join(tmp_dir, "some empty")
    os.makedirs(d)
    for name, text in (("a b%20.diff", "+x\n"), ("none \u00e9.diff", "")):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    assert [r.path.rsplit("/", 1)[1] for r in SC.empty_files(spark, d).collect()] == ["none%20\u00e9.diff"]
    assert SC.read_diffs(spark, d, strict=False).count() == 1
    with pytest.raises(Exception, match="no diff in"):
        SC.read_diffs(spark, d).collect()
    os.remove(os.path.join(d, "none \u00e9.diff"))
    assert SC.read_diffs(spark, d).count() == 1


def test_file_order_id_with_encoded_path(spark, tmp_dir):
    p = os.path.join(tmp_dir, "with space=1", "t")
    spark.range(0, 20).repartition(3).write.parquet(p)
    df = SC.with_file_order_id(spark.read.parquet(p), spark)
    rows = df.collect()
    assert len(rows) == 20 and len({r.row_id for r in rows}) == 20


def test_union_splits_labels_parts(spark):
    a = spark.createDataFrame([("d1", "m1")], "diff STRING, message STRING")
    b = spark.createDataFrame([("d2", "m2"), ("d3", "m3")], "diff STRING, message STRING")
    out = SC.union_splits([a, b], names=["train", "test"])
    assert sorted((r.diff, r.split) for r in out.collect()) == [("d1", "train"), ("d2", "test"), ("d3", "test")]


def test_input_order_over_many_small_files(spark, tmp_dir):
    """10,000 files in 100 folders: places come from a prefix sum over partitions, not from one task."""
    want = []
    for i in range(10_000):
        d = os.path.join(tmp_dir, "chat", f"part{i % 100:03d}")
        os.makedirs(d, exist_ok=True)
        name = os.path.join(d, f"f{i // 100:03d}.jsonl")
        lines = [f'{{"messages":[{{"role":"user","content":"{i}.{k}"}}]}}' for k in range(i % 3)]
        with open(name, "w") as f:
            f.write("\n".join(lines))
        want += [(name, k, f"{i}.{k}") for k in range(i % 3)]
    df = J.read_chat_jsonl(spark, os.path.join(tmp_dir, "chat"), recursive=True, allow_many_dirs=True, id_col="row_id")
    got = df.selectExpr("row_id", "messages[0].content AS c").collect()
    assert sorted((r.row_id, r.c) for r in got) == list(enumerate(c for _, _, c in sorted(want)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
