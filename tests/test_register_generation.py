"""U2 SQL functions agree with the Column functions; U1 generation hook."""

import os

from pyspark.sql import functions as F

from helpers import SF01
from diffcorpus.functions import chat as C
from diffcorpus.functions import text as T
from diffcorpus.functions.register import register
from diffcorpus.operators.generation import generate
from diffcorpus.sources import driver_tables as dt


def test_sql_functions_match_columns(spark):
    names = register(spark)
    assert "py_clean_message" in names
    c = dt.commits(spark, SF01)
    c.createOrReplaceTempView("commits_u2")
    sql = spark.sql(
        """SELECT row_id, py_clean_message(message) a, py_strip_footers(message) b, py_subject_line(message) c,
                  py_is_conventional(message) d, py_has_noise(message) e, py_user_message(diff) f,
                  py_extract_diff(py_user_message(diff)) g, py_norm_match(message) h, py_diff_preview(diff) i,
                  py_strip(message) j, py_is_blank(diff) k
           FROM commits_u2"""
    )
    col = c.select(
        "row_id",
        T.clean_message("message").alias("a"),
        T.strip_footers("message").alias("b"),
        T.subject_line("message").alias("c"),
        T.is_conventional("message").alias("d"),
        T.has_noise("message").alias("e"),
        T.user_message("diff").alias("f"),
        T.extract_diff(T.user_message("diff")).alias("g"),
        T.norm_match("message").alias("h"),
        T.preview("diff").alias("i"),
        T.py_strip("message").alias("j"),
        T.is_blank("diff").alias("k"),
    )
    assert sql.exceptAll(col).count() == 0 and col.exceptAll(sql).count() == 0
    s = dt.structured_commits(spark, SF01)
    s.createOrReplaceTempView("structured_u2")
    a = spark.sql("SELECT row_id, py_format_commit(type, scope, description) f, py_valid_commit_type(type) v FROM structured_u2")
    b = s.select("row_id", T.format_commit("type", "scope", "description").alias("f"), T.valid_type("type").alias("v"))
    assert a.exceptAll(b).count() == 0


def test_generate_hook_strips_and_keeps_rows(spark):
    calls = []

    def make():
        calls.append(1)
        return lambda prompts: [f"  feat: n={len(p)}\n" for p in prompts]

    df = dt.commits(spark, SF01).where(F.col("diff").isNotNull()).select("row_id", C.inference_messages("diff").alias("messages"))
    out = generate(df, make, batch_rows=7)
    rows = out.select("row_id", "prediction").collect()
    assert len(rows) == df.count()
    assert {r.prediction for r in rows} == {"feat: n=2"}


def test_python_workers_do_not_need_repo_on_path(tmp_dir):
    """Generation and tokenizer hooks run from a working directory outside the repository."""
    import subprocess
    import sys

    from helpers import ROOT

    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
n = E.queries()["generate_stub"](spark, "/root/testdata/sf0.001").count()
from diffcorpus.operators import sequences
tok = sequences.tokenizer_udf(lambda texts: [[len(w) for w in t.split()] for t in texts])
ids = spark.createDataFrame([("a bb",)], "s STRING").select(tok("s")).first()[0]
print("RESULT", n, ids)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, capture_output=True, text=True, timeout=600)
    assert "RESULT 7 [1, 2]" in out.stdout, out.stderr[-2000:]


def test_evaluate_generated_calls_model_once_per_prompt(spark, tmp_dir):
    import glob
    import uuid

    from diffcorpus.plans import evaluate as E
    from diffcorpus.plans import prepare as P

    marks = os.path.join(tmp_dir, "calls")
    os.makedirs(marks)

    def make():
        def fn(prompts):
            for _ in prompts:
                open(os.path.join(marks, uuid.uuid4().hex), "w").close()
            return ["feat: x"] * len(prompts)

        return fn

    test = P.prepare(dt.commits(spark, SF01)).where(F.col("split") == "test")
    ev = E.evaluate_generated(test, make, run_id="m")
    ev.summary.collect()
    ev.examples.collect()
    ev.missing.collect()
    assert len(glob.glob(os.path.join(marks, "*"))) == 43


def test_a_model_is_loaded_once_per_worker_and_not_for_empty_partitions(spark, tmp_dir):
    import os

    from diffcorpus.operators import generation

    def make():
        open(os.path.join(tmp_dir, f"load-{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return lambda prompts: [p[-1]["content"] for p in prompts]

    df = spark.range(60).repartition(40).selectExpr("id", "array(struct('user' AS role, string(id) AS content)) AS messages")
    got = generation.generate(df, make).select("id", "prediction").collect()
    assert sorted((r.id, r.prediction) for r in got) == [(i, str(i)) for i in range(60)]
    loads = [f for f in os.listdir(tmp_dir) if f.startswith("load-")]
    assert 0 < len(loads) == len({f.split("-")[1] for f in loads})
    generation.generate(df.where("id < 0"), make).collect()
    assert len([f for f in os.listdir(tmp_dir) if f.startswith("load-")]) == len(loads)


def test_a_stopped_generation_goes_on(spark, tmp_dir):
    """The model fails half-way; the next run asks for the missing answers only, and repeats one round at most."""
    import os
    from collections import Counter

    import pytest

    from diffcorpus.operators.generation import generate_to

    calls, stop = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "stop")
    os.makedirs(calls)
    open(stop, "w").close()

    def make():
        def fn(prompts):
            out = []
            for p in prompts:
                i = int(p[-1]["content"])
                if os.path.exists(stop) and len(os.listdir(calls)) >= 120:
                    raise RuntimeError("the model stops")
                open(os.path.join(calls, f"{i}-{os.urandom(4).hex()}"), "w").close()
                out.append(f" answer {i} ")
            return out

        return fn

    df = spark.range(240).repartition(3).selectExpr("id AS row_id", "array(struct('user' AS role, string(id) AS content)) AS messages")
    path = os.path.join(tmp_dir, "answers")
    with pytest.raises(Exception, match="the model stops"):
        generate_to(df, make, path, rounds=8)
    kept = {r.row_id for r in spark.read.parquet(path).collect()}
    assert 60 < len(kept) <= 120
    os.remove(stop)
    got = generate_to(df, make, path, rounds=8)
    assert sorted((r.row_id, r.prediction) for r in got.collect()) == [(i, f"answer {i}") for i in range(240)]
    asked = Counter(int(f.split("-")[0]) for f in os.listdir(calls))
    assert set(asked) == set(range(240)) and all(asked[i] == 1 for i in kept)
    assert sum(asked.values()) - 240 <= 240 // 8 + 20
    # nothing is left to ask; more rows ask for themselves only
    more = spark.range(250).selectExpr("id AS row_id", "array(struct('user' AS role, string(id) AS content)) AS messages")
    assert generate_to(more, make, path, rounds=2).count() == 250
    assert sum(1 for _ in os.listdir(calls)) == sum(asked.values()) + 10
    with pytest.raises(Exception, match="is null"):
        generate_to(df.selectExpr("CAST(NULL AS BIGINT) AS row_id", "messages"), make, path)


def test_sql_array_functions_match_columns(spark):
    from diffcorpus.functions.chat import CHATML
    from diffcorpus.operators import sequences

    register(spark)
    c = dt.commits(spark, SF01).select("row_id", "diff", "message")
    c.createOrReplaceTempView("commits_arrays")
    sql = spark.sql(
        """SELECT row_id, py_chat_example(diff, message) a, py_inference_messages(diff) b, py_parse_chat(py_chat_example(diff, message)) c,
                  py_prompt_messages(py_chat_example(diff, message)) d, py_render_chat(py_inference_messages(diff), true) e,
                  py_mask_labels(py_tokenize_codepoints(message), 5, 40) f, py_attention_mask(py_tokenize_codepoints(message)) g
           FROM commits_arrays WHERE diff IS NOT NULL AND message IS NOT NULL"""
    )
    chat = C.chat_example("diff", "message")
    ids = sequences.tokenize_codepoints("message")
    col = c.where("diff IS NOT NULL AND message IS NOT NULL").select(
        "row_id", chat.alias("a"), C.inference_messages("diff").alias("b"), C.parse_chat(chat).alias("c"), C.prompt_messages(chat).alias("d"),
        C.render_chat(C.inference_messages("diff"), CHATML, True).alias("e"), sequences.mask_labels(ids, 5, 40).alias("f"), sequences.attention_mask(ids).alias("g"),
    )
    assert [f.dataType.simpleString() for f in sql.schema] == [f.dataType.simpleString() for f in col.schema]
    as_text = ["row_id", *[F.to_json(x).alias(x) if x != "e" else F.col("e") for x in "abcdefg"]]
    assert sql.select(*as_text).exceptAll(col.select(*as_text)).count() == 0 == col.select(*as_text).exceptAll(sql.select(*as_text)).count()
    odd = spark.sql("SELECT py_parse_chat(array()) a, py_render_chat(array(), false) b, py_mask_labels(CAST(array() AS ARRAY<INT>), 3, 4).labels c, py_conversation_contexts(array()) d").first()
    assert odd.a.diff is None and odd.a.gold is None and odd.b == "" and odd.c == [] and odd.d == []
