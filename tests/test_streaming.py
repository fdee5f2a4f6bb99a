"""A stream gives the same rows as the batch path."""

import os

from pyspark.sql import functions as F

from helpers import SF001
from diffcorpus.sources import commits as SC
from diffcorpus.sources import driver_tables as dt
from diffcorpus.streaming.curate import stream_curate
from diffcorpus.streaming.prompts import prompts, prompts_and_refused, stream_generate, stream_prompts


def _run_to_table(sdf, spark, tmp_dir, name):
    out, ck = os.path.join(tmp_dir, name), os.path.join(tmp_dir, name + "-ck")
    q = sdf.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination(300)
    return spark.read.parquet(out)


def test_stream_prompts_equals_batch(spark, tmp_dir):
    d = os.path.join(tmp_dir, "incoming")
    os.makedirs(d)
    for i, text in enumerate(["--- a\n+x\n", "   \n", "--- b\n-y\n+z\n"]):
        with open(os.path.join(d, f"{i}.diff"), "w", encoding="utf-8") as f:
            f.write(text)
    streamed = _run_to_table(stream_prompts(spark, d), spark, tmp_dir, "w1")
    batch = prompts(SC.read_diffs(spark, d, strict=False))
    cols = ["path", "diff", F.to_json("messages").alias("m")]
    assert sorted(map(tuple, streamed.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert streamed.count() == 2


def test_stream_curate_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "commits")
    dt.commits(spark, SF001).repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    streamed = _run_to_table(stream_curate(sdf), spark, tmp_dir, "w2")
    batch = stream_curate(spark.read.parquet(src))
    cols = ["row_id", "message", F.to_json("messages").alias("m")]
    assert sorted(map(tuple, streamed.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_stream_generate_equals_batch(spark, tmp_dir):
    from diffcorpus.operators.generation import generate

    d = os.path.join(tmp_dir, "incoming-gen")
    os.makedirs(d)
    for i, text in enumerate(["--- a\n+x\n", "\n", "--- c\n+yy\n"]):
        with open(os.path.join(d, f"{i}.diff"), "w", encoding="utf-8") as f:
            f.write(text)

    def make():
        return lambda ps: [f" fix: {len(p[1]['content'])} \n" for p in ps]

    streamed = _run_to_table(stream_generate(spark, d, make), spark, tmp_dir, "w1u1")
    batch = generate(prompts(SC.read_diffs(spark, d, strict=False)), make)
    got = sorted((r.path, r.prediction) for r in streamed.collect())
    assert got == sorted((r.path, r.prediction) for r in batch.collect())
    assert len(got) == 2 and all(p.startswith("fix: ") for _, p in got)


def _arrive(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, content in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)


def test_refused_files_have_a_sink_of_their_own(spark, tmp_dir):
    d, out, no, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "refused", "ck"))

    def run(**more):
        writer = prompts_and_refused(spark, d, out, no, max_files_per_trigger=2, **more)
        writer.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(300)
        good = sorted((os.path.basename(r.path), r.diff) for r in spark.read.parquet(out).collect())
        bad = sorted((os.path.basename(r.path), r.reason) for r in spark.read.parquet(no).collect())
        return good, bad

    _arrive(d, {"a.diff": b"--- a\n+x\n", "b.diff": b"", "c.diff": " \n\u2003\n".encode(), "d.diff": b"+\xff\xfe\n", "e.diff": "+\u00e9\n".encode()})
    good, bad = [("a.diff", "--- a\n+x\n"), ("e.diff", "+\u00e9\n")], [("b.diff", "empty"), ("c.diff", "blank"), ("d.diff", "not UTF-8")]
    assert run() == (good, bad)
    assert run() == (good, bad)  # nothing has arrived since
    # a crash after the writes of the last batch and before its commit: the batch runs again
    commits = sorted((f for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit()), key=int)
    os.remove(os.path.join(ck, "commits", commits[-1]))
    os.remove(os.path.join(ck, "commits", f".{commits[-1]}.crc"))
    assert run() == (good, bad)
    _arrive(d, {"f.diff": b"+f\n", "g.diff": b""})
    assert run() == (good + [("f.diff", "+f\n")], bad + [("g.diff", "empty")])


def test_refused_files_with_answers_and_only_refused(spark, tmp_dir):
    d, out, no = (os.path.join(tmp_dir, x) for x in ("in", "out", "refused"))
    _arrive(d, {"a.diff": b"\n", "b.diff": b""})

    def run():
        writer = prompts_and_refused(spark, d, out, no, make_fn=lambda: lambda ps: [f"fix: {len(p)}" for p in ps])
        writer.option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start().awaitTermination(300)

    run()
    assert spark.read.parquet(out).count() == 0 and spark.read.parquet(no).count() == 2
    _arrive(d, {"c.diff": b"+c\n"})
    run()
    assert [r.prediction for r in spark.read.parquet(out).collect()] == ["fix: 2"]
