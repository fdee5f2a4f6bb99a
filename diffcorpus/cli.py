"""Command line: the original scripts' data steps as Spark jobs.

    python -m diffcorpus.cli combine   --inputs a.parquet b.parquet --out raw/
    python -m diffcorpus.cli prepare   --input raw/ --out processed/ [--without-ids]
    python -m diffcorpus.cli evaluate  --data processed/ --predictions preds/ --out report/
    python -m diffcorpus.cli evaluate  --data processed/ --generator my_model:load --out report/
    python -m diffcorpus.cli sequences --data processed/ --out sequences/
    python -m diffcorpus.cli prompts   --diffs incoming/ --out prompts/ [--stream --checkpoint ck/] [--generator m:f]
    python -m diffcorpus.cli contexts  --input conversations/ --out contexts/

Under spark-submit the cluster's session is used; ``spark.checkpoint.dir``
must name a shared folder for the written stages.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT

REPORT_VALUES = 50  # split values that ``combine`` prints


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("diffcorpus")
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    spark = builder.getOrCreate()
    return spark


def _read_table(spark: SparkSession, path: str):
    if path.endswith(".jsonl") or path.endswith(".json"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def cmd_combine(args, spark):
    from .sources.commits import union_splits, write_commits

    dfs = [_read_table(spark, p) for p in args.inputs]
    combined = union_splits(dfs, args.names)
    write_commits(combined, args.out, mode=args.mode)
    if "split" in combined.columns:  # a report: the first values
        values = combined.select("split").distinct().orderBy("split").limit(REPORT_VALUES).collect()
        print(json.dumps({"split_values": [r[0] for r in values]}))
    else:
        print(json.dumps({}))


def cmd_prepare(args, spark):
    from .operators import curate
    from .operators.splits import split_counts
    from .plans.prepare import prepare
    from .sources.chat_jsonl import write_splits
    from .sources.commits import read_commits

    cfg = dataclasses.replace(DEFAULT, diff_col=args.diff_col, message_col=args.message_col, split_col=args.split_col)
    raw = read_commits(spark, args.input, cfg.diff_col, cfg.message_col)
    if args.funnel:
        print(json.dumps(curate.filter_funnel(raw, cfg).first().asDict()))
    out = prepare(raw, cfg)
    write_splits(out, args.out, mode=args.mode, id_col=None if args.without_ids else "row_id")
    print(json.dumps({r["split"]: r["rows"] for r in split_counts(out).collect()}))


def _load(spec: str):
    """``package.module:function`` -> the function."""
    import importlib

    mod, _, name = spec.partition(":")
    return getattr(importlib.import_module(mod), name)


def cmd_evaluate(args, spark):
    from .plans.evaluate import evaluate, evaluate_generated
    from .sources.chat_jsonl import read_split

    cfg = dataclasses.replace(DEFAULT, eval_n=args.n, eval_seed=args.seed)
    from .operators.curate import require_rows

    test = require_rows(read_split(spark, args.data, "test", id_col="row_id"), "examples in the test split")
    if args.generator:
        ev = evaluate_generated(test, _load(args.generator), cfg, run_id=args.run_id, answers_path=args.answers)
    else:
        if not args.predictions:
            raise SystemExit("give --predictions or --generator")
        preds = _read_table(spark, args.predictions)
        if "run_id" not in preds.columns:
            preds = preds.withColumn("run_id", F.lit(args.run_id))
        ev = evaluate(test, preds, cfg)
    ev.summary.coalesce(1).write.mode(args.mode).json(f"{args.out}/summary")
    ev.examples.coalesce(1).write.mode(args.mode).json(f"{args.out}/examples")
    for r in ev.summary.collect():
        print(json.dumps(r.asDict()))


def cmd_sequences(args, spark):
    from .plans.sequences import build_sequences
    from .sources.chat_jsonl import read_split

    cfg = dataclasses.replace(
        DEFAULT, max_seq_length=args.max_seq_length, batch_size=args.batch_size, val_batches=args.val_batches
    )
    from .operators.curate import require_rows

    train = require_rows(read_split(spark, args.data, "train", id_col="row_id"), "training examples")
    valid = read_split(spark, args.data, "valid", id_col="row_id")
    chat = train.unionByName(valid)
    build_sequences(chat, cfg).write.mode(args.mode).partitionBy("dataset").parquet(args.out)


def cmd_prompts(args, spark):
    from .operators.generation import generate
    from .sources.commits import read_diffs
    from .streaming.prompts import prompts, stream_prompts

    make_fn = _load(args.generator) if args.generator else None
    if args.stream:
        sdf = stream_prompts(spark, args.diffs)
        if make_fn:
            sdf = generate(sdf, make_fn)
        q = (
            sdf
            .writeStream.format("parquet")
            .option("checkpointLocation", args.checkpoint)
            .trigger(availableNow=True)
            .start(args.out)
        )
        q.awaitTermination()
    else:
        df = prompts(read_diffs(spark, args.diffs, strict=False))
        if make_fn:
            df = generate(df, make_fn)
        df.write.mode(args.mode).parquet(args.out)


def cmd_contexts(args, spark):
    from .operators.contexts import conversation_contexts

    conversation_contexts(_read_table(spark, args.input)).write.mode(args.mode).parquet(args.out)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="diffcorpus")
    ap.add_argument("--mode", default="error", help="write mode (error, overwrite)")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("combine")
    c.add_argument("--inputs", nargs="+", required=True)
    c.add_argument("--names", nargs="+", help="split name of each input, when the inputs have no split column")
    c.add_argument("--out", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--diff-col", default="diff")
    p.add_argument("--message-col", default="message")
    p.add_argument("--split-col", default="split")
    p.add_argument("--with-ids", action="store_true", help="the default")
    p.add_argument("--without-ids", action="store_true", help="lines of messages only")
    p.add_argument("--funnel", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("--data", required=True)
    e.add_argument("--predictions", help="table (run_id?, row_id, prediction)")
    e.add_argument("--generator", help="module:factory returning fn(list of message lists) -> texts")
    e.add_argument("--run-id", default="run")
    e.add_argument("--answers", help="work table of the generator's answers; a run that was stopped goes on with it")
    e.add_argument("--out", required=True)
    e.add_argument("--n", type=int, default=DEFAULT.eval_n)
    e.add_argument("--seed", type=int, default=DEFAULT.eval_seed)
    s = sub.add_parser("sequences")
    s.add_argument("--data", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--max-seq-length", type=int, default=DEFAULT.max_seq_length)
    s.add_argument("--batch-size", type=int, default=DEFAULT.batch_size)
    s.add_argument("--val-batches", type=int, default=DEFAULT.val_batches)
    w = sub.add_parser("prompts")
    w.add_argument("--diffs", required=True)
    w.add_argument("--out", required=True)
    w.add_argument("--stream", action="store_true")
    w.add_argument("--checkpoint")
    w.add_argument("--generator", help="module:factory; answers each prompt (U1)")
    x = sub.add_parser("contexts")
    x.add_argument("--input", required=True)
    x.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = _session()
    globals()[f"cmd_{args.cmd}"](args, spark)


if __name__ == "__main__":
    main()
