"""Batch generation hook over partitions."""

from __future__ import annotations

import os
import sys
import sysconfig
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root
from . import ranking

Generator = Callable[[list[list[dict]]], list[str]]


def ship_by_value(fn) -> None:
    """Let Python workers rebuild ``fn`` without importing its module.

    Functions from modules outside the installed packages (a script, a
    notebook helper, this repository when not installed) are pickled by
    value, so workers do not need the driver's working directory on their
    path.  Cluster deployments may still ship the package with ``--py-files``.
    """
    name = getattr(fn, "__module__", None)
    mod = sys.modules.get(name or "")
    if mod is None or name == "__main__" or not getattr(mod, "__file__", None):
        return
    installed = {os.path.realpath(p) for p in (sysconfig.get_paths().get("purelib"), sysconfig.get_paths().get("platlib")) if p}
    if any(os.path.realpath(mod.__file__).startswith(p + os.sep) for p in installed):
        return
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(mod)


def generate(
    df: DataFrame,
    make_fn: Callable[[], Generator],
    messages_col: str = "messages",
    out_col: str = "prediction",
    batch_rows: int = 16,
) -> DataFrame:
    """Run a user generator on prompt messages; outputs are stripped.

    ``make_fn`` (load the model there) is called once per Python worker and
    not for empty partitions; the returned function gets a list of message
    lists (dicts with ``role``/``content``) and returns one text per prompt.
    Rows stream through in Arrow batches of ``batch_rows``.  The result is
    lazy like any DataFrame: write it (see ``session.materialize``) before
    using it twice, or the model runs twice.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])
    ship_by_value(make_fn)
    key = f"{getattr(make_fn, '__module__', '')}.{getattr(make_fn, '__qualname__', '')}-{uuid.uuid4().hex}"

    def run(batches: Iterator) -> Iterator:
        loaded = sys.__dict__.setdefault("_diffcorpus_generators", {})  # lives as long as the worker process
        for pdf in batches:
            if len(pdf) and key not in loaded:
                loaded.clear()  # one model at a time
                loaded[key] = make_fn()
            for start in range(0, len(pdf), batch_rows):
                chunk = pdf.iloc[start : start + batch_rows].copy()
                prompts = [[{"role": m["role"], "content": m["content"]} for m in msgs] for msgs in chunk[messages_col]]
                outs = loaded[key](prompts)
                if len(outs) != len(prompts):
                    raise ValueError("generator returned a different number of outputs")
                chunk[out_col] = [None if o is None else str(o).strip() for o in outs]
                yield chunk

    return df.mapInPandas(run, schema)


def answers(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a work table holds so far; nothing when there is none yet."""
    try:
        spark.read.format("parquet").load(path).limit(0).schema  # noqa: B018 - fails when the path is missing or empty
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def generate_to(
    df: DataFrame,
    make_fn: Callable[[], Generator],
    path: str,
    key: str = "row_id",
    messages_col: str = "messages",
    out_col: str = "prediction",
    batch_rows: int = 16,
    rounds: int = 16,
) -> DataFrame:
    """``generate`` into a work table at ``path`` that a later call goes on with; returns ``(key, out_col)`` of ``df``'s rows.

    Keys that the table has are left out, whoever answered them.  The others
    are dealt by a hash of the key to ``rounds`` rounds, and each round is
    appended to the table in a job of its own: a run that is stopped loses the
    answers of one round at most, and a lost executor those of its running
    tasks, as the model runs in the writing stage.  Keys are unique; a null
    key fails.  Equal calls at the same time would answer twice.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], T.StructField(out_col, T.StringType())])
    asked = ranking.with_checked_id(df.select(key, messages_col), key)
    todo = asked.join(answers(spark, path, schema).select(key), key, "left_anti")
    todo = todo.withColumn("_round", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(rounds)).cast("int"))
    work = f"{checkpoint_root(spark)}/diffcorpus-stages/work-{uuid.uuid4().hex}"
    todo.write.partitionBy("_round").parquet(work)
    waiting = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("_round", T.IntegerType())])).parquet(work)
    for number in range(rounds):
        part = waiting.where(F.col("_round") == number).drop("_round")
        generate(part, make_fn, messages_col, out_col, batch_rows).select(key, out_col).write.mode("append").parquet(path)
    return answers(spark, path, schema).join(df.select(key), key, "left_semi")
