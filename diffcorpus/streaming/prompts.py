"""Continuous prompts from diff files arriving in a folder."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import SYSTEM_PROMPT
from ..functions.chat import inference_messages
from ..functions.text import is_blank
from ..sources.commits import empty_files


def prompts(df: DataFrame, diff_col: str = "diff", system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Stateless part shared by batch and stream: blank diffs out, C2 messages in."""
    return df.where(F.col(diff_col).isNotNull() & ~is_blank(diff_col)).withColumn(
        "messages", inference_messages(diff_col, system_prompt)
    )


def stream_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(path, diff)``: the whole text of each arriving file.

    ``wholetext`` is passed as an argument (the keyword default would
    override an ``option``).
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("diff"))


def stream_prompts(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(path, diff, messages)``: one diff per arriving file.

    Attach any sink; ``availableNow`` for tests.
    """
    return prompts(stream_files(spark, path, max_files_per_trigger))


def stream_generate(spark: SparkSession, path: str, make_fn, batch_rows: int = 16) -> DataFrame:
    """W1 -> U1: prompts from arriving diff files, answered by the user's generator."""
    from ..operators.generation import generate

    return generate(stream_prompts(spark, path), make_fn, batch_rows=batch_rows)


def prompts_and_refused(
    spark: SparkSession, path: str, out: str, refused: str, system_prompt: str = SYSTEM_PROMPT, make_fn=None, max_files_per_trigger: int | None = None
) -> DataStreamWriter:
    """W1 with a second sink: prompts to ``out``, ``(path, reason)`` of files without a diff to ``refused``.

    Reasons: ``empty`` (not a byte), ``not UTF-8``, ``blank``.  Each
    micro-batch owns the folder ``batch=<id>`` of both sinks and overwrites
    it, so a batch that is run again after a crash, between the two writes
    too, leaves no doubles.  Files without a byte give no stream rows; a batch
    takes those that are in the folder by then and that no earlier batch has
    refused.  As for any file stream, files are to arrive whole.  With
    ``make_fn`` the prompts are answered as well.  Set checkpoint and trigger
    on the writer that is returned, then start it.
    """
    from ..operators.generation import generate

    def write(batch: DataFrame, batch_id: int) -> None:
        reason = F.when(~F.is_valid_utf8("diff"), "not UTF-8").when(is_blank("diff"), "blank")
        rows = batch.withColumn("reason", reason).persist(StorageLevel.MEMORY_AND_DISK)  # the files are read once for both writes
        try:
            answers = prompts(rows.where("reason IS NULL").drop("reason"), system_prompt=system_prompt)
            if make_fn is not None:
                answers = generate(answers, make_fn)
            answers.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            empty = empty_files(spark, path)
            if batch_id:
                told = spark.read.schema("path string, reason string, batch long").option("basePath", refused).parquet(refused)
                empty = empty.join(told.where(F.col("batch") < batch_id), "path", "left_anti")
            no_diff = rows.where("reason IS NOT NULL").select("path", "reason").unionByName(empty.withColumn("reason", F.lit("empty")))
            no_diff.write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")
        finally:
            rows.unpersist()

    return stream_files(spark, path, max_files_per_trigger).writeStream.foreachBatch(write)
