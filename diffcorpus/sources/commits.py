"""Commit tables and diff files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import ranking

ID_SHIFT = 40  # row index bits inside the row id: file ordinal << 40 | row index
MAX_FILES = 1 << (63 - ID_SHIFT)


def with_file_order_id(df: DataFrame, spark: SparkSession, out: str = "row_id") -> DataFrame:
    """Add a unique BIGINT id in input order: (sorted file ordinal, row index in file).

    The file table, one row per file that has rows, is made by the scan
    itself (file metadata only, no column is read), sorted over range
    partitions and written; no file list goes through the driver.  An id that
    would not fit fails the job.
    """
    files = df.select(F.col("_metadata.file_path").alias("_file_path")).distinct()
    ordinals = ranking.range_rank(files, ["_file_path"], "_file_ord")
    meta = df.select("*", F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_row_index"))
    too_many = (F.col("_file_ord") >= MAX_FILES) | (F.col("_row_index") >= (1 << ID_SHIFT))
    row_id = F.when(
        F.coalesce(too_many, F.lit(True)), F.raise_error(F.concat(F.lit("no room for an input-order id: "), F.col("_file_path")))
    ).otherwise(F.shiftleft(F.col("_file_ord"), ID_SHIFT) + F.col("_row_index"))
    return (
        meta.join(ordinals, "_file_path", "left")
        .withColumn(out, row_id.cast("long"))
        .drop("_file_path", "_row_index", "_file_ord")
    )


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the commit table has no {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def read_commits(
    spark: SparkSession, path: str, diff_col: str = "diff", message_col: str = "message", id_col: str = "row_id"
) -> DataFrame:
    """Read a Parquet commit table, check the required columns, add the input-order id."""
    df = check_columns(spark.read.parquet(path), [diff_col, message_col])
    if id_col in df.columns:
        return df
    return with_file_order_id(df, spark, id_col)


def union_splits(dfs: list[DataFrame], names: list[str] | None = None, split_col: str = "split") -> DataFrame:
    """Concatenate source splits; the schemas must have the same columns.

    With ``names`` each part is labelled with its split name in ``split_col``
    (for sources that keep splits apart instead of in a column).
    """
    if names is not None:
        if len(names) != len(dfs):
            raise ValueError("one name per part")
        dfs = [df.withColumn(split_col, F.lit(n)) for df, n in zip(dfs, names)]
    return reduce(lambda a, b: a.unionByName(b), dfs)


def write_commits(df: DataFrame, path: str, mode: str = "error") -> None:
    """S3: write the combined table as Parquet."""
    df.write.mode(mode).parquet(path)


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files without a byte: Spark's file sources list them, but give no row for them.

    The names come from the listing that the reader keeps on the driver in any
    case; the files that do have bytes are found by a scan of metadata only.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "path string")
    local = F.regexp_replace("path", "^file:/+", "file:/")  # the listing writes file:///, the scan file:/
    held = files.select(F.col("_metadata.file_path").alias("path"))
    return listed.select(local.alias("path")).join(held, "path", "left_anti")


def read_diffs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One diff per file (whole file, UTF-8); blank files are refused.

    Returns ``(path, diff)``.  With ``strict`` a file without a byte raises at
    once and a blank one when it is read; otherwise both are left out.
    """
    df = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("diff")
    )
    blank = is_blank("diff")
    if not strict:
        return df.where(~blank)
    refuse = F.raise_error(F.concat(F.lit("no diff in "), F.col("path")))
    # apart from the rows: a filter that raises would be moved below the join that finds these files
    if none := empty_files(spark, path).first():
        raise ValueError(f"no diff in {none.path}")
    # in a filter, so that no choice of columns leaves the check out
    return df.where(F.when(is_blank("diff"), refuse.cast("boolean")).otherwise(F.lit(True)))
