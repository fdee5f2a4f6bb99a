"""Written stages below ``spark.checkpoint.dir`` and other plumbing shared by the operators."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffcorpus.session import checkpoint_root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor re-reads the table instead of re-running the
    work above it.  ``drop`` removes a stage that nothing reads any more.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "llm-stages", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a stage made by ``stage``, and the shuffles behind it; only when no later frame reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Remove the files of shuffles that no plan uses any more.

    Spark's cleaner does so once the JVM has collected the plans, which is
    asked for here as the driver's heap may not fill for hours.
    """
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % n


def sampled(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by a hash of ``key`` (all rows when there are fewer).

    A rate, not a top-k: no task sees more than its own share of the sample.
    """
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 32)) < cut)
