"""Train / valid / test splits, seeded samples and split reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CURATED_SPLITS, DEFAULT, SPLIT_NAMES, Config
from . import ranking


def n_split_values(split_col: str = "split") -> Column:
    """Aggregate: distinct split values, null counted as one value."""
    return F.count_distinct(split_col) + F.coalesce(F.max(F.col(split_col).isNull().cast("int")), F.lit(0))


def split_value_count(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Distinct split values, null counted as one value (one row, one small aggregate)."""
    return df.agg(n_split_values(split_col).alias("n_values"))


def split_mode(df: DataFrame, split_col: str = "split") -> DataFrame:
    """P1 as a table: ``n_values`` and ``mode`` ('curated' or 'random')."""
    if split_col not in df.columns:
        return df.sparkSession.createDataFrame([(0, "random")], "n_values BIGINT, mode STRING")
    return split_value_count(df, split_col).withColumn(
        "mode", F.when(F.col("n_values") <= 1, F.lit("random")).otherwise(F.lit("curated"))
    )


def choose_mode(df: DataFrame, split_col: str = "split") -> str:
    """P1: 'random' when there is no split column or at most one value, else 'curated'."""
    return split_mode(df, split_col).first()["mode"]


def curated_split(col: str = "split"):
    """Map curated values to train / valid / test; anything else gives null."""
    expr = F.lit(None).cast("string")
    for src, dst in reversed(list(CURATED_SPLITS.items())):
        expr = F.when(F.col(col) == src, F.lit(dst)).otherwise(expr)
    return expr


def split_curated(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Keep train / val / validation / test rows, renamed to train / valid / test."""
    return df.withColumn(split_col, curated_split(split_col)).where(F.col(split_col).isNotNull())


def split_random(
    df: DataFrame, cfg: Config = DEFAULT, order_col: str = "row_id", split_col: str = "split"
) -> DataFrame:
    """Exact ``int(n*train)`` / ``int(n*valid)`` / rest split in seeded order.

    Two small jobs (bucket counts, then one window over the two target
    buckets) find the keys at the cut ranks; the split itself is a map-side
    comparison, so the rows are not shuffled.  ``df`` should be a
    materialized table (it is scanned three times, ids only).
    """
    key = "_split_key"
    keyed = df.withColumn(key, ranking.seeded_key(order_col, cfg.seed))

    def ranks(n: int) -> list[int]:
        n_train = int(n * cfg.train_ratio)
        return [n_train, n_train + int(n * cfg.valid_ratio)]

    cols = [key, order_col]
    c1, c2 = ranking.cut_points(keyed, cols, ranks, ranking.hex_bucket(key))
    out = F.when(ranking.before_cut(cols, c1), F.lit("train")).when(ranking.before_cut(cols, c2), F.lit("valid")).otherwise(
        F.lit("test")
    )
    return keyed.withColumn(split_col, out).drop(key)


def split(df: DataFrame, cfg: Config = DEFAULT, order_col: str = "row_id") -> DataFrame:
    """P1 then P2 or P3."""
    if choose_mode(df, cfg.split_col) == "curated":
        return split_curated(df, cfg.split_col)
    return split_random(df, cfg, order_col, cfg.split_col)


def sample_n(df: DataFrame, n: int, seed: int = 42, order_col: str = "row_id") -> DataFrame:
    """The first ``min(n, N)`` rows in seeded order, with their 0-based ``sample_pos`` (BIGINT).

    Ids may be of any type; a null id fails.
    """
    return ranking.first_rows(df, n, order_col, "sample_pos", ranking.seeded_key(order_col, seed))


def split_values(df: DataFrame, split_col: str = "split") -> DataFrame:
    """P5: the distinct split values."""
    return df.select(split_col).distinct()


def split_counts(df: DataFrame, split_col: str = "split", names=SPLIT_NAMES) -> DataFrame:
    """A2: rows per split; every name in ``names`` appears, with 0 when empty."""
    spark = df.sparkSession
    counts = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
    all_names = spark.createDataFrame([(s,) for s in names], f"{split_col} STRING")
    return all_names.join(counts, split_col, "left").select(
        split_col, F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows")
    )


def split_report(clean: DataFrame, split_col: str = "split") -> DataFrame:
    """A2 with the curated split's silent drops: rows per train / valid / test, and ``dropped``.

    ``clean`` is the table before P2 (values other than train / val /
    validation / test, null included, are counted as ``dropped``).
    """
    target = F.coalesce(curated_split(split_col), F.lit("dropped"))
    counts = clean.groupBy(target.alias(split_col)).agg(F.count(F.lit(1)).alias("rows"))
    names = clean.sparkSession.createDataFrame([(s,) for s in (*SPLIT_NAMES, "dropped")], f"{split_col} STRING")
    return names.join(counts, split_col, "left").select(
        split_col, F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows")
    )


def corpus_size(df: DataFrame, min_rows: int = 200) -> DataFrame:
    """A3: row count and the small-corpus warning flag."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("small_corpus", F.col("rows") < min_rows)
