"""Row filters, keep-first dedup and the filter funnel.

Order of the steps is part of the semantics: length filters, then dedup on
the raw diff, then message cleaning.  A diff whose first copy is later
rejected by cleaning disappears even when a later copy was clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop rows where any of ``cols`` is null."""
    return df.dropna(subset=list(cols))


def min_len(df: DataFrame, col: str, n: int) -> DataFrame:
    """keep rows whose text has at least ``n`` code points."""
    return df.where(F.length(col) >= n)


def len_between(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """keep rows whose text length is in ``[lo, hi]`` (both inclusive)."""
    return df.where(F.length(col).between(lo, hi))


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """refuse empty or whitespace-only text."""
    return df.where(F.col(col).isNotNull() & ~T.is_blank(col))


def clean_filter(df: DataFrame, col: str = "message", max_lines: int = 3) -> DataFrame:
    """F6 (with T3): replace ``col`` by its cleaned form, keep rows where it is not null."""
    return df.withColumn(col, T.clean_message(col, max_lines)).where(F.col(col).isNotNull())


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """F8: fail with a clear error when nothing survives (one small action)."""
    if df.isEmpty():
        raise ValueError(f"the filters leave no {what}: check the length bounds and the cleaning rules against the input")
    return df


def basic_filters(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Not null, diff length, raw message length."""
    df = drop_null(df, [cfg.diff_col, cfg.message_col])
    df = min_len(df, cfg.diff_col, cfg.min_diff_len)
    return len_between(df, cfg.message_col, cfg.min_message_len, cfg.max_message_len)


def content_hash(c: Column | str) -> Column:
    """32-byte SHA-256 of the text: the dedup key moved through shuffles instead of the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.sha2(c, 256))


def dedup_keep_first(df: DataFrame, key: str = "diff", order_col: str = "row_id") -> DataFrame:
    """Exact dedup on ``key`` keeping the first row in ``order_col`` order.

    ``order_col`` must be unique.  The (hash, id) pairs are written once, and
    so are the ids of later copies: those that are no group's smallest id.
    Both joins are on the unique id, so a key holding a third of all rows
    never lands in one task; the planner sees the written bytes of the later
    copies and alone decides whether the wide rows must move.
    """
    from ..session import materialize

    slim = materialize(df.select(content_hash(key).alias("_key_hash"), F.col(order_col)), "dedup-keys")
    first = slim.groupBy("_key_hash").agg(F.min(order_col).alias(order_col)).select(order_col)
    later = materialize(slim.select(order_col).join(first, order_col, "left_anti"), "later-copies")
    return df.join(later, order_col, "left_anti")


def filter_funnel(df: DataFrame, cfg: Config = DEFAULT, order_col: str = "row_id") -> DataFrame:
    """A1: rows loaded and left after each stage, in one pass.

    Columns: rows_loaded, after_not_null, after_diff_len, after_msg_len,
    after_dedup, after_clean, kept_pct (after_clean / after_dedup * 100).

    One aggregation keyed by the diff hash (null for rows that fail F1-F3):
    stage counts and the first copy's (id, cleaned-ok) are combined
    map-side, so only partial aggregates move and no group is gathered.
    """
    d, m = F.col(cfg.diff_col), F.col(cfg.message_col)
    f1 = d.isNotNull() & m.isNotNull()
    f2 = f1 & (F.length(d) >= cfg.min_diff_len)
    f3 = f2 & F.length(m).between(cfg.min_message_len, cfg.max_message_len)
    clean_ok = T.clean_message(m, cfg.max_commit_lines).isNotNull()
    per_hash = df.groupBy(F.when(f3, content_hash(d)).alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(f1).alias("_f1"),
        F.count_if(f2).alias("_f2"),
        F.count_if(f3).alias("_f3"),
        F.min_by(F.when(f3, clean_ok), F.col(order_col)).alias("_first_ok"),
    )
    first = F.col("_h").isNotNull()
    return per_hash.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows_loaded"),
        F.coalesce(F.sum("_f1"), F.lit(0)).cast("long").alias("after_not_null"),
        F.coalesce(F.sum("_f2"), F.lit(0)).cast("long").alias("after_diff_len"),
        F.coalesce(F.sum("_f3"), F.lit(0)).cast("long").alias("after_msg_len"),
        F.count_if(first).alias("after_dedup"),
        F.count_if(first & F.col("_first_ok")).alias("after_clean"),
    ).withColumn("kept_pct", F.try_divide(F.col("after_clean") * F.lit(100.0), F.col("after_dedup")))


def curate(df: DataFrame, cfg: Config = DEFAULT, order_col: str = "row_id") -> DataFrame:
    """F1-F3, D1, then T3/F6: the filtered and cleaned commit table."""
    df = basic_filters(df, cfg)
    df = dedup_keep_first(df, cfg.diff_col, order_col)
    return clean_filter(df, cfg.message_col, cfg.max_commit_lines)
