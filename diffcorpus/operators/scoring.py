"""Scoring predicted commit messages against held-out ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking


def pair(gold: DataFrame, pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Gold rows with their prediction (inner equi-join on the unique key)."""
    return gold.join(pred, key, "inner")


def missing_predictions(gold: DataFrame, pred: DataFrame, key: str = "row_id") -> DataFrame:
    """J1 companion: gold rows that have no prediction."""
    return gold.join(pred.select(key), key, "left_anti")


def score(df: DataFrame, pred_col: str = "prediction", gold_col: str = "gold") -> DataFrame:
    """A4: ``conventional`` (subject of the prediction) and ``exact_match`` (strip + lower)."""
    return df.withColumn("conventional", F.coalesce(T.is_conventional(pred_col), F.lit(False))).withColumn(
        "exact_match", F.coalesce(T.norm_match(pred_col) == T.norm_match(gold_col), F.lit(False))
    )


def summary_columns():
    n = F.count(F.lit(1))
    conv = F.count_if("conventional")
    exact = F.count_if("exact_match")
    return [
        n.alias("n"),
        conv.alias("conventional"),
        F.try_divide(conv.cast("double"), n).alias("conventional_rate"),
        exact.alias("exact"),
        F.try_divide(exact.cast("double"), n).alias("exact_rate"),
    ]


def eval_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N, conventional count and rate, exact count and rate (null rate when n = 0)."""
    if by:
        return scored.groupBy(*by).agg(*summary_columns())
    return scored.agg(*summary_columns())


def compare_runs(scored: DataFrame, run_col: str = "run_id", wide: bool = False, runs: list[str] | None = None) -> DataFrame:
    """The A5 summary per run; ``wide`` gives one row with ``<run>_<metric>`` columns.

    A wide table needs its columns named: pass ``runs``.
    """
    if wide and runs is None:
        raise ValueError("wide=True needs runs: the run ids that become columns")
    if not wide:
        return eval_summary(scored, [run_col])
    return scored.groupBy().pivot(run_col, runs).agg(*summary_columns())


def eval_examples(
    scored: DataFrame, k: int = 5, order_col: str = "sample_pos", by: list[str] | None = None, preview_len: int = 200
) -> DataFrame:
    """First ``k`` exact matches ('best') and first ``k`` non-conventional ('worst').

    Rows keep sample order (``order_col``); ``total`` is the size of the whole
    bucket.  A row may be in both buckets.  The per-group top-k is a window
    with a rank limit, and totals come from a partial aggregate, so no bucket
    is ever gathered into one task.
    """
    by = list(by or [])
    buckets = F.array_compact(
        F.array(F.when(F.col("exact_match"), F.lit("best")), F.when(~F.col("conventional"), F.lit("worst")))
    )
    both = scored.withColumn("bucket", F.explode(buckets))
    keys = by + ["bucket"]
    totals = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(*keys).orderBy(order_col)
    top = both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return top.join(totals, keys).select(
        *keys, "pos", "total", F.col(order_col), "gold", "prediction", T.preview("diff", preview_len).alias("diff_preview")
    )


def eval_subset(df: DataFrame, n: int, order_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows in ``order_col`` order (unique), with 0-based ``subset_pos`` (BIGINT).

    Ids may be of any orderable type; a null id fails.
    """
    return ranking.first_rows(df, n, order_col, "subset_pos")


def missing_by_run(gold_ids: DataFrame, pred: DataFrame, key: str = "row_id", run_col: str = "run_id") -> DataFrame:
    """``(run, key)``: gold rows that a run of ``pred`` has no prediction for, for every run that ``pred`` names.

    The runs come from all of ``pred``, so one without any prediction for
    these rows is missing all of them.  Lazy: the run ids are a scalar
    subquery (few: one value per run), and only ids are joined.
    """
    runs = pred.agg(F.sort_array(F.collect_set(run_col)).alias("runs")).scalar()
    have = gold_ids.join(pred.select(key, run_col), key, "left").groupBy(key).agg(F.collect_set(run_col).alias("_have"))
    return have.select(F.explode(F.array_except(runs, "_have")).alias(run_col), key)


def peek(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """The first row."""
    return df.orderBy(order_col).limit(1)
