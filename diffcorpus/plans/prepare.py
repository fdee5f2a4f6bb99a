"""Raw commits -> filtered, deduplicated, cleaned, split chat examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULT, SPLIT_NAMES, Config
from ..functions.chat import chat_example
from ..operators import curate, splits
from ..session import materialize
from ..sources.chat_jsonl import write_splits


def prepare(
    df: DataFrame,
    cfg: Config = DEFAULT,
    order_col: str = "row_id",
    written: bool = True,
    require_rows: bool = True,
    counts: Observation | None = None,
) -> DataFrame:
    """Chat examples ``(row_id, split, messages)`` for train / valid / test.

    The decisions need no diff: a slim table of id, split and cleaned message
    (at most ``max_message_len`` characters) is written once below the
    checkpoint folder (when ``written``) and answers whether anything is left
    and how to split.  The diffs stay in the source scan and join on the id.
    With ``require_rows`` an empty result raises, as the original preparation
    does.  ``counts`` is filled by the job that writes the result, without a
    pass of its own: ``rows``, ``truncated_diffs`` and rows by split.
    """
    has_split = cfg.split_col in df.columns
    slim_cols = [order_col, cfg.message_col, *([cfg.split_col] if has_split else [])]
    clean = curate.curate(df, cfg, order_col)
    slim = materialize(clean.select(*slim_cols), "clean") if written else clean.select(*slim_cols)
    # one small aggregate answers both F8 (anything left?) and P1 (curated or random)
    stats = slim.agg(
        F.count(F.lit(1)).alias("rows"),
        *([splits.n_split_values(cfg.split_col).alias("n_values")] if has_split else []),
    ).first()
    if require_rows and stats["rows"] == 0:
        curate.require_rows(slim)
    if has_split and stats["n_values"] > 1:
        slim = splits.split_curated(slim, cfg.split_col)
    else:
        slim = splits.split_random(slim, cfg, order_col, cfg.split_col)
    out = df.select(order_col, cfg.diff_col).join(slim, order_col)
    if counts is not None:
        by_split = [F.count_if(F.col(cfg.split_col) == name).alias(name) for name in SPLIT_NAMES]
        out = out.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.length(cfg.diff_col) > cfg.max_diff_chars).alias("truncated_diffs"), *by_split)
    return out.select(
        F.col(order_col),
        F.col(cfg.split_col).alias("split"),
        chat_example(cfg.diff_col, cfg.message_col, cfg.system_prompt, cfg.max_diff_chars).alias("messages"),
    )


def prepare_to_jsonl(df: DataFrame, out_dir: str, cfg: Config = DEFAULT, order_col: str = "row_id") -> dict[str, int]:
    """E1 with the S6 sink: ``out_dir/split=train`` ... as JSONL, one job; returns what that job counted."""
    counts = Observation("prepared")
    write_splits(prepare(df, cfg, order_col, counts=counts), out_dir)
    return dict(counts.get)
