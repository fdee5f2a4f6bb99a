"""Stateless curation of arriving commit rows.

Dedup and the random split need the whole table and are batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from ..functions.chat import chat_example
from ..operators import curate


def stream_curate(sdf: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Same Column rules as the batch path; works on streaming and batch frames."""
    df = curate.basic_filters(sdf, cfg)
    df = curate.clean_filter(df, cfg.message_col, cfg.max_commit_lines)
    return df.withColumn(
        "messages", chat_example(cfg.diff_col, cfg.message_col, cfg.system_prompt, cfg.max_diff_chars)
    )
