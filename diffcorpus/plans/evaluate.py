"""Held-out chat records + predictions -> scored rows, summary, examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.chat import inference_messages, parse_chat
from ..operators import scoring, splits
from ..session import materialize


@dataclass
class Evaluation:
    scored: DataFrame
    summary: DataFrame
    examples: DataFrame
    missing: DataFrame


def gold_rows(chat: DataFrame, order_col: str = "row_id", strict: bool = True, keep: tuple = ()) -> DataFrame:
    """C3 over a chat table: ``(row_id, *keep, diff, gold)``; a record without a user or assistant text fails if ``strict``."""
    return chat.select(F.col(order_col), *keep, parse_chat("messages", strict).alias("_p")).select(
        order_col, *keep, "_p.diff", "_p.gold"
    )


def evaluate(
    chat: DataFrame,
    predictions: DataFrame,
    cfg: Config = DEFAULT,
    order_col: str = "row_id",
    run_col: str = "run_id",
    strict: bool = True,
) -> Evaluation:
    """Seeded sample of ``cfg.eval_n`` held-out records, paired with each run's predictions.

    ``predictions`` is ``(run_id, row_id, prediction)`` -- a table, or the
    output of ``operators.generation.generate``.  The sample is written once;
    everything else is lazy, so only what is asked for runs.
    """
    sample = splits.sample_n(chat, cfg.eval_n, cfg.eval_seed, order_col)
    gold = materialize(gold_rows(sample, order_col, strict, keep=("sample_pos",)), "eval-sample")
    scored = scoring.score(scoring.pair(gold, predictions, order_col))
    runs = run_col in predictions.columns
    by = [run_col] if runs else []
    if runs:
        missing = scoring.missing_by_run(gold.select(order_col), predictions, order_col, run_col)
    else:
        missing = scoring.missing_predictions(gold.select(order_col), predictions, order_col).select(
            F.lit(None).cast("string").alias(run_col), order_col
        )
    return Evaluation(
        scored=scored,
        summary=scoring.eval_summary(scored, by),
        examples=scoring.eval_examples(scored, cfg.examples_k, "sample_pos", by, cfg.preview_len),
        missing=missing,
    )


def evaluate_generated(
    chat: DataFrame,
    make_fn,
    cfg: Config = DEFAULT,
    order_col: str = "row_id",
    run_id: str = "run",
    batch_rows: int = 16,
    answers_path: str | None = None,
) -> Evaluation:
    """E2 with U1 in the loop: generate for the seeded sample, then score.

    As in the original evaluation, the prompt is rebuilt from the diff
    extracted from the held-out user message (so it can differ from the
    training prompt by the block's trailing newline).  Only the sample
    (``eval_n`` rows) reaches the generator.  With ``answers_path`` the answers
    go to a work table there, and a later call asks for the missing ones only.
    """
    from ..operators.generation import generate, generate_to

    sample = splits.sample_n(chat, cfg.eval_n, cfg.eval_seed, order_col)
    prompts = gold_rows(sample, order_col).select(
        order_col, inference_messages("diff", cfg.system_prompt, cfg.max_diff_chars).alias("messages")
    )
    if answers_path:
        preds = generate_to(prompts, make_fn, answers_path, order_col, batch_rows=batch_rows)
    else:  # the model runs once: its (at most eval_n) answers are written, then scored
        preds = materialize(generate(prompts, make_fn, batch_rows=batch_rows).select(order_col, "prediction"), "generated")
    return evaluate(chat, preds.withColumn("run_id", F.lit(run_id)), cfg, order_col)
