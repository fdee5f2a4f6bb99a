"""Chat records -> masked token sequences -> padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.chat import CHATML, ChatTemplate, prompt_messages, render_chat
from ..functions.templates import ModelTemplate
from ..operators import ranking, scoring, sequences
from ..operators.tokenizers import CodepointTokenizer, UdfTokenizer  # noqa: F401 - callers name them from here
from ..session import materialize


def token_ids(
    chat: DataFrame, cfg: Config = DEFAULT, template: ChatTemplate | ModelTemplate = CHATML, tokenizer=CodepointTokenizer(), counts: Observation | None = None
) -> DataFrame:
    """Q1, Q2 per record: ``(…, input_ids, _prompt)``, cut to the limit, and how many of the ids are the prompt's.

    ``counts`` is filled by the first job over the result: ``sequences``,
    ``cut_sequences`` (longer than the limit) and ``all_masked`` (no label left).
    """
    full = render_chat("messages", template, add_generation_prompt=False)
    prompt = render_chat(prompt_messages("messages"), template, add_generation_prompt=True)
    kept = [c for c in chat.columns if c != "messages"]
    # one token more than the limit tells whether a sequence is cut
    toks = chat.select(*kept, tokenizer.ids(full, cfg.max_seq_length + 1).alias("_ids"), tokenizer.count(prompt).alias("_prompt"))
    size = F.least(F.size("_ids"), F.lit(cfg.max_seq_length))
    if counts is not None:
        toks = toks.observe(
            counts, F.count(F.lit(1)).alias("sequences"), F.count_if(F.size("_ids") > cfg.max_seq_length).alias("cut_sequences"), F.count_if(F.col("_prompt") >= size).alias("all_masked")
        )
    return toks.select(*kept, F.slice("_ids", 1, cfg.max_seq_length).alias("input_ids"), F.least("_prompt", size).alias("_prompt"))


def masked(toks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Q3, Q4: mask and labels beside the ids of ``token_ids``."""
    kept = [c for c in toks.columns if c not in ("input_ids", "_prompt")]
    seq = sequences.mask_labels("input_ids", "_prompt", cfg.max_seq_length)
    return toks.select(*kept, seq.alias("_seq")).select(*kept, "_seq.input_ids", "_seq.attention_mask", "_seq.labels")


def tokenized(
    chat: DataFrame, cfg: Config = DEFAULT, template: ChatTemplate | ModelTemplate = CHATML, tokenizer=CodepointTokenizer(), counts: Observation | None = None
) -> DataFrame:
    """Q1-Q4 per record: ``(…, input_ids, attention_mask, labels)``; ``counts`` as in ``token_ids``."""
    return masked(token_ids(chat, cfg, template, tokenizer, counts), cfg)


def place(slim: DataFrame, cfg: Config, order_col: str = "row_id", digits: int = ranking.BUCKET_DIGITS) -> DataFrame:
    """``(id, batch_id, pos, width)`` in seeded order of slim rows ``(id, _len)``; width: the longest of the batch."""
    size = cfg.batch_size
    ranks = sequences.seeded_rank(slim, cfg.seed, order_col, "rank", digits=digits).select(
        order_col, "_len", F.floor(F.col("rank") / size).cast("long").alias("batch_id"), (F.col("rank") % size).cast("int").alias("pos")
    )
    widths = ranks.groupBy("batch_id").agg(F.max("_len").alias("_width"))
    return ranks.join(widths, "batch_id").select(order_col, "batch_id", "pos", "_width")


def seeded_batches(
    chat: DataFrame,
    cfg: Config = DEFAULT,
    template: ChatTemplate | ModelTemplate = CHATML,
    tokenizer=CodepointTokenizer(),
    order_col: str = "row_id",
    digits: int = ranking.BUCKET_DIGITS,
    counts: Observation | None = None,
) -> DataFrame:
    """Training batches in seeded order, padded.

    Every text is tokenized once, into a written table of ids and prompt
    lengths.  Rank, batch and width come from its slim ``(id, length)`` rows,
    are written too, and join back on the id without a hint: the planner has
    both tables' bytes.  Mask and labels, two thirds of what a record holds,
    are made after the join and are never written or shuffled.  A null id
    fails.  ``counts``: see ``token_ids``.
    """
    toks = materialize(token_ids(ranking.with_checked_id(chat, order_col), cfg, template, tokenizer, counts), "tokenized")
    placed = materialize(place(toks.select(order_col, F.size("input_ids").alias("_len")), cfg, order_col, digits), "places")
    pad = sequences.effective_pad_id(tokenizer.pad_id, tokenizer.eos_id)
    return sequences.pad_arrays(masked(toks.join(placed, order_col), cfg).withColumn("_pad_id", F.lit(pad)), F.col("_width")).drop("_width")


def build_sequences(
    chat: DataFrame,
    cfg: Config = DEFAULT,
    template: ChatTemplate | ModelTemplate = CHATML,
    tokenizer=CodepointTokenizer(),
    order_col: str = "row_id",
    counts: Observation | None = None,
) -> DataFrame:
    """Padded batches for training (seeded order) and the eval subset (input order).

    ``chat`` holds ``(row_id, split, messages)``; the eval subset is the first
    ``val_batches * batch_size`` validation rows.  Output: ``dataset, row_id,
    batch_id, pos, input_ids, attention_mask, labels``.  ``counts`` are those
    of the training sequences, see ``token_ids``.
    """
    pad = sequences.effective_pad_id(tokenizer.pad_id, tokenizer.eos_id)
    train = chat.where(F.col("split") == "train")
    valid = chat.where(F.col("split") == "valid")
    cols = ["dataset", order_col, "batch_id", "pos", "input_ids", "attention_mask", "labels"]
    train_out = seeded_batches(train, cfg, template, tokenizer, order_col, counts=counts).withColumn("dataset", F.lit("train"))
    subset = scoring.eval_subset(valid, cfg.val_batches * cfg.batch_size, order_col).withColumnRenamed("subset_pos", "rank")
    eval_out = sequences.pad_batches(tokenized(subset, cfg, template, tokenizer), cfg.batch_size, pad, "rank")
    return train_out.select(*cols).unionByName(eval_out.withColumn("dataset", F.lit("eval")).select(*cols))
