"""Token sequences with prompt masking, and padded batches (Q2-Q5)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IGNORE_LABEL
from ..functions.text import _c
from . import ranking

IDS = T.ArrayType(T.IntegerType())
#: Characters of text that a user's tokenizer gets at a time (one text at least).
ENCODE_CHARS = 1 << 20


def tokenize_codepoints(c: Column | str) -> Column:
    """Q2 built-in tokenizer: one id per code point (JVM-side)."""
    c = _c(c)
    return F.when(c == F.lit(""), F.array().cast(IDS)).otherwise(F.transform(F.split(c, "", -1), lambda x: F.ascii(x)))


def tokenizer_udf(encode: Callable[[list[str]], list[list[int]]], limit: int | None = None, count: bool = False):
    """Q2 pluggable tokenizer: ``encode`` maps a batch of texts to id lists.

    Runs as an Arrow UDF; ``encode`` is built once per worker and gets about
    ``ENCODE_CHARS`` characters at a time, as its id lists are many times the
    size of the texts.  ``limit``: only the first ids of a text are returned;
    ``count``: only how many there are.
    """
    from .generation import ship_by_value

    ship_by_value(encode)
    chars, kind = ENCODE_CHARS, pa.list_(pa.int32())

    def some(texts: pa.Array) -> pa.Array:
        ids = pa.array(list(encode(texts.to_pylist())), kind)
        if count:
            return pc.list_value_length(ids)
        return pc.list_slice(ids, 0, limit) if limit else ids

    @F.arrow_udf(T.IntegerType() if count else IDS)
    def _tok(col: pa.Array) -> pa.Array:
        before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.utf8_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        out, i = [], 0
        while i < len(col):
            j = max(int(np.searchsorted(before, before[i] + chars, side="right")) - 1, i + 1)
            out.append(some(col.slice(i, j - i)))
            i = j
        return pa.concat_arrays(out) if out else some(col)

    return _tok


def tokenize(df: DataFrame, col: str, tokenizer=None, out: str = "input_ids") -> DataFrame:
    """Q2: add token ids of ``col``; ``tokenizer`` is None (code points) or a batch ``encode`` function."""
    ids = tokenize_codepoints(col) if tokenizer is None else tokenizer_udf(tokenizer)(F.col(col))
    return df.withColumn(out, ids)


def attention_mask(ids: Column | str) -> Column:
    """Q4: one ``1`` per token."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def mask_labels(full_ids: Column | str, prompt_len: Column | str | int, max_seq_length: int) -> Column:
    """Q3 + Q4: ``struct(input_ids, attention_mask, labels)``.

    The full sequence is cut to ``max_seq_length``; the prompt is not, so a
    prompt at least as long as the limit leaves every label ignored.
    """
    full = F.slice(_c(full_ids), 1, max_seq_length)
    plen = F.lit(prompt_len) if isinstance(prompt_len, int) else _c(prompt_len)
    p = F.least(plen, F.size(full))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_LABEL), p), F.slice(full, p + 1, F.greatest(F.size(full) - p, F.lit(0)))
    )
    return F.struct(
        full.alias("input_ids"),
        attention_mask(full).alias("attention_mask"),
        labels.alias("labels"),
    )


def effective_pad_id(pad_id: int | None, eos_id: int | None) -> int:
    """Pad id, falling back to the end-of-text id when it is missing or 0."""
    out = pad_id or eos_id
    if out is None:
        raise ValueError("need a pad or end-of-text id")
    return out


def seeded_rank(
    df: DataFrame,
    seed: int = 42,
    order_col: str = "row_id",
    out: str = "rank",
    keep_bucket: bool = False,
    digits: int = ranking.BUCKET_DIGITS,
) -> DataFrame:
    """Exact rank in seeded shuffle order (the order a seeded sampler visits rows)."""
    key = "_rank_key"
    keyed = df.withColumn(key, ranking.seeded_key(order_col, seed))
    return ranking.global_rank(keyed, [key, order_col], ranking.hex_bucket(key, digits), out, keep_bucket).drop(key)


def pad_arrays(df: DataFrame, width: Column) -> DataFrame:
    """Right-pad ``input_ids`` / ``attention_mask`` / ``labels`` to ``width`` (uses ``pad_id`` column ``_pad_id``)."""
    n = F.size("input_ids")
    padded = df.withColumn("_pad", width - n)

    def pad(col: str, value: Column) -> Column:
        return F.concat(F.col(col), F.array_repeat(value, F.col("_pad")))

    return (
        padded.withColumn("input_ids", pad("input_ids", F.col("_pad_id")))
        .withColumn("attention_mask", pad("attention_mask", F.lit(0)))
        .withColumn("labels", pad("labels", F.lit(IGNORE_LABEL)))
        .drop("_pad", "_pad_id")
    )


def pad_batches(df: DataFrame, batch_size: int, pad_id: int, rank_col: str = "rank") -> DataFrame:
    """Q5: ``batch_id = rank div batch_size``; right-pad the three arrays to the batch maximum.

    ids pad with ``pad_id``, the mask with 0, labels with -100.  The widths
    come from slim rows (a partial maximum per batch) and join back by batch.
    """
    batch = F.floor(F.col(rank_col) / batch_size).cast("long").alias("batch_id")
    widths = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_width"))
    batched = df.select("*", batch, (F.col(rank_col) % batch_size).cast("int").alias("pos")).join(widths, "batch_id")
    return pad_arrays(batched.withColumn("_pad_id", F.lit(pad_id)), F.col("_width")).drop("_width")
