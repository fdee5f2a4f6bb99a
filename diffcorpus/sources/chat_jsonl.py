"""Chat JSONL files (S4-S7): ``{"messages": [{"role", "content"}, ...]}`` per line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chat import CHAT_SCHEMA
from ..operators import ranking


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` with the fields of ``schema`` from the JSON in ``value``; a line that is none, or has no messages, fails."""
    rec = lines.withColumn("_r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    bad = F.raise_error(F.concat(F.lit("no messages in the line: "), F.left("value", F.lit(80))))
    # in a filter, so that no choice of columns leaves the check out
    rec = rec.where(F.when(F.col("_r.messages").isNull(), bad.cast("boolean")).otherwise(F.lit(True)))
    return rec.select("*", "_r.*").drop("_r", "value")


def with_line_order_id(lines: DataFrame, out: str = "row_id") -> DataFrame:
    """Add a unique 0-based BIGINT id in input order (sorted files, lines within) to a scan of text files.

    Lines of one file block stay together in a task, in order, so a line's
    place is its running number less the block's first one, plus the lines of
    all blocks before: a prefix sum over a table of one row per block.
    """
    at = lines.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_no")
    )
    blocks = at.groupBy("_file", "_block").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    starts = ranking.prefix_sum(blocks, ["_file", "_block"], "_lines", "_start").drop("_lines")
    named = at.join(starts, ["_file", "_block"]).withColumn(out, F.col("_start") + F.col("_no") - F.col("_first"))
    return named.drop("_file", "_block", "_no", "_first", "_start")


def read_chat_jsonl(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    name: str | None = None,
    allow_many_dirs: bool = False,
    require_rows: bool = False,
    id_col: str | None = None,
) -> DataFrame:
    """Read chat records with a declared schema; a malformed line, or one without messages, fails.

    ``recursive`` finds files named ``name`` anywhere below ``path``; more
    than one parent directory is an error unless ``allow_many_dirs``.  With
    ``id_col`` every record gets its 0-based place in input order.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
        if name:
            reader = reader.option("pathGlobFilter", name)
    lines = reader.text(path)
    if recursive and not allow_many_dirs:
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        dirs = [r[0] for r in lines.select(folder.alias("d")).distinct().limit(2).collect()]
        if len(dirs) > 1:
            raise ValueError(f"chat files in more than one folder, such as {' and '.join(sorted(dirs))}")
    lines = lines.where(F.trim("value") != "")
    if id_col:
        lines = with_line_order_id(lines, id_col)
    df = _parsed(lines, CHAT_SCHEMA)
    if require_rows and df.isEmpty():
        raise ValueError(f"no chat records below {path}")
    return df


def chat_json(df: DataFrame, col: str = "messages", keep: tuple[str, ...] = ()) -> DataFrame:
    """S5 line text: compact JSON ``{"messages":[...]}``, non-ASCII kept raw; after the columns of ``keep``."""
    return df.select(*keep, F.to_json(F.struct(F.col(col).alias("messages"))).alias("value"))


def write_chat_jsonl(df: DataFrame, path: str, col: str = "messages", mode: str = "error") -> None:
    """One JSON object per line."""
    chat_json(df, col).write.mode(mode).text(path)


def write_splits(
    df: DataFrame,
    path: str,
    col: str = "messages",
    split_col: str = "split",
    mode: str = "error",
    id_col: str | None = "row_id",
) -> None:
    """One directory per split (``split=train`` ...), written in one job.

    Each line also carries the id (``{"row_id":…,"messages":[…]}``), so that
    held-out records can be paired with predictions later; ``id_col=None``
    leaves it out.
    """
    fields = ([F.col(id_col)] if id_col else []) + [F.col(col).alias("messages")]
    (
        df.select(F.to_json(F.struct(*fields)).alias("value"), F.col(split_col))
        .write.mode(mode)
        .partitionBy(split_col)
        .text(path)
    )


def read_split(spark: SparkSession, path: str, split: str, id_col: str | None = None) -> DataFrame:
    """One split below ``path``: ``split=<split>/`` as ``write_splits`` makes it, or files named ``<split>.jsonl``.

    With ``id_col`` the id is the one in the line, else the record's place in
    input order when no line has one; lines with and without ids do not mix.
    """
    mine = F.col("_metadata.file_path").rlike(rf"/split={re.escape(split)}/[^/]+$|/{re.escape(split)}\.jsonl$")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(mine & (F.trim("value") != ""))
    if not id_col:
        return _parsed(lines, CHAT_SCHEMA).withColumn("split", F.lit(split))
    own = F.get_json_object("value", f"$.{id_col}").cast("long")
    n, with_id = lines.agg(F.count(F.lit(1)), F.count(own)).first()
    if with_id not in (0, n):
        raise ValueError(f"{n - with_id} of {n} records of split {split} have no {id_col}")
    lines = lines.withColumn(id_col, own) if with_id else with_line_order_id(lines, id_col)
    return _parsed(lines, CHAT_SCHEMA).withColumn("split", F.lit(split))
