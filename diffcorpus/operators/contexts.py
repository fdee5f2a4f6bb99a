"""Multi-turn chat contexts from a table of conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SYSTEM_PROMPT
from ..functions.chat import message
from ..functions.text import is_blank, py_strip
from . import ranking


def _carried(turns: DataFrame) -> list[tuple]:
    """``(part, conv, resets, quits)`` before the first turn of each part that goes on with the conversation of the part before.

    A segmented prefix scan: every part gives the state of its first and its
    last conversation (one row a part reaches the driver), and the states of
    one conversation add up over the parts.
    """
    runs = turns.groupBy("_part", "_conv").agg(F.sum("_reset").alias("resets"), F.max("_quit").alias("quits"), F.min("_place").alias("at"))
    state = F.struct("_conv", "resets", "quits")
    parts = runs.groupBy("_part").agg(F.min_by(state, "at").alias("first"), F.max_by(state, "at").alias("last")).collect()
    out, carry = [], None
    for row in sorted(parts, key=lambda r: r["_part"]):
        first, last = row["first"], row["last"]
        goes_on = carry is not None and first["_conv"] == carry[0]
        if goes_on:
            out.append((row["_part"], *carry))
        same = goes_on and first == last
        carry = (last["_conv"], last["resets"] + (carry[1] if same else 0), max(last["quits"], carry[2] if same else 0))
    return out


def _contexts(system: Column, before: Column, turns: Column) -> Column:
    """Messages of the user turn at ``_i``: system prompt, turns of earlier segments, turns of this one up to it."""
    return F.concat(F.array(system), before, F.transform(F.slice(turns, F.lit(1), F.col("_i") + 1), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


def conversation_contexts(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system_prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """For every user turn: the system prompt, then the kept earlier turns and this one.

    Texts are stripped.  As in the interactive loop, blank user turns are
    skipped, a user turn ``r`` (any case) clears the history and ``q`` ends
    the conversation; assistant turns are kept as recorded (also when they
    strip to empty).  ``system`` rows are dropped: the system prompt is the
    parameter.  Output: ``(conv, turn, messages)``.

    The turns are range-partitioned, so a long conversation lies over several
    parts.  Its state (ended or not, number of resets) is carried from part to
    part, each part makes one segment per history, and a segment gets the
    turns of the earlier segments of its history.  No task holds more than a
    part and one history.
    """
    t = py_strip(F.col(text))
    low, is_user = F.lower(t), F.col(role) == "user"
    flag = F.coalesce(is_user & (low == "r"), F.lit(False)).cast("int"), F.coalesce(is_user & (low == "q"), F.lit(False)).cast("int")
    rows = df.where(F.col(role).isin("user", "assistant")).select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), t.alias("_t"), flag[0].alias("_reset"), flag[1].alias("_quit")
    )
    turns = ranking.placed(rows, ["_conv", "_turn"], "turns")
    carried = _carried(turns)
    schema = turns.select(F.col("_part").alias("_p"), F.col("_conv").alias("_c"), F.col("_place").alias("_r"), F.col("_reset").alias("_q")).schema
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # a row a part at most

    upto = Window.partitionBy("_part", "_conv").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.coalesce("_r", F.lit(0)), F.coalesce("_q", F.lit(0))
    kept = (
        turns.join(carry, (F.col("_part") == F.col("_p")) & F.col("_conv").eqNullSafe(F.col("_c")), "left")
        .withColumn("_epoch", F.sum("_reset").over(upto) + begun[0])
        .withColumn("_over", F.greatest(F.max("_quit").over(upto), begun[1]))
        .where((F.col("_over") == 0) & (F.col("_reset") == 0) & ~F.coalesce((F.col("_role") == "user") & is_blank("_t"), F.lit(False)))
    )
    entry = F.struct("_place", F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_t").alias("content"))
    segments = kept.groupBy("_part", "_conv", "_epoch").agg(F.sort_array(F.collect_list(entry)).alias("_turns"))
    system = message("system", F.lit(system_prompt))
    none = F.array().cast("array<struct<role:string,content:string>>")
    if carried:
        over = F.broadcast(carry.select("_c").distinct())
        mine = F.col("_conv").eqNullSafe(F.col("_c"))
        long = segments.join(over, mine, "left_semi")
        last = long.groupBy(F.col("_conv").alias("_lc"), F.col("_epoch").alias("_le")).agg(F.max("_part").alias("_last"))
        said = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        earlier = (
            long.join(last, F.col("_conv").eqNullSafe(F.col("_lc")) & (F.col("_epoch") == F.col("_le")) & (F.col("_part") < F.col("_last")))
            .select(F.col("_conv").alias("_ec"), F.col("_epoch").alias("_ee"), F.col("_part").alias("_from"), said.alias("_said"), F.explode(F.sequence(F.col("_part") + 1, "_last")).alias("_to"))
            .groupBy("_ec", "_ee", "_to")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_from", "_said"))), lambda x: x["_said"])).alias("_before"))
        )
        joined = long.join(earlier, F.col("_conv").eqNullSafe(F.col("_ec")) & (F.col("_epoch") == F.col("_ee")) & (F.col("_part") == F.col("_to")), "left")
        columns = ["_conv", "_turns", F.coalesce("_before", none).alias("_before")]
        segments = segments.join(over, mine, "left_anti").select("_conv", "_turns", none.alias("_before")).unionByName(joined.select(*columns))
    else:
        segments = segments.select("_conv", "_turns", none.alias("_before"))
    asked = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: F.get("_turns", i)["role"] == "user")
    return segments.select("*", F.explode(asked).alias("_i")).select(
        F.col("_conv").alias(conv), F.get("_turns", F.col("_i"))["turn"].alias(turn), _contexts(system, F.col("_before"), F.col("_turns")).alias("messages")
    )
