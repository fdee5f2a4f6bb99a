"""C5 on conversations that lie over many partitions."""

import random

import pytest

from diffcorpus.operators import contexts, ranking


def brute(rows):
    out, by_conv = {}, {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    for conv, turns in by_conv.items():
        history = []
        for turn, role, text in sorted(turns, key=lambda x: x[0]):
            text = text.strip()
            if role == "user" and text.lower() == "q":
                break
            if role == "user" and text.lower() == "r":
                history = []
            elif role in ("user", "assistant") and (role == "assistant" or text):
                history.append((role, text))
                if role == "user":
                    out[conv, turn] = [("system", "SYS"), *history]
    return out


def conversations(seed, long_turns):
    """One conversation holds a third of all turns, with few resets; others end early, begin with a reset or hold one turn."""
    rng = random.Random(seed)
    said = ["hello", " padded ", "", "\t", "R ", "more", "text"]
    rows = [("long", i, rng.choice(["user", "assistant", "system"]), "r" if rng.random() < 0.01 else f"turn {i}") for i in range(long_turns)]
    for c in range(long_turns // 10):
        n = rng.randint(1, 30)
        rows += [(f"c{c:03d}" if c else None, i, rng.choice(["user", "assistant"]), "q" if rng.random() < 0.03 else rng.choice(said)) for i in range(n)]
    rows += [("quits", i, "user", "q" if i == 200 else f"x{i}") for i in range(400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_long_conversations_spread_over_tasks(spark, parts):
    rows = conversations(parts, 900)
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = contexts.conversation_contexts(df, system_prompt="SYS")
        got = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.messages] for r in out.collect()}
        spread = ranking.placed(df, ["conv_id", "turn"]).where("conv_id = 'long'").select("_part").distinct().count()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == brute(rows)
    assert spread >= parts // 4
    assert "SinglePartition" not in plan


def test_empty_and_system_only(spark):
    for rows in ([], [("a", 1, "system", "x")], [("a", 1, "user", None)], [("a", 1, None, "x")]):
        df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
        out = contexts.conversation_contexts(df)
        assert out.columns == ["conv_id", "turn", "messages"] and out.count() <= 1
