"""Cases only unit tests can hold (FIXTURES.md section 6)."""

import pytest
from pyspark.sql import functions as F

from diffcorpus.functions import chat as C
from diffcorpus.operators import contexts, scoring, splits


def _commits(spark, splits_col):
    rows = [(i, "d" * 30 + str(i), "feat: change number %d" % i, s) for i, s in enumerate(splits_col)]
    return spark.createDataFrame(rows, "row_id BIGINT, diff STRING, message STRING, split STRING")


def test_split_mode_null_counts_as_value(spark):
    assert splits.choose_mode(_commits(spark, [None] * 5)) == "random"
    assert splits.choose_mode(_commits(spark, ["train"] * 5)) == "random"
    assert splits.choose_mode(_commits(spark, ["train", None, "train"])) == "curated"
    assert splits.choose_mode(_commits(spark, ["train"]).drop("split")) == "random"


def test_curated_drops_literal_valid_null_and_others(spark):
    df = _commits(spark, ["train", "val", "validation", "test", "valid", None, "holdout", "TRAIN"])
    got = {r.row_id: r.split for r in splits.split_curated(df).collect()}
    assert got == {0: "train", 1: "valid", 2: "valid", 3: "test"}


def test_random_split_small_and_empty(spark):
    df = _commits(spark, [None] * 7)
    counts = {r[0]: r[1] for r in splits.split_random(df).groupBy("split").count().collect()}
    assert counts == {"train": 5, "test": 2}  # int(7*0.8)=5, int(7*0.1)=0
    assert splits.split_random(df.where("false")).count() == 0


def test_eval_summary_empty_gives_null_rates(spark):
    empty = spark.createDataFrame([], "conventional BOOLEAN, exact_match BOOLEAN")
    row = scoring.eval_summary(empty).first()
    assert (row.n, row.conventional, row.exact, row.conventional_rate, row.exact_rate) == (0, 0, 0, None, None)


def test_parse_chat_missing_roles(spark):
    df = spark.createDataFrame(
        [([("system", "s"), ("user", "Diff:\n```diff\nx\n```")],), ([("assistant", "feat: a")],)],
        "messages ARRAY<STRUCT<role: STRING, content: STRING>>",
    )
    rows = df.select(C.parse_chat("messages").alias("p")).select("p.*").collect()
    assert [(r.diff, r.gold) for r in rows] == [("x\n", None), (None, "feat: a")]
    with pytest.raises(Exception):
        df.select(C.parse_chat("messages", strict=True).alias("p")).collect()


def test_conversation_reset_quit_blank_and_system(spark):
    turns = [
        (1, 0, "system", "ignored system row"),
        (1, 1, "user", "  first question  "),
        (1, 2, "assistant", "first answer"),
        (1, 3, "user", "   "),  # blank: skipped
        (1, 4, "user", "R"),  # reset
        (1, 5, "user", "second"),
        (1, 6, "assistant", "  "),  # blank assistant reply: kept, stripped
        (1, 7, "user", "third"),
        (1, 8, "user", "q"),  # ends the conversation
        (1, 9, "user", "after quit"),
        (2, 0, "user", "other conversation"),
    ]
    df = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    out = contexts.conversation_contexts(df, system_prompt="SYS")
    got = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.messages] for r in out.collect()}
    assert got == {
        (1, 1): [("system", "SYS"), ("user", "first question")],
        (1, 5): [("system", "SYS"), ("user", "second")],
        (1, 7): [("system", "SYS"), ("user", "second"), ("assistant", ""), ("user", "third")],
        (2, 0): [("system", "SYS"), ("user", "other conversation")],
    }


def test_kelvin_sign_does_not_break_rules(spark):
    from helpers import apply
    from diffcorpus.functions import text as T

    assert apply(spark, T.clean_message, ["feat: 5 K units"]) == ["feat: 5 K units"]


def test_dedup_null_keys_keep_first(spark):
    from diffcorpus.operators import curate

    df = spark.createDataFrame(
        [(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "row_id BIGINT, diff STRING"
    )
    assert sorted(r.row_id for r in curate.dedup_keep_first(df).collect()) == [1, 2, 5]


def test_compare_runs_wide(spark):
    df = spark.createDataFrame(
        [("a", True, True), ("a", False, False), ("b", True, False)], "run_id STRING, conventional BOOLEAN, exact_match BOOLEAN"
    )
    row = scoring.compare_runs(df, wide=True, runs=["a", "b"]).first().asDict()
    assert (row["a_n"], row["a_conventional"], row["a_exact"], row["b_n"], row["b_exact_rate"]) == (2, 1, 1, 1, 0.0)


def test_random_split_boundaries(spark):
    for n, want in ((1, {"test": 1}), (2, {"train": 1, "test": 1}), (10, {"train": 8, "valid": 1, "test": 1}),
                    (19, {"train": 15, "valid": 1, "test": 3})):
        df = _commits(spark, [None] * n)
        got = {r[0]: r[1] for r in splits.split_random(df).groupBy("split").count().collect()}
        assert got == want, n
    assert splits.sample_n(_commits(spark, ["x"] * 5), 0).count() == 0
    assert scoring.eval_subset(_commits(spark, ["x"] * 5), 0).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

TURN = st.tuples(
    st.integers(0, 2),
    st.sampled_from(["user", "user", "assistant", "system"]),
    st.sampled_from(["r", " R ", "q", "Q ", "hi", "  ", "", "ok then", " x "]),
)


@settings(max_examples=8, deadline=None)
@given(st.lists(TURN, min_size=1, max_size=30))
def test_contexts_match_duckdb_on_random_conversations(spark, turns):
    import duckdb
    import pandas as pd

    import __spark_entry__ as E

    rows = [(conv, i, role, text) for i, (conv, role, text) in enumerate(turns)]
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "int64", "turn": "int64"})
    df = spark.createDataFrame(pdf)
    got = sorted(
        (r.conv_id, r.turn, r.m)
        for r in contexts.conversation_contexts(df).select("conv_id", "turn", F.to_json("messages").alias("m")).collect()
    )
    con = duckdb.connect()
    con.register("conversations", pdf)
    want = sorted(tuple(r) for r in con.execute(E.oracle_sql()["conversation_contexts"]).fetchall())
    assert got == want


PIECES = st.sampled_from(
    ["feat", "fix(core)", ": ", "docs", "Fixes", "closes", " #12", "#", "signed-off-by:", "Signed-Off-By:", " ", "\n",
     "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", "　", "\xa0", "www.", "HTTP://", "a", "Body", "  ", "\t", "(",
     ")", "!", "ci", "Update", "1", "٣"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=16).map("".join), min_size=1, max_size=50))
def test_cleaning_matches_duckdb_on_random_messages(spark, messages):
    import duckdb
    import pandas as pd

    import oracle_sql as O
    from diffcorpus.functions import text as T

    pdf = pd.DataFrame({"i": range(len(messages)), "m": messages}).astype({"i": "int64"})
    got = sorted(
        tuple(r)
        for r in spark.createDataFrame(pdf)
        .select("i", T.clean_message("m").alias("c"), T.strip_footers("m").alias("f"), T.has_noise("m").alias("n"))
        .collect()
    )
    con = duckdb.connect()
    con.register("msgs", pdf)
    sql = f"SELECT i, {O.clean('m')} AS c, {O.strip_footers('m')} AS f, {O.noise('m')} AS n FROM msgs"
    want = sorted(tuple(r) for r in con.execute(sql).fetchall())
    assert got == want


@settings(max_examples=6, deadline=None)
@given(
    st.sets(st.integers(0, 2**40), min_size=1, max_size=400),
    st.integers(0, 450),
    st.integers(0, 10**6),
)
def test_ranks_match_duckdb_on_random_ids(spark, ids, n, seed):
    import duckdb
    import pandas as pd

    from diffcorpus.config import DEFAULT
    import dataclasses

    from diffcorpus.operators import ranking

    pdf = pd.DataFrame({"row_id": sorted(ids)}).astype({"row_id": "int64"})
    df = spark.createDataFrame(pdf)
    cfg = dataclasses.replace(DEFAULT, seed=seed)
    got_split = sorted(tuple(r) for r in splits.split_random(df, cfg).select("row_id", "split").collect())
    got_sample = sorted(tuple(r) for r in splits.sample_n(df, n, seed).collect())
    keyed = df.withColumn("k", ranking.seeded_key("row_id", seed))
    got_rank = sorted(tuple(r) for r in ranking.global_rank(keyed, ["k", "row_id"], ranking.hex_bucket("k", 2)).select("row_id", "rank").collect())
    con = duckdb.connect()
    con.register("ids", pdf)
    ranked = f"SELECT row_id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS rk, count(*) OVER () AS c FROM ids"
    want_split = sorted(con.execute(
        f"""SELECT row_id, CASE WHEN rk < CAST(floor(c * 0.8) AS BIGINT) THEN 'train'
            WHEN rk < CAST(floor(c * 0.8) AS BIGINT) + CAST(floor(c * 0.1) AS BIGINT) THEN 'valid' ELSE 'test' END
            FROM ({ranked})"""
    ).fetchall())
    want_sample = sorted(con.execute(f"SELECT row_id, rk FROM ({ranked}) WHERE rk < {n}").fetchall())
    want_rank = sorted(con.execute(f"SELECT row_id, rk FROM ({ranked})").fetchall())
    assert got_split == want_split and got_sample == want_sample and got_rank == want_rank


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(1, 50), max_size=12), st.integers(0, 15)), min_size=1, max_size=40),
    st.integers(1, 10),
)
def test_mask_labels_match_duckdb_on_random_arrays(spark, rows, max_len):
    import duckdb
    import pandas as pd

    from diffcorpus.operators import sequences

    pdf = pd.DataFrame({"i": range(len(rows)), "ids": [r[0] for r in rows], "p": [r[1] for r in rows]})
    df = spark.createDataFrame(pdf, "i BIGINT, ids ARRAY<INT>, p INT")
    got = sorted(
        (r.i, list(r.m.input_ids), list(r.m.attention_mask), list(r.m.labels))
        for r in df.select("i", sequences.mask_labels("ids", "p", max_len).alias("m")).collect()
    )
    con = duckdb.connect()
    con.register("t", pdf)
    want = sorted(
        (r[0], list(r[1]), list(r[2]), list(r[3]))
        for r in con.execute(
            f"""SELECT i, ids[1:{max_len}] AS full_ids,
                   list_transform(ids[1:{max_len}], lambda x: 1),
                   list_concat(list_transform(range(least(p, len(ids[1:{max_len}]))), lambda x: -100),
                               ids[1:{max_len}][least(p, len(ids[1:{max_len}])) + 1:])
                FROM t"""
        ).fetchall()
    )
    assert got == want
