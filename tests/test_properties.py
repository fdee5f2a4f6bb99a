"""Properties: dedup, splits, sequences; invariance to input partitioning."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SF01, one_col
from diffcorpus.functions import text as T
from diffcorpus.operators import curate, ranking, scoring, sequences, splits
from diffcorpus.plans import prepare as P
from diffcorpus.plans import sequences as S
from diffcorpus.sources import driver_tables as dt

TRICKY = "ab :#\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000\t ſıKfixesignd-oby1١"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=TRICKY, max_size=30), min_size=1, max_size=40))
def test_strip_splitlines_match_python(spark, values):
    df = one_col(spark, values).orderBy("i")
    rows = df.select(T.py_strip("s").alias("a"), T.py_splitlines("s").alias("b"), T.is_blank("s").alias("c")).collect()
    for v, r in zip(values, rows):
        assert r.a == v.strip()
        got = r.b[:-1] if r.b and r.b[-1] == "" and v and v.splitlines() != r.b else r.b
        assert [x for x in got if x] == [x for x in v.splitlines() if x]
        assert r.c == (not v.strip())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=TRICKY, max_size=40), min_size=1, max_size=40))
def test_clean_is_null_or_conventional(spark, values):
    rows = one_col(spark, values).select(T.clean_message("s").alias("c")).collect()
    cleaned = [r.c for r in rows if r.c is not None]
    if cleaned:
        ok = one_col(spark, cleaned).select(T.is_conventional("s").alias("k"), T.clean_message("s").alias("again")).collect()
        assert all(r.k for r in ok)


def test_dedup_unique_subset(spark):
    base = curate.basic_filters(dt.commits(spark, SF01))
    out = curate.dedup_keep_first(base)
    assert out.count() == out.select("diff").distinct().count() == base.select("diff").distinct().count()
    firsts = base.groupBy("diff").agg(F.min("row_id").alias("row_id"))
    assert out.select("row_id").exceptAll(firsts.select("row_id")).count() == 0


def test_random_split_exact_and_disjoint(spark):
    clean = curate.curate(dt.commits(spark, SF01)).drop("split")
    out = splits.split_random(clean)
    n = clean.count()
    counts = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert counts["train"] == int(n * 0.8) and counts["valid"] == int(n * 0.1)
    assert sum(counts.values()) == n == out.select("row_id").distinct().count()


def test_global_rank_matches_single_sort(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "row_id").withColumn("k", ranking.seeded_key("row_id", 7))
    b = ranking.hex_bucket("k")
    got = {r.row_id: r.rank for r in ranking.global_rank(df, ["k", "row_id"], b).collect()}
    want = {rid: i for i, (k, rid) in enumerate(sorted((r.k, r.row_id) for r in df.collect()))}
    assert got == want
    cuts = ranking.cut_points(df, ["k", "row_id"], [0, 1500, 2999, 3000], b)
    order = sorted((r.k, r.row_id) for r in df.collect())
    assert cuts == [order[0], order[1500], order[2999], None]


def test_range_rank_and_prefix_sum(spark):
    ids = sorted({i * i % 100_003 for i in range(1, 4000)})
    df = spark.createDataFrame([(x, x % 7, f"n{x:06d}") for x in ids], "row_id BIGINT, v BIGINT, name STRING").repartition(5)
    got = {r.row_id: r.rank for r in ranking.range_rank(df, ["row_id"]).collect()}
    assert got == {v: i for i, v in enumerate(ids)}
    sums, total = {}, 0
    for x in ids:
        sums[x], total = total, total + x % 7
    for col in ("row_id", "name"):
        assert {r.row_id: r.before for r in ranking.prefix_sum(df, [col], "v", "before").collect()} == sums
    none = df.limit(0)
    assert ranking.range_rank(none, ["row_id"]).count() == ranking.prefix_sum(none, ["row_id"], "v", "s").count() == 0


def test_first_rows_of_any_orderable_type(spark):
    """Ids whose order number ties or is negative: texts with a long common start, dates, decimals, structs."""
    df = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") * 7919 % 3000 - 1500).alias("k"))
    df = df.select(
        "k",
        F.format_string("a long common start %05d", F.col("k") + 1500).alias("text"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("k").cast("int")).alias("day"),
        F.timestamp_micros(F.col("k") * 1_000_003).alias("at"),
        (F.col("k") / 7).cast("decimal(20,6)").alias("dec"),
        F.struct(F.col("k").alias("x")).alias("s"),
        (F.col("k") + (1 << 60)).alias("large"),
    )
    for col in ("k", "text", "day", "at", "dec", "s", "large"):
        for n in (40, 3000) if col != "k" else (0, 1, 40, 2999, 5000):
            got = {r.k: r.subset_pos for r in scoring.eval_subset(df, n, col).select("k", "subset_pos").collect()}
            assert got == {k: k + 1500 for k in range(-1500, -1500 + min(n, 3000))}, (col, n)


def test_sample_and_subset_are_the_same_at_every_size(spark):
    """One plan: types do not change with ``n``, a small choice is the start of a larger one, ids may be text."""
    clean = curate.curate(dt.commits(spark, SF01)).withColumn("name", F.format_string("id%08d", "row_id"))
    for key in ("row_id", "name"):
        ids = sorted(r[0] for r in clean.select(key).collect())
        types, chosen = set(), []
        for n in (3, 60, 10**7):
            sub, smp = scoring.eval_subset(clean, n, key), splits.sample_n(clean, n, order_col=key)
            types.add((sub.schema["subset_pos"].dataType.simpleString(), smp.schema["sample_pos"].dataType.simpleString()))
            assert sorted((r.subset_pos, r[key]) for r in sub.collect()) == list(enumerate(ids[:n]))
            chosen.append([r[key] for r in sorted(smp.collect(), key=lambda r: r.sample_pos)])
        assert types == {("bigint", "bigint")}
        assert chosen[1][:3] == chosen[0] and chosen[2][:60] == chosen[1] and sorted(chosen[2]) == ids
    with pytest.raises(Exception, match="is null"):
        splits.sample_n(clean.withColumn("row_id", F.lit(None).cast("long")), 3).collect()


def test_sequence_lengths_and_padding(spark):
    prepared = P.prepare(dt.commits(spark, SF01))
    toks = S.tokenized(prepared)
    bad = toks.where(
        (F.size("input_ids") != F.size("labels")) | (F.size("input_ids") != F.size("attention_mask")) | (F.size("input_ids") > 2048)
    )
    assert bad.count() == 0
    out = S.build_sequences(prepared)
    widths = out.groupBy("dataset", "batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"), F.count("*").alias("n"))
    assert widths.where("w <> 1 OR n > 2").count() == 0
    assert out.where(F.col("dataset") == "eval").count() == 50


def test_mask_labels_edge_cases(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2), ([1, 2], 5), ([], 0), ([5, 6, 7], 0)], "ids ARRAY<INT>, p INT")
    rows = df.select(sequences.mask_labels("ids", "p", 3).alias("m")).select("m.*").collect()
    assert [r.input_ids for r in rows] == [[1, 2, 3], [1, 2], [], [5, 6, 7]]
    assert [r.labels for r in rows] == [[-100, -100, 3], [-100, -100], [], [5, 6, 7]]
    assert [r.attention_mask for r in rows] == [[1, 1, 1], [1, 1], [], [1, 1, 1]]
    assert sequences.effective_pad_id(0, 3) == 3 and sequences.effective_pad_id(None, 3) == 3 and sequences.effective_pad_id(5, 3) == 5


def test_tokenize_codepoints_astral_and_empty(spark):
    df = one_col(spark, ["a\U0001F600b", ""])
    rows = df.orderBy("i").select(sequences.tokenize_codepoints("s").alias("t")).collect()
    assert [r.t for r in rows] == [[97, 0x1F600, 98], []]


def test_partitioning_invariance(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        base = dt.commits(spark, SF01)
        a = {tuple(r) for r in P.prepare(base.repartition(1)).select("row_id", "split").collect()}
        b = {tuple(r) for r in P.prepare(base.repartition(7)).select("row_id", "split").collect()}
        c = {tuple(r) for r in P.prepare(base.drop("split")).select("row_id", "split").collect()}
        d = {tuple(r) for r in P.prepare(base.drop("split").repartition(5)).select("row_id", "split").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b and len(a) == 392
    assert c == d and len(c) == 437


def test_seeded_batches_equal_window_padding(spark):
    from diffcorpus.config import DEFAULT
    import dataclasses

    prepared = P.prepare(dt.commits(spark, SF01)).where(F.col("split") == "train")
    cols = ["row_id", "batch_id", "pos", "input_ids", "attention_mask", "labels"]
    for digits in (1, 2, 4):
        for size in (1, 2, 3, 7):
            cfg = dataclasses.replace(DEFAULT, batch_size=size, max_seq_length=700)
            ranked = sequences.seeded_rank(prepared, cfg.seed)
            slow = sorted(map(tuple, sequences.pad_batches(S.tokenized(ranked, cfg), size, 3).select(*cols).collect()))
            fast = S.seeded_batches(prepared, cfg, digits=digits)
            assert sorted(map(tuple, fast.select(*cols).collect())) == slow


def test_tokenize_wrapper_and_attention_mask(spark):
    df = one_col(spark, ["ab", "a b c"])
    got = sequences.tokenize(df, "s").orderBy("i").select("input_ids", sequences.attention_mask("input_ids").alias("m")).collect()
    assert [r.input_ids for r in got] == [[97, 98], [97, 32, 98, 32, 99]]
    assert [r.m for r in got] == [[1, 1], [1, 1, 1, 1, 1]]
    words = sequences.tokenize(df, "s", lambda texts: [[len(w) for w in t.split()] for t in texts]).orderBy("i").collect()
    assert [r.input_ids for r in words] == [[2], [1, 1, 1]]


def test_build_sequences_with_udf_tokenizer(spark):
    import dataclasses

    from diffcorpus.config import DEFAULT

    def encode(texts):
        return [[len(w) % 97 + 1 for w in t.split()] for t in texts]

    prepared = P.prepare(dt.commits(spark, SF01))
    tok = S.UdfTokenizer(encode, pad_id=0, eos_id=5)
    cfg = dataclasses.replace(DEFAULT, batch_size=3, max_seq_length=300)
    out = S.build_sequences(prepared, cfg, tokenizer=tok)
    widths = out.groupBy("dataset", "batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"))
    assert widths.where("w <> 1").count() == 0
    assert out.where(F.size("input_ids") != F.size("labels")).count() == 0
    train = prepared.where(F.col("split") == "train")
    slow = sequences.pad_batches(S.tokenized(sequences.seeded_rank(train, cfg.seed), cfg, tokenizer=tok), 3, 5)
    cols = ["row_id", "batch_id", "pos", "input_ids", "attention_mask", "labels"]
    fast = out.where(F.col("dataset") == "train")
    assert sorted(map(tuple, fast.select(*cols).collect())) == sorted(map(tuple, slow.select(*cols).collect()))


MSG_ALPHABET = st.sampled_from(
    ["feat", "fix(x)", ": ", "docs", "Fixes", " #12", "signed-off-by:", " ", "\n", "\r\n", "\u2028", "www.", "http://",
     "a", "B", "  ", "\t", "(", ")", "!", "ci", "Closes #3", "\x1c", "ſ"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(MSG_ALPHABET, max_size=14).map("".join), min_size=1, max_size=60))
def test_clean_message_invariants(spark, values):
    import re

    rows = one_col(spark, values).orderBy("i").select(
        T.clean_message("s").alias("c"), T.has_noise("s").alias("noise")
    ).collect()
    cleaned = [r.c for r in rows if r.c is not None]
    checks = one_col(spark, cleaned).orderBy("i").select(
        T.is_conventional("s").alias("conv"), T.has_noise("s").alias("noise"), T.strip_footers("s").alias("sf")
    ).collect() if cleaned else []
    k = 0
    for v, r in zip(values, rows):
        if r.c is None:
            continue
        chk = checks[k]
        k += 1
        assert not r.noise and chk.conv and not chk.noise
        lines = r.c.split("\n")
        assert len(lines) in (1, 4) or (len(lines) == 3 and lines[1] == "")
        if len(lines) > 1:
            assert lines[1] == "" and all(ln.strip() for ln in lines[2:])
        assert chk.sf == r.c.strip()  # no footer left to strip
        kept = [ln for ln in re.split(r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", v) if ln.strip()]
        body = [ln for ln in lines if ln]
        assert all(any(b.strip() == x.strip() for x in kept) for b in body)


def test_no_diff_in_two_splits(spark):
    for drop_split in (False, True):
        base = dt.commits(spark, SF01)
        prepared = P.prepare(base.drop("split") if drop_split else base)
        raw = prepared.select("row_id", "split").join(base.select("row_id", "diff"), "row_id")
        per_diff = raw.groupBy("diff").agg(F.countDistinct("split").alias("n"), F.count("*").alias("rows"))
        assert per_diff.where("n > 1 OR rows > 1").count() == 0
