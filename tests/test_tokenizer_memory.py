"""User tokenizers get bounded blocks of text and return ids in bounded memory (Q2)."""

from pyspark.sql import functions as F

from diffcorpus.operators import sequences
from diffcorpus.operators.tokenizers import UdfTokenizer


def test_a_batch_is_encoded_a_block_at_a_time(spark):
    """Every text's ids are the characters and texts that its call of ``encode`` got."""
    rows = [(i, "x" * 3_000) for i in range(1_200)] + [(1_200, "y" * (sequences.ENCODE_CHARS + 5)), (1_201, ""), (1_202, "z")]
    df = spark.createDataFrame(rows, "row_id long, t string").coalesce(1)

    def encode(texts):
        return [[sum(map(len, texts)), len(texts), len(t)] for t in texts]

    got = {r.row_id: r.ids for r in sequences.tokenize(df, "t", encode, "ids").collect()}
    assert {k: v[2] for k, v in got.items()} == {i: len(t) for i, t in rows}
    assert all(total <= sequences.ENCODE_CHARS or n == 1 for total, n, _ in got.values())
    assert max(n for _, n, _ in got.values()) > 100


def test_limit_counts_and_nulls(spark):
    tok = UdfTokenizer(lambda texts: [None if t is None else [ord(c) for c in t] for t in texts], 0, 3)
    df = spark.createDataFrame([(1, "abcde"), (2, None), (3, "")], "row_id long, t string")
    out = df.select("row_id", tok.ids(F.col("t"), 2).alias("cut"), tok.ids(F.col("t")).alias("ids"), tok.count(F.col("t")).alias("n"), F.size(F.lit(None).cast("array<int>")).alias("none"))
    got = {r.row_id: (r.cut, r.ids, r.n) for r in out.collect()}
    assert got == {1: ([97, 98], [97, 98, 99, 100, 101], 5), 2: (None, None, out.first().none), 3: ([], [], 0)}
