"""Counts that the writing jobs make on the way (A1)."""

from pyspark.sql import Observation

from diffcorpus.config import DEFAULT
from diffcorpus.functions import chat as C
from diffcorpus.operators.tokenizers import UdfTokenizer
from diffcorpus.plans import prepare as P
from diffcorpus.plans import sequences as S


def test_counts_of_long_diffs_and_masked_sequences(spark, tmp_dir):
    limit = DEFAULT.max_diff_chars
    rows = [(i, "d" * n, f"fix: number {i}") for i, n in enumerate((30, limit, limit + 1, 2 * limit, 40))]
    df = spark.createDataFrame(rows, "row_id long, diff string, message string")
    counts = P.prepare_to_jsonl(df.withColumn("diff", df.diff), tmp_dir + "/out")
    assert counts["rows"] == 5 and counts["truncated_diffs"] == 2
    assert counts["train"] + counts["valid"] + counts["test"] == 5

    chat = df.select("row_id", C.chat_example("diff", "message").alias("messages"))
    for tokenizer in (S.CodepointTokenizer(), UdfTokenizer(lambda texts: [[ord(c) for c in t] for t in texts], 0, 3)):
        seen = Observation()
        out = S.seeded_batches(chat, tokenizer=tokenizer, counts=seen)
        assert seen.get == {"sequences": 5, "cut_sequences": 3, "all_masked": 3}
        assert sum(all(x == -100 for x in r.labels) for r in out.collect()) == 3
