"""Q2 with public byte-level vocabularies, against their own library."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from helpers import SF001, SF01
from diffcorpus.operators import sequences
from diffcorpus.operators.bpe import LONG_PIECE, PATTERN, BpeTokenizer, ByteBpe
from diffcorpus.plans import prepare as P
from diffcorpus.plans import sequences as S
from diffcorpus.sources import driver_tables as dt

VOCABULARIES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


def library(path):
    with open(path, "rb") as f:
        ours = ByteBpe(f.read())
    return ours, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@pytest.mark.parametrize("path", VOCABULARIES)
def test_ids_equal_the_library(spark, path):
    ours, theirs = library(path)
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").where("text IS NOT NULL").collect()]
    texts += ["", " ", "\n\n  x", "a" * 5000, "ab" * LONG_PIECE, "日本語" * 300, "😀🏳️‍🌈 é", "don't WE'LL it's", "\x00\x1f\x7f", "".join(rng.choices("abcdef", k=20_000))]
    texts += ["".join(rng.choices("abc deé\n", k=rng.randint(1, 3 * LONG_PIECE))) for _ in range(300)]
    got = ours.encode([*texts, None])
    assert got[-1] is None and got[:-1] == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(ids) for ids in got[:-1]] == texts


def test_column_and_nulls(spark):
    tok = BpeTokenizer(VOCABULARIES[0])
    df = spark.createDataFrame([(1, "fix: the bug"), (2, None), (3, "")], "row_id long, t string")
    got = {r.row_id: r.ids for r in sequences.tokenize(df, "t", tok.encode, "ids").collect()}
    assert got == {1: library(VOCABULARIES[0])[1].encode_ordinary("fix: the bug"), 2: None, 3: []}
    with pytest.raises(ValueError, match="not a byte-level"):
        ByteBpe(b"YQ== 0\n")
    with pytest.raises(ValueError, match="more than"):
        BpeTokenizer(VOCABULARIES[0], max_bytes=100)


def test_sequences_with_subwords(spark):
    """Ids, masked prompt and padding of whole batches, recomputed with the library."""
    chat = P.prepare(dt.commits(spark, SF01))
    theirs = library(VOCABULARIES[0])[1]
    out = S.build_sequences(chat, tokenizer=BpeTokenizer(VOCABULARIES[0])).collect()
    texts = {
        r.row_id: (r.full, r.prompt)
        for r in chat.select("row_id", S.render_chat("messages").alias("full"), S.render_chat(S.prompt_messages("messages"), add_generation_prompt=True).alias("prompt")).collect()
    }
    assert len(out) > 200
    widths = {}
    for r in out:
        full, prompt = (theirs.encode_ordinary(t) for t in texts[r.row_id])
        full = full[:2048]
        n, p = len(full), min(len(prompt), len(full))
        pad = len(r.input_ids) - n
        assert r.input_ids == full + [50256] * pad and r.attention_mask == [1] * n + [0] * pad
        assert r.labels == [-100] * p + full[p:] + [-100] * pad
        widths.setdefault((r.dataset, r.batch_id), []).append((len(r.input_ids), n))
    assert all(len({w for w, _ in v}) == 1 and max(n for _, n in v) == v[0][0] for v in widths.values())
