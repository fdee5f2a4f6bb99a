import os
import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from diffcorpus.llm import pieces
from diffcorpus.llm.queries import PIECES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no model file")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(PIECES)


@pytest.fixture(scope="module")
def unigram():
    """The same pieces and scores in the library's own unigram model."""
    bpe = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if not (bpe.is_byte(i) or bpe.is_control(i) or bpe.is_unknown(i)):
            p.score = -np.log(2.0 - p.score)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), [p.score for p in model.pieces]


def split(texts, vocab):
    ids, per = pieces.encode_texts(texts, vocab)
    ends = np.cumsum(per)
    return [ids[a:b].tolist() for a, b in zip(ends - per, ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" ▁ab\n", max_size=30)), max_size=6))
def test_round_trip(vocab, texts):
    assert [pieces.decode_ids(np.array(i), vocab) for i in split(texts, vocab)] == [t or "" for t in texts]


def test_best_score_equals_the_library(spark, vocab, unigram):
    library, score = unigram
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()] + ["", " ", "  two   spaces ", "x" * 500]
    for text, ids in zip(texts, split(texts, vocab)):
        want = library.encode(text)
        if ids != want:  # another path of the same score
            assert abs(sum(score[i] for i in ids) - sum(score[i] for i in want)) < 1e-2 and library.decode(ids) == library.decode(want)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="therin g", min_size=1, max_size=9))
def test_viterbi_equals_all_segmentations(vocab, text):
    by_key = {int(k): (int(i), float(s)) for k, i, s in zip(vocab.keys, vocab.ids, vocab.scores)}
    raw = (b" " + text.encode()).replace(b" ", pieces.MARK)
    best = [0.0] + [-1e300] * len(raw)
    data = np.frombuffer(raw, np.uint8)
    for b in range(1, len(raw) + 1):
        best[b] = best[b - 1] + vocab.byte_score
        for a in range(b):
            key = int(pieces.T.hash_spans(data, np.array([a]), np.array([b]))[0])
            if key in by_key:
                best[b] = max(best[b], best[a] + by_key[key][1])
    score = {i: s for i, s in by_key.values()}
    assert abs(sum(score.get(i, vocab.byte_score) for i in split([text], vocab)[0]) - best[-1]) < 1e-9


def test_odd_rows_and_query(spark, odd, empty):
    out = pieces.decode(pieces.encode(odd, PIECES), PIECES)
    assert out.where("NOT (text <=> decoded)").count() == 0 and out.count() == odd.count()
    assert set(out.columns) == set(odd.columns) and out.where("text IS NULL AND ids IS NOT NULL").count() == 0
    assert out.where("text = '' AND size(ids) > 0").count() == 0
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).count() == 0
    none = spark.createDataFrame([([5000, None, -3, 10**8],)], "ids array<int>")
    assert pieces.decode(none, PIECES).first().decoded is not None
    got = QUERIES["op6_sentencepiece"](spark, SF)
    assert got.where("NOT round_trip OR n_ids = 0").count() == 0 and got.count() == 200


def test_long_words_by_positions_give_the_same_ids(vocab):
    """Texts without spaces: words of every size by both searches, literal marks too; a megabyte takes seconds."""
    rng = random.Random(9)
    texts = ["日本語のテキスト" * 30, "a" * 700, "x▁" * 90, " " * 300 + "y", "".join(rng.choices("abcdefgh/+=", k=900)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(250)), None, ""]
    texts += ["".join(rng.choices("abcdeé▁ \n日", k=rng.randint(1, 300))) for _ in range(60)]
    both = []
    for cost in (0, 1 << 60):
        pieces.STEP_COST, usual = cost, pieces.STEP_COST
        try:
            both.append(pieces.encode_texts(texts, vocab))
        finally:
            pieces.STEP_COST = usual
    assert (both[0][0] == both[1][0]).all() and (both[0][1] == both[1][1]).all()
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "日本語文字列検索"):
        text = "".join(rng.choices(alphabet, k=1_000_000 // len(alphabet[0].encode())))
        start = time.time()
        ids, per = pieces.encode_texts([text], vocab)
        assert time.time() - start < 60 and per[0] == len(ids) and pieces.decode_ids(ids, vocab) == text


def test_a_model_with_a_piece_across_a_space_is_refused(tmp_path):
    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[5000].piece = "of▁the"
    path = str(tmp_path / "across.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError, match="space after another"):
        pieces.load(path)
