"""

Every query reads the driver tables (whole tables, whole texts) through the
commit-shaped views of ``diffcorpus.sources.driver_tables``.  Array and chat
outputs are returned as compact JSON text so both engines compare as strings.
"""

from __future__ import annotations

import functools
import os
import sys
import tempfile
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_sql as O  # noqa: E402
from diffcorpus.config import DEFAULT  # noqa: E402
from diffcorpus.functions import chat as C  # noqa: E402
from diffcorpus.functions import text as T  # noqa: E402
from diffcorpus.functions.register import register  # noqa: E402
from diffcorpus.functions.templates import CHATML_WITH_DEFAULT, INST, ModelTemplate  # noqa: E402
from diffcorpus.operators.bpe import BpeTokenizer  # noqa: E402
from diffcorpus.operators import contexts, curate, generation, ranking, scoring, sequences, splits  # noqa: E402
from diffcorpus.plans import evaluate as E  # noqa: E402
from diffcorpus.plans import prepare as P  # noqa: E402
from diffcorpus.plans import sequences as S  # noqa: E402
from diffcorpus.session import checkpoint_root  # noqa: E402
from diffcorpus.sources import chat_jsonl as J  # noqa: E402
from diffcorpus.sources import commits as SC  # noqa: E402
from diffcorpus.sources import driver_tables as dt  # noqa: E402
from diffcorpus.streaming.curate import stream_curate  # noqa: E402
from diffcorpus.streaming.prompts import prompts_and_refused, stream_prompts  # noqa: E402

# The training-data operators live in one subpackage that nothing else needs.
try:
    import corpus_pipeline
    from diffcorpus.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "diffcorpus.llm"):
        raise
    corpus_pipeline = llm_queries = None

FLAGSHIP_SF = "/root/testdata/sf0.001"
#: A public byte-level vocabulary; any in the same form will do.
BPE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _commits(spark, sf):
    return SC.check_columns(dt.commits(spark, sf), ["diff", "message"])


def _clean(spark, sf):
    return curate.curate(_commits(spark, sf))


def _prepared(spark, sf):
    return P.prepare(_commits(spark, sf))


def _gold_test(spark, sf):
    return E.gold_rows(_prepared(spark, sf).where(F.col("split") == "test"))


def _scored(spark, sf):
    return scoring.score(scoring.pair(_gold_test(spark, sf), dt.predictions(spark, sf)))


def _json(col: str) -> F.Column:
    return F.to_json(F.col(col)).alias(col)


def _conversations_as_chats(spark, sf):
    conv = dt.table(spark, sf, "conversations")
    arr = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return conv.groupBy("conv_id").agg(
        F.transform(arr, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")
    )


def _structured(spark, sf):
    return dt.structured_commits(spark, sf)


# --- queries -----------------------------------------------------------------

def _fresh(spark, name):
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df, name, key):
    """``df`` as Parquet files whose order, and that of their rows, is the order of ``key``."""
    path = _fresh(df.sparkSession, name)
    SC.write_commits(df.repartitionByRange(key).sortWithinPartitions(key), path)
    return path


def q_read_commits(spark, sf):
    """Ids in input order, shown as places."""
    path = _written(_commits(spark, sf).withColumnRenamed("row_id", "key"), "commits", "key")
    df = SC.read_commits(spark, path)
    places = ranking.range_rank(df.select("row_id"), ["row_id"], "place")
    return df.join(places, "row_id").select(F.col("key").alias("row_id"), "place", "diff", "message", "split")


def q_write_commits(spark, sf):
    path = _fresh(spark, "combined")
    SC.write_commits(_commits(spark, sf), path)
    return SC.read_commits(spark, path).select("row_id", "diff", "message", "split")


def q_union_splits(spark, sf):
    """Every value of ``split``, also one not foreseen, is in one part."""
    c = _commits(spark, sf)
    known = ("train", "val", "validation", "test")
    parts = [c.where(F.col("split") == s) for s in known] + [c.where(~F.coalesce(F.col("split").isin(*known), F.lit(False)))]
    return SC.union_splits(parts).select("row_id", "diff", "message", "split")


def q_filter_nulls(spark, sf):
    return curate.drop_null(_commits(spark, sf), ["diff", "message"]).select("row_id", "diff", "message", "split")


def q_filter_diff_len(spark, sf):
    df = curate.drop_null(_commits(spark, sf), ["diff", "message"])
    return curate.min_len(df, "diff", DEFAULT.min_diff_len).select("row_id")


def q_filter_msg_len(spark, sf):
    return curate.basic_filters(_commits(spark, sf)).select("row_id", "message")


def q_has_noise(spark, sf):
    c = dt.messages(spark, sf).where(F.col("message").isNotNull())
    return c.select("row_id", T.has_noise("message").alias("has_noise"))


def q_is_conventional(spark, sf):
    c = dt.messages(spark, sf).where(F.col("message").isNotNull())
    return c.select("row_id", T.is_conventional("message").alias("is_conventional"))


def q_clean_messages(spark, sf):
    return _clean(spark, sf).select("row_id", "message")


def q_non_blank(spark, sf):
    return curate.non_blank(dt.table(spark, sf, "conversations"), "text").select("conv_id", "turn")


def q_valid_commit_type(spark, sf):
    return _structured(spark, sf).select("row_id", "type", T.valid_type("type").alias("valid"))


def q_dedup_keep_first(spark, sf):
    df = curate.basic_filters(_commits(spark, sf))
    return curate.dedup_keep_first(df, "diff", "row_id").select("row_id", "message")


def q_py_strip(spark, sf):
    conv = dt.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", T.py_strip("text").alias("stripped"))


def q_subject_line(spark, sf):
    return dt.messages(spark, sf).select("row_id", T.subject_line("message").alias("subject"))


def q_strip_footers(spark, sf):
    return dt.messages(spark, sf).select("row_id", T.strip_footers("message").alias("stripped"))


def q_truncate_diff(spark, sf):
    return _commits(spark, sf).select("row_id", T.truncate_diff("diff").alias("diff"))


def q_user_message(spark, sf):
    return _commits(spark, sf).select("row_id", T.user_message("diff").alias("user_message"))


def q_extract_diff(spark, sf):
    c = _commits(spark, sf)
    return c.select(
        "row_id",
        T.extract_diff(T.user_message("diff")).alias("round_trip"),
        T.extract_diff("diff").alias("from_raw"),
    )


def q_norm_match(spark, sf):
    return dt.messages(spark, sf).select("row_id", T.norm_match("message").alias("normalized"))


def q_format_commit(spark, sf):
    s = _structured(spark, sf)
    return s.select("row_id", T.format_commit("type", "scope", "description").alias("formatted"))


def q_diff_preview(spark, sf):
    return _commits(spark, sf).select("row_id", T.preview("diff").alias("diff_preview"))


def q_chat_jsonl(spark, sf):
    p = _prepared(spark, sf)
    lines = J.chat_json(p, keep=("row_id", "split"))
    return lines.select("row_id", "split", "value")


def q_read_chat_jsonl(spark, sf):
    """S5 then S4: plain lines, records in input order."""
    path = _fresh(spark, "chat")
    J.write_chat_jsonl(_prepared(spark, sf).repartitionByRange("row_id").sortWithinPartitions("row_id"), path)
    return J.read_chat_jsonl(spark, path, id_col="place").select("place", _json("messages"))


def _split_files(spark, sf):
    path = _fresh(spark, "splits")
    J.write_splits(_prepared(spark, sf), path)
    return path


def q_jsonl_round_trip(spark, sf):
    """S6 then S7: the splits that were written are found again, with their ids."""
    path = _split_files(spark, sf)
    found = [J.read_split(spark, path, s, "row_id") for s in ("train", "valid", "test")]
    return SC.union_splits(found).select("row_id", "split", _json("messages"))


def q_evaluate_from_jsonl(spark, sf):
    test = J.read_split(spark, _split_files(spark, sf), "test", "row_id")
    return E.evaluate(test, dt.predictions(spark, sf)).summary


def _item_files(spark, sf):
    """The benchmark texts, each in a file of its own."""
    path = _fresh(spark, "items")
    dt.table(spark, sf, "benchmark").repartition("item_id").write.partitionBy("item_id").text(path)
    return f"{path}/item_id=*"


def _item_id():
    return F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id")


def q_read_diffs(spark, sf):
    return SC.read_diffs(spark, _item_files(spark, sf)).select(_item_id(), "diff")


def q_require_rows(spark, sf):
    return curate.require_rows(_clean(spark, sf)).select("row_id", "message")


def q_peek(spark, sf):
    return scoring.peek(_clean(spark, sf)).select("row_id", "message")


def q_sql_functions(spark, sf):
    """The text functions on whole document texts."""
    register(spark)
    dt.table(spark, sf, "documents").createOrReplaceTempView("sql_functions_documents")
    return spark.sql(
        """SELECT doc_id, py_subject_line(text) AS subject, py_is_conventional(text) AS conventional, py_has_noise(text) AS noise,
             py_truncate_diff(text) AS truncated, py_norm_match(text) AS norm, py_strip(text) AS stripped, py_is_blank(text) AS blank,
             py_strip_footers(text) AS footers, py_clean_message(text) AS clean, py_user_message(text) AS user_message,
             py_extract_diff(py_user_message(text)) AS extracted, py_diff_preview(text) AS preview,
             py_format_commit(lang, source, text) AS formatted, py_valid_commit_type(lang) AS valid FROM sql_functions_documents"""
    )


def q_sql_chat_functions(spark, sf):
    """The functions over arrays of structs, on the prepared commits."""
    register(spark)
    _prepared(spark, sf).select("row_id", C.parse_chat("messages").alias("p")).select("row_id", "p.*").createOrReplaceTempView("sql_functions_prepared")
    return spark.sql(
        f"""WITH made AS (SELECT row_id, py_chat_example(diff, gold) AS messages, py_inference_messages(diff) AS prompt FROM sql_functions_prepared),
        texts AS (SELECT *, py_render_chat(messages, false) AS full_text, py_render_chat(py_prompt_messages(messages), true) AS prompt_text, py_parse_chat(messages) AS parsed FROM made),
        masked AS (SELECT *, py_mask_labels(py_tokenize_codepoints(full_text), size(py_tokenize_codepoints(prompt_text)), {DEFAULT.max_seq_length}) AS seq FROM texts)
        SELECT row_id, to_json(messages) AS messages, to_json(prompt) AS prompt, parsed.diff, parsed.gold, full_text, prompt_text,
          to_json(seq.input_ids) AS input_ids, to_json(py_attention_mask(seq.input_ids)) AS attention_mask, to_json(seq.labels) AS labels FROM masked"""
    )


def q_sql_contexts(spark, sf):
    """C5 as a table function over each conversation's turns."""
    register(spark)
    dt.table(spark, sf, "conversations").createOrReplaceTempView("sql_functions_turns")
    return spark.sql(
        """SELECT c.conv_id, CAST(x.turn AS BIGINT) AS turn, to_json(x.messages) AS messages
        FROM (SELECT conv_id, collect_list(named_struct('turn', CAST(turn AS INT), 'role', role, 'text', text)) AS turns FROM sql_functions_turns GROUP BY conv_id) c,
        LATERAL py_contexts(c.turns) x"""
    )


def q_write_counts(spark, sf):
    """A1 beyond the funnel: what the jobs that write the splits and the training sequences counted on the way."""
    path, seen = _fresh(spark, "counted"), Observation("sequences")
    counts = P.prepare_to_jsonl(_commits(spark, sf), path)
    S.seeded_batches(J.read_split(spark, path, "train", id_col="row_id"), counts=seen)
    counts |= seen.get
    return spark.createDataFrame([tuple(counts.values())], [f"{name}_rows" if name in ("train", "valid", "test") else name for name in counts])


def _streamed(spark, sdf, name):
    """All that has arrived, through a real stream into files, read back."""
    out = _fresh(spark, name)
    sdf.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def q_stream_prompts(spark, sf):
    return _streamed(spark, stream_prompts(spark, _item_files(spark, sf)), "prompts").select(_item_id(), _json("messages"))


def q_stream_refused(spark, sf):
    """W1, both sinks: every fourth benchmark text arrives as a file of white space and is refused."""
    texts = F.when(F.col("item_id") % 4 == 1, F.lit(" \t")).otherwise(F.col("text"))
    path = _fresh(spark, "some-blank")
    dt.table(spark, sf, "benchmark").select("item_id", texts.alias("text")).repartition("item_id").write.partitionBy("item_id").text(path)
    out, refused = _fresh(spark, "prompts"), _fresh(spark, "refused")
    writer = prompts_and_refused(spark, f"{path}/item_id=*", out, refused)
    writer.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    good, bad = (spark.read.option("basePath", p).parquet(f"{p}/batch=*") for p in (out, refused))
    return good.select(_item_id(), F.lit(None).cast("string").alias("reason"), _json("messages")).unionByName(
        bad.select(_item_id(), "reason", F.lit(None).cast("string").alias("messages"))
    )


def q_evaluate_missing(spark, sf):
    """A run without a prediction for any sampled row is missing them all."""
    late = dt.predictions(spark, sf).join(_commits(spark, sf).where(F.col("split") == "train").select("row_id"), "row_id")
    preds = dt.predictions(spark, sf).unionByName(late.where("run_id = 'base'").withColumn("run_id", F.lit("late")))
    return E.evaluate(_prepared(spark, sf).where(F.col("split") == "test"), preds).missing


def _codepoints(texts):
    return [[ord(ch) for ch in t] for t in texts]


def q_tokenize_bpe(spark, sf):
    """Q2: sub-word ids of every diff by a public byte-level vocabulary; null for a null diff."""
    out = sequences.tokenize(_commits(spark, sf), "diff", BpeTokenizer(BPE_VOCABULARY).encode, "ids")
    return out.select("row_id", F.size("ids").cast("long").alias("n_tokens"), _json("ids"))


def q_build_sequences_bpe(spark, sf):
    """E3 with sub-word ids."""
    out = S.build_sequences(_prepared(spark, sf), tokenizer=BpeTokenizer(BPE_VOCABULARY))
    return out.select("dataset", "row_id", "batch_id", "pos", _json("input_ids"), _json("attention_mask"), _json("labels"))


def q_build_sequences_user_tokenizer(spark, sf):
    out = S.build_sequences(_prepared(spark, sf), tokenizer=S.UdfTokenizer(_codepoints, 0, 3))
    return out.select(
        "dataset", "row_id", "batch_id", "pos", _json("input_ids"), _json("attention_mask"), _json("labels")
    )


def q_chat_examples(spark, sf):
    c = _clean(spark, sf)
    return c.select("row_id", F.to_json(C.chat_example("diff", "message")).alias("messages"))


def q_inference_messages(spark, sf):
    c = _commits(spark, sf).where(F.col("diff").isNotNull())
    return c.select("row_id", F.to_json(C.inference_messages("diff")).alias("messages"))


def q_parse_chat(spark, sf):
    return E.gold_rows(_prepared(spark, sf)).select("row_id", "diff", "gold")


def q_prompt_messages(spark, sf):
    chats = _conversations_as_chats(spark, sf)
    return chats.select("conv_id", F.to_json(C.prompt_messages("messages")).alias("messages"))


def q_conversation_contexts(spark, sf):
    ctx = contexts.conversation_contexts(dt.table(spark, sf, "conversations"))
    return ctx.select("conv_id", "turn", _json("messages"))


def q_split_mode(spark, sf):
    return splits.split_mode(_clean(spark, sf))


def q_split_curated(spark, sf):
    return splits.split_curated(_clean(spark, sf)).select("row_id", "split")


def q_split_random(spark, sf):
    from diffcorpus.session import materialize

    clean = materialize(_clean(spark, sf).select("row_id"), "clean-ids")
    return splits.split_random(clean, DEFAULT, "row_id", "split").select("row_id", "split")


def q_sample_n(spark, sf):
    return splits.sample_n(_clean(spark, sf), DEFAULT.eval_n, DEFAULT.eval_seed).select("row_id", "sample_pos")


def q_split_values(spark, sf):
    return splits.split_values(_commits(spark, sf))


def q_filter_funnel(spark, sf):
    return curate.filter_funnel(_commits(spark, sf))


def q_split_counts(spark, sf):
    return splits.split_counts(_prepared(spark, sf))


def q_split_report(spark, sf):
    return splits.split_report(_clean(spark, sf))


def q_corpus_size(spark, sf):
    return splits.corpus_size(_prepared(spark, sf).where(F.col("split") == "train"), DEFAULT.small_corpus)


def q_pair_predictions(spark, sf):
    paired = scoring.pair(_gold_test(spark, sf), dt.predictions(spark, sf))
    return paired.select("run_id", "row_id", "gold", "prediction")


def q_missing_predictions(spark, sf):
    return scoring.missing_by_run(_gold_test(spark, sf).select("row_id"), dt.predictions(spark, sf)).select("run_id", "row_id")


def q_score_predictions(spark, sf):
    return _scored(spark, sf).select("run_id", "row_id", "conventional", "exact_match")


def q_eval_summary(spark, sf):
    return scoring.eval_summary(_scored(spark, sf))


def q_compare_runs(spark, sf):
    return scoring.compare_runs(_scored(spark, sf))


def q_eval_examples(spark, sf):
    test = _prepared(spark, sf).where(F.col("split") == "test")
    ev = E.evaluate(test, dt.predictions(spark, sf))
    return ev.examples


def q_eval_subset(spark, sf):
    valid = _prepared(spark, sf).where(F.col("split") == "valid")
    n = DEFAULT.val_batches * DEFAULT.batch_size
    return scoring.eval_subset(valid, n).select("row_id", "subset_pos")


def q_evaluate(spark, sf):
    test = _prepared(spark, sf).where(F.col("split") == "test")
    return E.evaluate(test, dt.predictions(spark, sf)).summary


def q_prepare(spark, sf):
    return _prepared(spark, sf).select("row_id", "split", _json("messages"))


def q_render_chat(spark, sf):
    p = _prepared(spark, sf)
    return p.select(
        "row_id",
        C.render_chat("messages").alias("full_text"),
        C.render_chat(C.prompt_messages("messages"), add_generation_prompt=True).alias("prompt_text"),
    )


def q_render_model_chat(spark, sf):
    """Q1 by two models' own templates; every other record goes without its system message."""
    p = _prepared(spark, sf).withColumn("messages", F.when(F.col("row_id") % 2 == 0, F.col("messages")).otherwise(F.slice("messages", 2, 2)))
    marks = ModelTemplate(CHATML_WITH_DEFAULT, {"default_system": "You are a helpful assistant."})
    brackets = ModelTemplate(INST, {"bos_token": "<s>", "eos_token": "</s>"})
    return p.select(
        "row_id",
        C.render_chat("messages", marks).alias("marks_full"),
        C.render_chat(C.prompt_messages("messages"), marks, add_generation_prompt=True).alias("marks_prompt"),
        C.render_chat("messages", brackets).alias("brackets_full"),
        C.render_chat(C.prompt_messages("messages"), brackets, add_generation_prompt=True).alias("brackets_prompt"),
    )


def q_tokenize_codepoints(spark, sf):
    c = _commits(spark, sf).where(F.col("diff").isNotNull())
    ids = sequences.tokenize_codepoints("diff")
    return c.select("row_id", F.size(ids).cast("long").alias("n_tokens"), F.to_json(ids).alias("ids"))


def q_mask_labels(spark, sf):
    toks = S.tokenized(_prepared(spark, sf))
    return toks.select("row_id", _json("input_ids"), _json("attention_mask"), _json("labels"))


def q_pad_batches(spark, sf):
    clean = _clean(spark, sf)
    seq = sequences.mask_labels(sequences.tokenize_codepoints("message"), 0, DEFAULT.max_seq_length)
    toks = clean.select("row_id", seq.alias("s")).select("row_id", "s.*")
    ranked = sequences.seeded_rank(toks, DEFAULT.seed)
    pad = sequences.effective_pad_id(0, 3)
    out = sequences.pad_batches(ranked, DEFAULT.batch_size, pad)
    return out.select("row_id", "batch_id", "pos", _json("input_ids"), _json("attention_mask"), _json("labels"))


def q_build_sequences(spark, sf):
    out = S.build_sequences(_prepared(spark, sf))
    return out.select(
        "dataset", "row_id", "batch_id", "pos", _json("input_ids"), _json("attention_mask"), _json("labels")
    )


def _stub_generator():
    """A stand-in model for U1: the reply names the length of the last prompt message."""

    def fn(prompts):
        return [f"  chore: update {len(p[-1]['content'])} chars\n" for p in prompts]

    return fn


def q_generate_stub(spark, sf):
    test = _prepared(spark, sf).where(F.col("split") == "test")
    prompts = test.select("row_id", C.prompt_messages("messages").alias("messages"))
    return generation.generate(prompts, _stub_generator).select("row_id", "prediction")


def q_evaluate_generated(spark, sf):
    test = _prepared(spark, sf).where(F.col("split") == "test")
    return E.evaluate_generated(test, _stub_generator, run_id="stub").summary


def q_stream_curate(spark, sf):
    path = _written(_commits(spark, sf), "arriving", "row_id")
    arriving = spark.readStream.schema(_commits(spark, sf).schema).parquet(path)
    return _streamed(spark, stream_curate(arriving), "curated").select("row_id", "message", _json("messages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}


# --- oracle SQL ----------------------------------------------------------------

def _sql() -> dict[str, str]:
    W = O.with_views
    c = "commits"
    ok_msg = "WHERE message IS NOT NULL"
    chats = """chats AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id
)"""
    conv_ctx = f"""staged AS (
  SELECT conv_id, turn, role, {O.strip('text')} AS t,
    role = 'user' AND lower({O.strip('text')}) = 'r' AS is_reset,
    role = 'user' AND lower({O.strip('text')}) = 'q' AS is_quit
  FROM conversations WHERE role IN ('user', 'assistant')
),
flagged AS (
  SELECT *, max(CAST(is_quit AS INT)) OVER w AS quit_seen, sum(CAST(is_reset AS INT)) OVER w AS epoch
  FROM staged WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
kept AS (SELECT * FROM flagged WHERE quit_seen = 0 AND NOT is_reset AND (role <> 'user' OR {O.nonblank('t')})),
ctx AS (
  SELECT conv_id, turn, role, list({{'role': role, 'content': t}}) OVER (
    PARTITION BY conv_id, epoch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist
  FROM kept
)
SELECT conv_id, turn, CAST(to_json(list_concat([{O.msg('system', O.q(O.SYSTEM_PROMPT))}], hist)) AS VARCHAR) AS messages
FROM ctx WHERE role = 'user'"""
    sample = f"""sampled AS (
  SELECT row_id, row_number() OVER (ORDER BY {O.seeded('row_id')}, row_id) - 1 AS sample_pos
  FROM {{src}} QUALIFY sample_pos < 100
)"""
    chat_q = f"[{O.msg('system', O.q(O.SYSTEM_PROMPT))}, {O.msg('user', O.user_message('diff'))}, {O.msg('assistant', O.strip('message'))}]"
    render = (
        "array_to_string(list_transform({m}, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || "
        "'<|im_end|>' || chr(10)), '')"
    )
    full_text = render.format(m=f"[{O.msg('system', O.q(O.SYSTEM_PROMPT))}, {O.msg('user', O.user_message('diff'))}, {O.msg('assistant', O.strip('message'))}]")
    prompt_text = render.format(m=O.inference("diff")) + " || '<|im_start|>assistant' || chr(10)"
    codepoints = "(CASE WHEN {x} = '' THEN CAST([] AS INTEGER[]) ELSE list_transform(string_split({x}, ''), lambda ch: CAST(unicode(ch) AS INTEGER)) END)"
    mask = """toks AS (SELECT {cols}, {ids}[1:2048] AS ids, {plen} AS plen FROM {src}),
masked AS (
  SELECT {cols}, ids AS input_ids, list_transform(ids, lambda x: 1) AS attention_mask,
    list_concat(list_transform(range(least(plen, len(ids))), lambda i: -100), ids[least(plen, len(ids)) + 1:]) AS labels
  FROM toks
)"""
    pad_sql = """batched AS (
  SELECT *, CAST(floor(rk / 2) AS BIGINT) AS batch_id, CAST(rk % 2 AS INTEGER) AS pos,
    max(len(input_ids)) OVER (PARTITION BY {part} CAST(floor(rk / 2) AS BIGINT)) AS mx
  FROM {src}
),
padded AS (
  SELECT *, list_concat(input_ids, list_transform(range(mx - len(input_ids)), lambda i: 3)) AS p_ids,
    list_concat(attention_mask, list_transform(range(mx - len(input_ids)), lambda i: 0)) AS p_mask,
    list_concat(labels, list_transform(range(mx - len(input_ids)), lambda i: -100)) AS p_labels
  FROM batched
)"""
    out = {
        "read_commits": f"{W(c)}\nSELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place, diff, message, split FROM commits",
        "write_commits": f"{W(c)}\nSELECT row_id, diff, message, split FROM commits",
        "union_splits": f"{W(c)}\nSELECT row_id, diff, message, split FROM commits",
        "filter_nulls": f"{W(c)}\nSELECT row_id, diff, message, split FROM commits WHERE diff IS NOT NULL AND message IS NOT NULL",
        "filter_diff_len": f"{W(c)}\nSELECT row_id FROM commits WHERE diff IS NOT NULL AND message IS NOT NULL AND length(diff) >= 20",
        "filter_msg_len": f"{W(c)},\n{O.BASIC}\nSELECT row_id, message FROM basic",
        "has_noise": f"{W('messages')}\nSELECT row_id, {O.noise('message')} AS has_noise FROM messages {ok_msg}",
        "is_conventional": f"{W('messages')}\nSELECT row_id, {O.conventional('message')} AS is_conventional FROM messages {ok_msg}",
        "clean_messages": f"{W(c)},\n{O.CLEAN}\nSELECT row_id, message FROM clean",
        "non_blank": f"SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND {O.nonblank('text')}",
        "valid_commit_type": f"{W('structured_commits')}\nSELECT row_id, type, type IN ({', '.join(O.q(t) for t in O.COMMIT_TYPES)}) AS valid FROM structured_commits",
        "dedup_keep_first": f"{W(c)},\n{O.BASIC}\nSELECT row_id, message FROM dedup",
        "py_strip": f"SELECT conv_id, turn, {O.strip('text')} AS stripped FROM conversations",
        "subject_line": f"{W('messages')}\nSELECT row_id, {O.subject('message')} AS subject FROM messages",
        "strip_footers": f"{W('messages')}\nSELECT row_id, {O.strip_footers('message')} AS stripped FROM messages",
        "truncate_diff": f"{W(c)}\nSELECT row_id, {O.truncate('diff')} AS diff FROM commits",
        "user_message": f"{W(c)}\nSELECT row_id, {O.user_message('diff')} AS user_message FROM commits",
        "extract_diff": f"{W(c)}\nSELECT row_id, {O.extract(O.user_message('diff'))} AS round_trip, {O.extract('diff')} AS from_raw FROM commits",
        "norm_match": f"{W('messages')}\nSELECT row_id, {O.norm('message')} AS normalized FROM messages",
        "format_commit": f"{W('structured_commits')}\nSELECT row_id, {O.format_commit('type', 'scope', 'description')} AS formatted FROM structured_commits",
        "diff_preview": f"{W(c)}\nSELECT row_id, {O.preview('diff')} AS diff_preview FROM commits",
        "chat_jsonl": f"{W(c)},\n{O.PREPARED}\nSELECT row_id, split, CAST(to_json({{'messages': {chat_q}}}) AS VARCHAR) AS value FROM prepared",
        "chat_examples": f"{W(c)},\n{O.CLEAN}\nSELECT row_id, CAST(to_json({chat_q}) AS VARCHAR) AS messages FROM clean",
        "inference_messages": f"{W(c)}\nSELECT row_id, CAST(to_json({O.inference('diff')}) AS VARCHAR) AS messages FROM commits WHERE diff IS NOT NULL",
        "parse_chat": f"{W(c)},\n{O.PREPARED}\nSELECT row_id, {O.extract(O.user_message('diff'))} AS diff, {O.strip('message')} AS gold FROM prepared",
        "prompt_messages": f"WITH {chats}\nSELECT conv_id, CAST(to_json(list_filter(messages, lambda m: m.role <> 'assistant')) AS VARCHAR) AS messages FROM chats",
        "conversation_contexts": f"WITH {conv_ctx}",
        "split_mode": f"""{W(c)},\n{O.CLEAN}
SELECT CAST(count(DISTINCT split) + coalesce(max(CASE WHEN split IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_values,
  CASE WHEN count(DISTINCT split) + coalesce(max(CASE WHEN split IS NULL THEN 1 ELSE 0 END), 0) <= 1 THEN 'random' ELSE 'curated' END AS mode
FROM clean""",
        "split_curated": f"{W(c)},\n{O.CLEAN}\nSELECT row_id, {O.CURATED} AS split FROM clean WHERE {O.CURATED} IS NOT NULL",
        "split_random": f"""{W(c)},\n{O.CLEAN},
ranked AS (SELECT row_id, row_number() OVER (ORDER BY {O.seeded('row_id')}, row_id) - 1 AS rk, count(*) OVER () AS n FROM clean)
SELECT row_id, CASE WHEN rk < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
  WHEN rk < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'valid' ELSE 'test' END AS split
FROM ranked""",
        "sample_n": f"{W(c)},\n{O.CLEAN},\n{sample.format(src='clean')}\nSELECT row_id, sample_pos FROM sampled",
        "split_values": f"{W(c)}\nSELECT DISTINCT split FROM commits",
        "filter_funnel": f"""{W(c)},
flags AS (
  SELECT row_id, diff IS NOT NULL AND message IS NOT NULL AS f1,
    diff IS NOT NULL AND message IS NOT NULL AND length(diff) >= 20 AS f2,
    diff IS NOT NULL AND message IS NOT NULL AND length(diff) >= 20 AND length(message) BETWEEN 10 AND 500 AS f3,
    diff, message FROM commits
),
firsts AS (SELECT row_id, true AS is_first FROM flags WHERE f3 QUALIFY row_number() OVER (PARTITION BY diff ORDER BY row_id) = 1),
j AS (SELECT f.*, coalesce(x.is_first, false) AS is_first FROM flags f LEFT JOIN firsts x USING (row_id))
SELECT count(*) AS rows_loaded, CAST(count_if(f1) AS BIGINT) AS after_not_null, CAST(count_if(f2) AS BIGINT) AS after_diff_len,
  CAST(count_if(f3) AS BIGINT) AS after_msg_len, CAST(count_if(is_first) AS BIGINT) AS after_dedup,
  CAST(count_if(is_first AND {O.clean('message')} IS NOT NULL) AS BIGINT) AS after_clean,
  count_if(is_first AND {O.clean('message')} IS NOT NULL) * 100.0 / count_if(is_first) AS kept_pct
FROM j""",
        "split_counts": f"""{W(c)},\n{O.PREPARED},
names AS (SELECT unnest(['train', 'valid', 'test']) AS split)
SELECT n.split, CAST(count(p.row_id) AS BIGINT) AS rows FROM names n LEFT JOIN prepared p ON p.split = n.split GROUP BY n.split""",
        "split_report": f"""{W(c)},\n{O.CLEAN},
names AS (SELECT unnest(['train', 'valid', 'test', 'dropped']) AS split),
mapped AS (SELECT coalesce({O.CURATED}, 'dropped') AS split FROM clean)
SELECT n.split, CAST(count(m.split) AS BIGINT) AS rows FROM names n LEFT JOIN mapped m ON m.split = n.split GROUP BY n.split""",
        "corpus_size": f"{W(c)},\n{O.PREPARED}\nSELECT count(*) AS rows, count(*) < 200 AS small_corpus FROM prepared WHERE split = 'train'",
        "pair_predictions": f"{W('predictions')},\n{O.GOLD}\nSELECT run_id, row_id, gold, prediction FROM scored",
        "missing_predictions": f"{W('predictions')},\n{O.GOLD}\nSELECT r.run_id, g.row_id FROM gold g, (SELECT DISTINCT run_id FROM predictions) r WHERE (r.run_id, g.row_id) NOT IN (SELECT (run_id, row_id) FROM predictions)",
        "score_predictions": f"{W('predictions')},\n{O.GOLD}\nSELECT run_id, row_id, conventional, exact_match FROM scored",
        "eval_summary": f"{W('predictions')},\n{O.GOLD}\nSELECT {O.SUMMARY_COLS} FROM scored",
        "compare_runs": f"{W('predictions')},\n{O.GOLD}\nSELECT run_id, {O.SUMMARY_COLS} FROM scored GROUP BY run_id",
        "eval_examples": f"""{W('predictions')},\n{O.GOLD},
tests AS (SELECT * FROM prepared WHERE split = 'test'),
{sample.format(src='tests')},
ss AS (SELECT s.*, m.sample_pos FROM scored s JOIN sampled m USING (row_id)),
both_ AS (
  SELECT *, 'best' AS bucket FROM ss WHERE exact_match
  UNION ALL SELECT *, 'worst' AS bucket FROM ss WHERE NOT conventional
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, bucket ORDER BY sample_pos) AS pos,
    count(*) OVER (PARTITION BY run_id, bucket) AS total
  FROM both_
)
SELECT run_id, bucket, CAST(pos AS INTEGER) AS pos, total, sample_pos, gold, prediction,
  {O.preview('diff')} AS diff_preview
FROM numbered WHERE pos <= 5""",
        "eval_subset": f"""{W(c)},\n{O.PREPARED}
SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS subset_pos
FROM prepared WHERE split = 'valid' QUALIFY subset_pos < 50""",
        "evaluate": f"""{W('predictions')},\n{O.GOLD},
tests AS (SELECT * FROM prepared WHERE split = 'test'),
{sample.format(src='tests')}
SELECT run_id, {O.SUMMARY_COLS} FROM scored WHERE row_id IN (SELECT row_id FROM sampled) GROUP BY run_id""",
        "prepare": f"{W(c)},\n{O.PREPARED}\nSELECT row_id, split, CAST(to_json({chat_q}) AS VARCHAR) AS messages FROM prepared",
        "render_chat": f"{W(c)},\n{O.PREPARED}\nSELECT row_id, {full_text} AS full_text, {prompt_text} AS prompt_text FROM prepared",
        "render_model_chat": f"""{W(c)},\n{O.PREPARED},
said AS (
  SELECT row_id, row_id % 2 = 0 AS led, {O.q(O.SYSTEM_PROMPT)} AS s, {O.user_message('diff')} AS u, {O.strip('message')} AS a FROM prepared
),
turns AS (
  SELECT row_id, a,
    '<|im_start|>system' || {O.NL} || CASE WHEN led THEN s ELSE 'You are a helpful assistant.' END || '<|im_end|>' || {O.NL}
      || '<|im_start|>user' || {O.NL} || u || '<|im_end|>' || {O.NL} || '<|im_start|>assistant' || {O.NL} AS marks_prompt,
    CASE WHEN led THEN '<<SYS>>' || {O.NL} || s || {O.NL} || '<</SYS>>' || {O.NL} || {O.NL} || u ELSE u END AS first_turn
  FROM said
)
SELECT row_id, marks_prompt, marks_prompt || a || '<|im_end|>' || {O.NL} AS marks_full,
  '<s>[INST] ' || {O.strip('first_turn')} || ' [/INST]' AS brackets_prompt,
  '<s>[INST] ' || {O.strip('first_turn')} || ' [/INST] ' || {O.strip('a')} || ' </s>' AS brackets_full
FROM turns""",
        "tokenize_codepoints": f"""{W(c)}
SELECT row_id, CAST(len({codepoints.format(x='diff')}) AS BIGINT) AS n_tokens, CAST(to_json({codepoints.format(x='diff')}) AS VARCHAR) AS ids
FROM commits WHERE diff IS NOT NULL""",
        "mask_labels": f"""{W(c)},\n{O.PREPARED},
{mask.format(cols='row_id', ids=codepoints.format(x=full_text), plen=f'length({prompt_text})', src='prepared')}
SELECT row_id, CAST(to_json(input_ids) AS VARCHAR) AS input_ids, CAST(to_json(attention_mask) AS VARCHAR) AS attention_mask, CAST(to_json(labels) AS VARCHAR) AS labels FROM masked""",
        "pad_batches": f"""{W(c)},\n{O.CLEAN},
{mask.format(cols='row_id', ids=codepoints.format(x='message'), plen='0', src='clean')},
ranked AS (SELECT *, row_number() OVER (ORDER BY {O.seeded('row_id')}, row_id) - 1 AS rk FROM masked),
{pad_sql.format(part='', src='ranked')}
SELECT row_id, batch_id, pos, CAST(to_json(p_ids) AS VARCHAR) AS input_ids, CAST(to_json(p_mask) AS VARCHAR) AS attention_mask, CAST(to_json(p_labels) AS VARCHAR) AS labels FROM padded""",
        "build_sequences": f"""{W(c)},\n{O.PREPARED},
{mask.format(cols='row_id, split', ids=codepoints.format(x=full_text), plen=f'length({prompt_text})', src='prepared')},
seq_ranked AS (
  SELECT 'train' AS dataset, *, row_number() OVER (ORDER BY {O.seeded('row_id')}, row_id) - 1 AS rk FROM masked WHERE split = 'train'
  UNION ALL
  SELECT 'eval' AS dataset, *, row_number() OVER (ORDER BY row_id) - 1 AS rk FROM masked WHERE split = 'valid' QUALIFY rk < 50
),
{pad_sql.format(part='dataset,', src='seq_ranked')}
SELECT dataset, row_id, batch_id, pos, CAST(to_json(p_ids) AS VARCHAR) AS input_ids, CAST(to_json(p_mask) AS VARCHAR) AS attention_mask, CAST(to_json(p_labels) AS VARCHAR) AS labels FROM padded""",
        "generate_stub": f"""{W(c)},\n{O.PREPARED}
SELECT row_id, 'chore: update ' || CAST(length({O.user_message('diff')}) AS VARCHAR) || ' chars' AS prediction
FROM prepared WHERE split = 'test'""",
        "evaluate_generated": f"""{W(c)},\n{O.PREPARED},
tests AS (SELECT * FROM prepared WHERE split = 'test'),
{sample.format(src='tests')},
gen AS (
  SELECT p.row_id, {O.strip('message')} AS gold,
    'chore: update ' || CAST(length({O.user_message(O.extract(O.user_message('diff')))}) AS VARCHAR) || ' chars' AS prediction
  FROM tests p WHERE row_id IN (SELECT row_id FROM sampled)
),
scored AS (
  SELECT 'stub' AS run_id, coalesce({O.conventional('prediction')}, false) AS conventional,
    coalesce({O.norm('prediction')} = {O.norm('gold')}, false) AS exact_match
  FROM gen
)
SELECT run_id, {O.SUMMARY_COLS} FROM scored GROUP BY run_id""",
        "read_chat_jsonl": f"{W(c)},\n{O.PREPARED}\nSELECT row_number() OVER (ORDER BY row_id) - 1 AS place, CAST(to_json({chat_q}) AS VARCHAR) AS messages FROM prepared",
        "jsonl_round_trip": f"{W(c)},\n{O.PREPARED}\nSELECT row_id, split, CAST(to_json({chat_q}) AS VARCHAR) AS messages FROM prepared",
        "read_diffs": "SELECT item_id, text || chr(10) AS diff FROM benchmark",
        "require_rows": f"{W(c)},\n{O.CLEAN}\nSELECT row_id, message FROM clean",
        "peek": f"{W(c)},\n{O.CLEAN}\nSELECT row_id, message FROM clean ORDER BY row_id LIMIT 1",
        "sql_functions": f"""SELECT doc_id, {O.subject('text')} AS subject, coalesce({O.conventional('text')}, false) AS conventional, {O.noise('text')} AS noise,
  {O.truncate('text')} AS truncated, {O.norm('text')} AS norm, {O.strip('text')} AS stripped, NOT {O.nonblank('text')} AS blank,
  {O.strip_footers('text')} AS footers, {O.clean('text')} AS clean, {O.user_message('text')} AS user_message,
  {O.extract(O.user_message('text'))} AS extracted, {O.preview('text')} AS preview,
  {O.format_commit('lang', 'source', 'text')} AS formatted, lang IN ({', '.join(O.q(t) for t in O.COMMIT_TYPES)}) AS valid FROM documents""",
        "sql_chat_functions": f"""{W(c)},\n{O.PREPARED},
again AS (SELECT row_id, {O.extract(O.user_message('diff'))} AS diff, {O.strip('message')} AS message FROM prepared),
{mask.format(cols='row_id, diff, message', ids=codepoints.format(x=full_text), plen=f'length({prompt_text})', src='again')}
SELECT row_id, CAST(to_json({chat_q}) AS VARCHAR) AS messages, CAST(to_json({O.inference('diff')}) AS VARCHAR) AS prompt,
  {O.extract(O.user_message('diff'))} AS diff, {O.strip('message')} AS gold, {full_text} AS full_text, {prompt_text} AS prompt_text,
  CAST(to_json(input_ids) AS VARCHAR) AS input_ids, CAST(to_json(attention_mask) AS VARCHAR) AS attention_mask, CAST(to_json(labels) AS VARCHAR) AS labels FROM masked""",
        "write_counts": f"""{W(c)},\n{O.PREPARED},
long AS (SELECT row_id, length({full_text}) AS n, length({prompt_text}) AS p FROM prepared WHERE split = 'train')
SELECT count(*) AS rows, CAST(count_if(length(diff) > 12000) AS BIGINT) AS truncated_diffs, CAST(count_if(split = 'train') AS BIGINT) AS train_rows,
  CAST(count_if(split = 'valid') AS BIGINT) AS valid_rows, CAST(count_if(split = 'test') AS BIGINT) AS test_rows,
  (SELECT count(*) FROM long) AS sequences, (SELECT CAST(count_if(n > 2048) AS BIGINT) FROM long) AS cut_sequences,
  (SELECT CAST(count_if(p >= least(n, 2048)) AS BIGINT) FROM long) AS all_masked
FROM prepared""",
        "sql_contexts": f"WITH {conv_ctx}",
        "stream_prompts": f"SELECT item_id, CAST(to_json({O.inference('(text || chr(10))')}) AS VARCHAR) AS messages FROM benchmark WHERE {O.nonblank('text')}",
        "stream_refused": f"""SELECT item_id, CASE WHEN item_id % 4 = 1 OR NOT {O.nonblank('text')} THEN 'blank' END AS reason,
  CASE WHEN item_id % 4 <> 1 AND {O.nonblank('text')} THEN CAST(to_json({O.inference('(text || chr(10))')}) AS VARCHAR) END AS messages
FROM benchmark""",
        "evaluate_missing": f"""{W('predictions')},\n{O.GOLD},
tests AS (SELECT * FROM prepared WHERE split = 'test'),
{sample.format(src='tests')},
runs AS (
  SELECT run_id, row_id FROM predictions
  UNION ALL
  SELECT 'late', p.row_id FROM predictions p JOIN commits c USING (row_id) WHERE p.run_id = 'base' AND c.split = 'train'
)
SELECT r.run_id, s.row_id FROM sampled s, (SELECT DISTINCT run_id FROM runs) r WHERE (r.run_id, s.row_id) NOT IN (SELECT (run_id, row_id) FROM runs)""",
        "stream_curate": f"""{W(c)},
basic AS (
  SELECT * FROM commits
  WHERE diff IS NOT NULL AND message IS NOT NULL AND length(diff) >= 20 AND length(message) BETWEEN 10 AND 500
),
cl AS (SELECT row_id, diff, {O.clean('message')} AS message FROM basic)
SELECT row_id, message, CAST(to_json({chat_q}) AS VARCHAR) AS messages FROM cl WHERE message IS NOT NULL""",
    }
    return out | {"evaluate_from_jsonl": out["evaluate"], "build_sequences_user_tokenizer": out["build_sequences"]}


# --- contract -----------------------------------------------------------------

def _with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """A local session (tests, smoke checks) without a checkpoint folder gets one; a cluster must name its own."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="diffcorpus-checkpoints-"))
    return spark


def _contract(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(_with_checkpoint_dir(spark), sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the whole preparation pipeline (E1) on sf0.001."""
    _with_checkpoint_dir(spark)
    return _prepared(spark, FLAGSHIP_SF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(QUERIES)
    if llm_queries:
        out |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: _contract(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    out = {k: v for k, v in sql.items() if k in QUERIES}
    if llm_queries:
        out |= llm_queries.SQL
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
