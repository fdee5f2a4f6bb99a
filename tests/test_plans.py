"""Plan shape: native expressions, top-k, no single-partition windows on the whole table."""

from pyspark.sql import functions as F

from helpers import SF01
from diffcorpus.operators import curate, scoring, splits
from diffcorpus.plans import prepare as P
from diffcorpus.plans import sequences as S
from diffcorpus.sources import driver_tables as dt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_curate_is_native_and_pruned(spark):
    p = plan(curate.curate(dt.commits(spark, SF01)))
    assert "Python" not in p
    assert "n_chars" not in p.split("ReadSchema")[1].split("\n")[0]  # unused column pruned


def test_dedup_aggregates_hashes_not_text(spark):
    from diffcorpus.operators.curate import content_hash

    df = dt.commits(spark, SF01).groupBy(content_hash("diff")).agg({"row_id": "min"})
    p = plan(df)
    assert "sha2" in p and "HashAggregate" in p and "SortAggregate" not in p


def test_dedup_keeps_wide_rows_in_place_where_few_copies_go(spark):
    base = curate.basic_filters(dt.commits(spark, SF01))
    auto = curate.dedup_keep_first(base)
    p = plan(auto)
    assert "LeftAnti" in p and "BroadcastExchange" in p
    wide_side = p.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in wide_side
    assert len({r.row_id for r in auto.collect()}) == 724


def test_samples_need_no_top_k(spark):
    """A cut and a rank inside buckets: nothing of ``n`` rows per partition meets in one task."""
    clean = curate.curate(dt.commits(spark, SF01))
    for n in (10, 10**6):
        for df in (splits.sample_n(clean, n), scoring.eval_subset(clean, n)):
            assert "TakeOrdered" not in plan(df) and "GlobalLimit" not in plan(df)


def test_no_unpartitioned_window_on_whole_table(spark):
    clean = curate.curate(dt.commits(spark, SF01))
    for df in (
        S.sequences.seeded_rank(clean, 42),
        S.seeded_batches(P.prepare(dt.commits(spark, SF01))),
        splits.split_random(clean.drop("split")),
        scoring.eval_subset(clean, 10),
        splits.sample_n(clean, 10),
    ):
        assert "SinglePartition" not in plan(df)


def test_random_split_moves_no_rows(spark):
    from diffcorpus.session import materialize

    clean = materialize(curate.curate(dt.commits(spark, SF01)).drop("split"))
    p = plan(splits.split_random(clean))
    assert "Exchange" not in p and "Window" not in p


def test_prepare_writes_clean_stage_once(spark):
    out = P.prepare(dt.commits(spark, SF01))
    p = plan(out)
    assert "/documents.parquet" in p and p.count("ReadSchema: struct<doc_id:bigint,text:string") == 1  # texts are read once, where they are
    written = p.split("diffcorpus-stages")[-1]
    assert "message" in written and "diff:string" not in written  # the decisions are slim
    assert out.where(F.col("split") == "test").count() == 43


def _exchanges(df):
    """Lines feeding each hash/range exchange of the static plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [lines[i + 1] for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln or "Exchange rangepartitioning" in ln]


def test_shuffle_budget_of_headline_pipelines(spark):
    """Where the wide columns (diff text, chat messages) cross a shuffle."""
    base = curate.basic_filters(dt.commits(spark, SF01))
    # D1 (size-checked path): the diff text never crosses a shuffle
    assert not [f for f in _exchanges(curate.dedup_keep_first(base)) if "diff" in f]
    # E1 after the written stage: no shuffle at all
    assert _exchanges(P.prepare(dt.commits(spark, SF01))) == []
    # A1: no row-level join, only hash-keyed partial aggregates
    assert all("HashAggregate" in f for f in _exchanges(curate.filter_funnel(dt.commits(spark, SF01))))
