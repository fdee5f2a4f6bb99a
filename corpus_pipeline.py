"""A training-data pipeline over ``documents``: each stage is one operator of ``diffcorpus.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffcorpus.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from diffcorpus.llm.queries import PIECES
from diffcorpus.llm.stages import bucket_of, read, stage


def _recounted(docs: DataFrame) -> DataFrame:
    """Texts may have changed: ``n_chars`` is their length again."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for toxic go; labels of a fifth of the ids are never learnt from."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), usable=bucket_of("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return simhash.keep_first(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return _recounted(decontaminate.remove_passages(docs, read(spark, sf_dir, "benchmark"), window=10))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    return _recounted(secret_scan.redact(docs))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids; ``round_trip`` says that decoding them gives the text back."""
    both = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_ids"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


#: (name, function); a function takes (spark, docs, sf_dir) and works on all rows of its predecessor.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", non_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("sentencepiece", tokenized),
]

#: Learnt decisions and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
