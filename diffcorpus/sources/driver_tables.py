"""Commit-shaped views over the driver tables.

The driver tables hold prose, not diffs and commit messages, so the test
views derive commit rows from them with plain SQL expressions.  The same
expressions feed the Spark DataFrames and the DuckDB oracle CTEs, so both
engines see identical rows.  Every view reads the whole base table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

COMMITS_COLUMNS = {
    "row_id": "doc_id",
    "diff": (
        "CASE WHEN doc_id % 40 = 3 THEN 'ctx ' || lang || chr(10) || '```js' || chr(10) || source "
        "|| chr(10) || '```' || chr(10) || text ELSE text END"
    ),
    "message": """CASE CAST(doc_id % 13 AS INT)
      WHEN 0 THEN 'feat(' || source || '): add ' || lang
      WHEN 1 THEN 'fix: handle ' || lang || chr(10) || chr(10) || 'Body one ' || source || chr(10) || 'Body two' || chr(10) || 'Body three'
      WHEN 2 THEN 'docs: see HTTPS://example.com/' || source
      WHEN 3 THEN 'chore: bump ' || source || chr(10) || chr(10) || 'signed-off-by: A <a@x>'
      WHEN 4 THEN 'Update readme ' || source
      WHEN 5 THEN 'refactor: split ' || lang || chr(10) || chr(10) || 'Fixes #' || CAST(doc_id AS VARCHAR(20))
      WHEN 6 THEN 'feat!: breaking ' || source
      WHEN 7 THEN 'ci: x'
      WHEN 8 THEN 'perf(core): ' || repeat('long ', 120)
      WHEN 9 THEN CAST(NULL AS VARCHAR(20))
      WHEN 10 THEN 'Closes #' || CAST(doc_id AS VARCHAR(20)) || chr(10) || 'test(unit): cover ' || lang
      WHEN 11 THEN 'style: tidy ' || source || '   ' || chr(10) || chr(10) || '  indented body  '
      ELSE '  build: trim me ' || lang || chr(10) || '  Signed-off-by: B <b@x>' || chr(10) || 'www-free body'
    END""",
    "split": (
        "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 = 6 THEN 'val' "
        "WHEN doc_id % 10 = 7 THEN 'validation' WHEN doc_id % 10 = 8 THEN 'test' ELSE 'holdout' END"
    ),
}

PREDICTIONS_SQL = """SELECT 'tuned' AS run_id, row_id,
  CASE CAST(row_id % 7 AS INT)
    WHEN 0 THEN message
    WHEN 1 THEN message
    WHEN 2 THEN '  ' || upper(message) || chr(10)
    WHEN 3 THEN 'fix: other ' || CAST(row_id AS VARCHAR(20))
    ELSE 'Update ' || split END AS prediction
FROM commits WHERE row_id % 17 <> 16 AND message IS NOT NULL
UNION ALL
SELECT 'base', row_id, CASE WHEN row_id % 3 = 0 THEN 'Update' ELSE 'docs: base' END
FROM commits WHERE message IS NOT NULL"""

#: Messages made of whole document texts, with URLs, sign-offs and issue lines mixed in.
TEXT_MESSAGE = """CASE CAST(doc_id % 7 AS INT)
      WHEN 0 THEN text
      WHEN 1 THEN 'fix: ' || text || chr(10) || 'Signed-off-by: A <a@x>' || chr(10) || 'last line'
      WHEN 2 THEN text || chr(10) || 'see https://example.com/' || source
      WHEN 3 THEN '  ' || replace(text, '. ', chr(10)) || chr(10) || 'Closes #' || CAST(doc_id AS VARCHAR(20)) || chr(10)
      WHEN 4 THEN 'docs(' || source || '): ' || text || chr(10) || chr(10) || 'signed-off-by: B'
      WHEN 5 THEN 'Fixes #' || CAST(doc_id AS VARCHAR(20)) || chr(10) || text
      ELSE chr(10) || chr(9) || 'perf: ' || replace(text, ' th', chr(13) || 'www.th') || '   ' END"""

MESSAGES_SQL = f"""SELECT 2 * row_id AS row_id, message FROM commits
UNION ALL
SELECT 2 * doc_id + 1, {TEXT_MESSAGE} FROM documents"""

STRUCTURED_COLUMNS = {
    "row_id": "p_partkey",
    "type": (
        "CASE CAST(p_partkey % 11 AS INT) WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'chore' "
        "WHEN 3 THEN 'refactor' WHEN 4 THEN 'docs' WHEN 5 THEN 'test' WHEN 6 THEN 'style' "
        "WHEN 7 THEN 'perf' WHEN 8 THEN 'build' WHEN 9 THEN 'ci' ELSE 'Feature' END"
    ),
    "scope": "CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN CAST(NULL AS VARCHAR(20)) WHEN 1 THEN '' ELSE p_brand END",
    "description": "p_name",
}


def _select_sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ",\n    ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f"\n  FROM {table}"


COMMITS_SQL = _select_sql(COMMITS_COLUMNS, "documents")
STRUCTURED_SQL = _select_sql(STRUCTURED_COLUMNS, "part")


def cte(*names: str) -> str:
    """``WITH`` prefix defining the named views for the DuckDB oracle."""
    bodies = {"commits": COMMITS_SQL, "predictions": PREDICTIONS_SQL, "structured_commits": STRUCTURED_SQL, "messages": MESSAGES_SQL}
    needed = list(names)
    if {"predictions", "messages"} & set(needed) and "commits" not in needed:
        needed.insert(0, "commits")
    return "WITH " + ",\n".join(f"{n} AS (\n{bodies[n]}\n)" for n in needed) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commits(row_id, diff, message, split)`` derived from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(*(f"{expr} AS {name}" for name, expr in COMMITS_COLUMNS.items()))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages(row_id, message)``: the commit messages, and whole document texts as messages."""
    texts = table(spark, sf_dir, "documents").selectExpr("2 * doc_id + 1 AS row_id", f"{TEXT_MESSAGE} AS message")
    return commits(spark, sf_dir).selectExpr("2 * row_id AS row_id", "message").unionByName(texts)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions(run_id, row_id, prediction)``: a tuned and a base run over ``commits``.

    Same rows as ``PREDICTIONS_SQL``; both runs come from one scan (an
    exploded pair of candidate rows, the tuned one kept where it exists).
    """
    from pyspark.sql import functions as F

    c = commits(spark, sf_dir).where(F.col("message").isNotNull())
    tuned = F.expr(
        """CASE CAST(row_id % 7 AS INT) WHEN 0 THEN message WHEN 1 THEN message
           WHEN 2 THEN '  ' || upper(message) || chr(10)
           WHEN 3 THEN 'fix: other ' || CAST(row_id AS VARCHAR(20))
           ELSE 'Update ' || split END"""
    )
    base = F.expr("CASE WHEN row_id % 3 = 0 THEN 'Update' ELSE 'docs: base' END")
    candidates = F.array(
        F.struct(F.lit("tuned").alias("run_id"), tuned.alias("prediction"), F.expr("row_id % 17 <> 16").alias("keep")),
        F.struct(F.lit("base").alias("run_id"), base.alias("prediction"), F.lit(True).alias("keep")),
    )
    return (
        c.select("row_id", F.explode(candidates).alias("p"))
        .where("p.keep")
        .select("p.run_id", "row_id", "p.prediction")
    )


def structured_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``structured_commits(row_id, type, scope, description)`` derived from ``part``."""
    return table(spark, sf_dir, "part").selectExpr(*(f"{expr} AS {name}" for name, expr in STRUCTURED_COLUMNS.items()))
