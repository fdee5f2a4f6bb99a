"""The registered queries of this subpackage: thin digests of the operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hilbert_ann, langid, licenses, pieces, pitman_yor, quality, quality_rules, secret_scan, simhash, spelling, toxicity, whitening
from .stages import bucket_of, read

#: A public SentencePiece model; any with byte fallback will do.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), usable=bucket_of("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        F.col("doc").alias("doc_id"),
        F.coalesce(bucket_of("doc", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good; selected when a grade above 0 is likelier than not."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(F.col("quality") * 2).alias("grade"))
    model = quality.train(docs, ratings, usable=bucket_of("doc_id", 5) != 0)
    return quality.grade(docs, model).select(
        F.col("doc").alias("doc_id"),
        F.coalesce(bucket_of("doc", 5) == 0, F.lit(False)).alias("held_out"),
        "expected_grade",
        F.coalesce(F.get("tails", F.lit(0)), F.lit(0.0)).alias("score"),
        (F.coalesce(F.get("tails", F.lit(0)), F.lit(0.0)) >= 0.5).alias("keep"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return pieces.decode(encoded, PIECES).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score(read(spark, sf_dir, "documents"), learn=bucket_of("doc_id", 7) != 2)
    return scored.select(
        F.col("doc").alias("doc_id"), F.coalesce(bucket_of("doc", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, usable=bucket_of("doc_id", 5) != 0)
    return langid.predict(docs, model).select(
        F.col("doc").alias("doc_id"), F.coalesce(bucket_of("doc", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets themselves stay out of the result: place, length and digest name them."""
    return secret_scan.find_secrets(read(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "start", F.length("found").cast("long").alias("n_chars"), F.sha2("found", 256).alias("found_sha256"), "score", "is_secret"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector and component."""
    vectors = read(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, k=32)
    whitened = whitening.transform(vectors, model)
    k = len(model.values)
    error = whitening.identity_error(whitened, k)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        (F.get(shares, F.col("at")) if k else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata are the languages."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), stratum=F.col("lang"))
    return judged.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents"), dropped=199)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_nearest": op3_nearest,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling_variants": op13_spelling_variants,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _quality_rules_sql() -> str:
    """Numbers of every text by window functions; the exact test by log-gamma sums, which DuckDB has as a function."""
    q = quality_rules
    top = q.TOP_LEVEL

    def level(part: str, whole: str, scale: int = 100) -> str:
        return f"CAST(least(CASE WHEN {whole} > 0 THEN ({part}) * {scale} // {whole} ELSE 0 END, {top}) AS INTEGER)"

    levels = ", ".join(
        [
            level("n_symbols", "word_chars"), level("n_repeat_words", "n_words"), level("n_dup_lines", "n_lines"),
            level("word_chars", "n_words", 4), level("n_words", "word_chars"), level("n_capitals", "word_chars"), level("n_exclamations", "n_words"),
        ]
    )
    failed = "(n_words < 50 OR n_repeat_words * 100 > n_words * 50)"
    p = q.MAX_LOSS
    pmf = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(1)) AS s, coalesce(text, '') AS t, {_SPACED} AS w FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS place FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
numbers AS (
  SELECT r, doc_id, s, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
  FROM docs JOIN lines USING (r) LEFT JOIN covered USING (r)
),
measured AS (SELECT *, {failed} AS base_failed, [{levels}] AS levels FROM numbers),
marks AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS (
  SELECT m.doc_id, m.s, bool_or(good) AS good, [{", ".join(f"max(levels[{r + 1}])" for r in range(len(q.RULES)))}] AS levels,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(m.doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) + 1 AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 1) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 2 = 0 AS tuning
  FROM measured m JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY m.doc_id, m.s
),
sizes AS (SELECT s, count_if(good) AS goods, count_if(NOT good) AS bads FROM known WHERE tuning GROUP BY s),
counts AS (
  SELECT s, rule, level, count_if(good) AS g, count_if(NOT good) AS b
  FROM (SELECT s, good, unnest(levels) AS level, unnest(range({len(q.RULES)})) AS rule FROM known WHERE tuning) GROUP BY ALL
),
shares AS (
  SELECT s, rule, level, sum(g) OVER above / goods AS lost, sum(b) OVER above / bads AS caught
  FROM counts JOIN sizes USING (s) WHERE goods > 0 AND bads > 0 WINDOW above AS (PARTITION BY s, rule ORDER BY level DESC)
),
steps AS (SELECT unnest([{", ".join(map(str, q.LADDER))}]) AS share, unnest(range({len(q.LADDER)})) AS step),
cuts AS (
  SELECT s, step, rule, min(level) AS cut FROM shares, steps
  WHERE level > 0 AND caught >= {q.LEAST} AND caught >= {q.LIFT} * lost AND lost <= share GROUP BY ALL
),
tested AS (
  SELECT s, step, count(*) AS n, CAST(count_if(lost) AS BIGINT) AS k FROM (
    SELECT k.s, c.step, k.doc_id, bool_or(k.levels[c.rule + 1] >= c.cut) AS lost FROM known k JOIN cuts c ON c.s = k.s WHERE good AND NOT tuning GROUP BY ALL
  ) GROUP BY ALL
),
valued AS (
  SELECT s, step, CASE WHEN k < n * {p} THEN list_sum(list_transform(range(k + 1), lambda i: {pmf})) ELSE 1 END <= {q.RISK} / (SELECT count(DISTINCT s) FROM known) AS passes
  FROM tested
),
stands AS (SELECT s, max(step) AS step FROM (SELECT *, bool_and(passes) OVER (PARTITION BY s ORDER BY step) AS ok FROM valued) WHERE ok GROUP BY s),
rejects AS (SELECT m.r, bool_or(m.levels[c.rule + 1] >= c.cut) AS hit FROM measured m JOIN stands USING (s) JOIN cuts c USING (s, step) GROUP BY m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(hit, false) AS kept
FROM measured LEFT JOIN rejects USING (r)"""


#: DuckDB SQL by query, where SQL can express it.
SQL: dict[str, str] = {
    "op12_quality_rules": _quality_rules_sql(),
    "op5_decontamination": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
cuts AS (
  SELECT DISTINCT item, w[k + 1:k + 10] AS win FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS n FROM cuts),
places AS (
  SELECT r, i, n, w[i + 1:i + n] AS win FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)
),
found AS (SELECT p.r, p.i, p.n, c.item FROM places p JOIN cuts c ON p.win = c.win),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
