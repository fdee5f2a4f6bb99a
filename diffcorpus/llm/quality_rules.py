"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets a level for each rule (how far it shows one sort of
junk).  Labelled documents fall into two folds.  The tuning fold proposes, for
each stratum, a ladder of cutoffs from cautious to bold.  The holdout fold
tests the ladder from its first step on: a step passes when the exact binomial
p-value of "more than ``max_loss`` of the good documents would go" is at most
``risk`` over the number of strata.  Testing ends at the first step that
fails (a fixed sequence needs no further correction), and Bonferroni's
division covers the strata: with probability ``1 - risk`` no stratum loses
more than ``max_loss`` of its good documents.  A stratum with too few labels
gets no cutoff, so nothing of it is rejected.

Only DataFrame functions are used; a text is read once, and what is learnt
and decided comes from its written numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import stage

#: Largest share of good documents that the rules may reject, in each stratum.
MAX_LOSS = 0.05
#: Chance that the bound above fails in any stratum.
RISK = 0.05
#: Steps of the ladder: share of the tuning fold's good documents that one rule may reject.
LADDER = (0.0, 0.001, 0.002, 0.005)
#: A rule takes part at a step when it rejects this many times more of the bad than of the good, and this share of the bad at least.
LIFT, LEAST = 4.0, 0.01
#: Levels above this one count as this one.
TOP_LEVEL = 200

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that stands twice or more in the text."""

    def covered(starts: Column) -> Column:  # sorted starts of repeated windows
        def add(acc: Column, j: Column) -> Column:
            gap = F.get(starts, j + 1) - F.get(starts, j)
            return acc + F.least(F.lit(3), F.coalesce(gap, F.lit(3))).cast("long")

        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("long"), add)

    def repeated(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(
            placed,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])), lambda x: x["i"]
                )
            ),
        )
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(starts, covered)).otherwise(F.lit(0).cast("long"))

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.size(hashes) - 2), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 4, _let(hashed, lambda h: _let(windows(h), repeated))).otherwise(F.lit(0).cast("long"))


def _level(part: Column, whole: Column, scale: int = 100) -> Column:
    """``scale * part / whole`` as a whole number, rounded down; 0 where there is no whole."""
    return F.least(F.when(whole > 0, F.floor(part * scale / whole)).otherwise(F.lit(0)), F.lit(TOP_LEVEL)).cast("int")


#: Rule names in the order of ``levels``.
RULES = ("symbols", "repeats", "duplicate_lines", "long_words", "short_words", "capitals", "exclamations")


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: Column | None = None) -> DataFrame:
    """``(doc, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, levels)`` of every row.

    A null or empty text has no words and level 0 by every rule; a null
    stratum is one of its own; repeated rows stay repeated; other columns are
    not read.  ``levels`` holds one whole number for each of ``RULES``.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(stratum.cast("string"), F.lit("\0none")) if stratum is not None else F.lit("")
    base = docs.select(F.col(id_col).alias("doc"), key.alias("stratum"), value.alias("t"))
    numbers = base.select(
        "doc",
        "stratum",
        _let(F.filter(F.split("t", _SPACE, -1), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("t", _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(
            F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct")),
        ).alias("l"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("t", r"[^!]+", "")).cast("long").alias("n_exclamations"),
    ).select("doc", "stratum", "w.*", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), (F.col("l.n") - F.col("l.n_distinct")).alias("n_dup_lines"), "n_capitals", "n_exclamations")
    levels = F.array(
        _level(F.col("n_symbols"), F.col("word_chars")),
        _level(F.col("n_repeat_words"), F.col("n_words")),
        _level(F.col("n_dup_lines"), F.col("n_lines")),
        _level(F.col("word_chars"), F.col("n_words"), 4),
        _level(F.col("n_words"), F.col("word_chars")),
        _level(F.col("n_capitals"), F.col("word_chars")),
        _level(F.col("n_exclamations"), F.col("n_words")),
    )
    return numbers.select("doc", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", levels.alias("levels"))


def base_failed() -> Column:
    """The fixed rules: fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _ln_gamma(x: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series ten above it, stepped down."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = F.lit(0.0)
    for k in range(10):
        steps = steps + F.log(x + k)
    return series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed downwards from k; 1 from the mean on, where it is near a half or more.

    Below the mean the terms fall faster than a normal curve, so those more
    than twelve deviations away are below the last digit of a double.
    """
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    last = F.least(k, 40 + F.ceil(12 * F.sqrt(n * p)).cast("double")).cast("int")

    def add(acc: Column, j: Column) -> Column:
        ratio = (k - j) / (n - k + j + 1) * ((1 - p) / p)
        return F.struct((acc["term"] * ratio).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), add, lambda a: a["total"])
    return F.when((n > 0) & (k < n * p), F.least(first * total, F.lit(1.0))).otherwise(F.lit(1.0))


def certify(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality: str = "quality", max_loss: float = MAX_LOSS, risk: float = RISK, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """``(stratum, step, cutoffs, n_good, n_lost, p_value)``: the cutoffs that stand, at most one row a stratum.

    ``measured`` should be a written table.  ``cutoffs`` holds one level a
    rule (null: the rule takes no part); a document whose level reaches one
    is rejected.  A label counts once an id: good when any row of the id is
    good, at the highest level that a row of the id has.  Null ids and null
    labels take no part; documents that fail the fixed rules neither.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg((F.max(quality) > 0).alias("good"))
    known = measured.where(~base_failed()).join(marks, "doc")
    worst = F.array(*[F.max(F.get("levels", F.lit(r))) for r in range(len(RULES))])
    known = stage(known.groupBy("doc", "stratum").agg(F.max("good").alias("good"), worst.alias("levels")).withColumn("tuning", F.crc32(F.col("doc").cast("string")) % 2 == 0), "labelled")

    # tuning: rejected shares of the good and the bad at every level of every rule
    tuning = known.where("tuning")
    sizes = tuning.groupBy("stratum").agg(F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads"))
    counts = tuning.select("stratum", "good", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    shares = (
        counts.withColumn("g", F.sum("g").over(above))
        .withColumn("b", F.sum("b").over(above))
        .join(sizes, "stratum")
        .where("goods > 0 AND bads > 0 AND level > 0")
        .select("stratum", "rule", "level", (F.col("g") / F.col("goods")).alias("lost"), (F.col("b") / F.col("bads")).alias("caught"))
    )
    useful = shares.where((F.col("caught") >= LEAST) & (F.col("caught") >= LIFT * F.col("lost")))
    steps = F.posexplode(F.array(*[F.lit(float(q)) for q in ladder])).alias("step", "q")
    proposed = (
        useful.select("*", steps)
        .where("lost <= q")
        .groupBy("stratum", "step", "rule")
        .agg(F.min("level").alias("cut"))
        .groupBy("stratum", "step")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))
        .select("stratum", "step", F.array(*[F.try_element_at("cuts", F.lit(r)) for r in range(len(RULES))]).alias("cutoffs"))
    )

    # at most one row a step and certified stratum: written, so that the planner knows how small it is and no stratum meets in one task
    proposed = stage(proposed, "proposed")

    # holdout: exact test of each step; a step stands when it and all before it pass
    lost = rejected(F.col("levels"), F.col("cutoffs"))
    n_strata = known.agg(F.count_distinct("stratum")).scalar()
    tested = (
        known.where("good AND NOT tuning")
        .join(proposed, "stratum")
        .groupBy("stratum", "step", "cutoffs")
        .agg(F.count(F.lit(1)).alias("n_good"), F.count_if(lost).alias("n_lost"))
        .withColumn("p_value", binomial_tail(F.col("n_lost"), F.col("n_good"), max_loss))
        .withColumn("passes", F.col("p_value") <= F.lit(risk) / n_strata)
    )
    upto = Window.partitionBy("stratum").orderBy("step")
    stands = tested.withColumn("stands", F.min(F.col("passes").cast("int")).over(upto)).where("stands = 1")
    last = stands.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("step")))).where("rn = 1")
    return last.select("stratum", "step", "cutoffs", "n_good", "n_lost", "p_value")


def rejected(levels: Column, cutoffs: Column) -> Column:
    """True when a level reaches its cutoff; false without cutoffs."""
    hits = F.zip_with(levels, cutoffs, lambda x, c: F.coalesce(x >= c, F.lit(False)))
    return F.coalesce(F.exists(hits, lambda h: h), F.lit(False))


def keep(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept`` (false when the fixed rules or a certified cutoff reject the row)."""
    return measured.join(cutoffs.select("stratum", "cutoffs"), "stratum", "left").select(
        *measured.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected(F.col("levels"), F.col("cutoffs"))).alias("kept")
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: Column | None = None) -> DataFrame:
    """Measure every row (one written table of numbers), certify the cutoffs, decide on every row.

    Without labels, or with too few, only the fixed rules reject.  Rows of an
    empty table: none.
    """
    measured = stage(measure(docs, stratum=stratum), "measured")
    return keep(measured, stage(certify(measured, labels), "cutoffs"))
