"""Licence scans with a positional index of the words that tell a licence, in DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE, STOP, TEMPLATES, Template
from .stages import stage

#: Words, cased: separators are ASCII but letters and digits.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a file that a template is looked up by: its rarest in the corpus.
RARE = 12
#: Of these, words that must agree on one alignment, where the template has as many.
MIN_VOTES = 3


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def phrase_words(text: str) -> list[tuple[int, str]]:
    """Words that a phrase is found by, with their places in it: all but common ones."""
    return [(k, w) for k, w in enumerate(words_of(text)) if w not in STOP]


def _lowered(word: Column) -> Column:
    """``word`` with A-Z in lower case, and no other letter changed."""
    return F.translate(word, _UPPER, _LOWER)


def phrase_starts(hits: Column, phrase: str) -> Column:
    """Starts of the places where the words of ``phrase`` stand one after the other.

    ``hits`` holds every place of every word of the phrase, in order, so the
    words of a place are neighbours in it: one pass, whatever the text repeats.
    """
    first, *more = words_of(phrase)

    def here(h: Column, i: Column) -> Column:
        fits = h["w"] == first
        for n, w in enumerate(more, 1):
            later = F.get(hits, i + n)
            fits = fits & (later["w"] == w) & (later["p"] == h["p"] + n)
        return fits

    return F.array_compact(F.transform(hits, lambda h, i: F.when(here(h, i), h["p"])))


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    """Words of the templates but common ones, and all words of the phrases."""
    phrases = [*BASE, *(p for t in templates for p in t.phrases)]
    return sorted({w for t in templates for _, w in phrase_words(t.text)} | {w for p in phrases for w in words_of(p)})


def _offset(template: Template, phrase: str) -> int:
    """Where a mandatory phrase stands in its template."""
    ws, ps = words_of(template.text), words_of(phrase)
    return next(k for k in range(len(ws)) if ws[k : k + len(ps)] == ps)


def _by_rarity(files: DataFrame, templates: tuple[Template, ...]) -> dict[str, list[str]]:
    """Words of each template by falling inverse document frequency, ties in code-point order.

    The frequencies count all rows of ``files``; the table that reaches the
    driver has one row for each word of a template.
    """
    counts = files.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    words = files.sparkSession.createDataFrame([(t.name, w) for t in templates for w in sorted({w for _, w in phrase_words(t.text)})], "template string, w string")
    idf = F.log(F.lit(files.count() + 1) / (F.coalesce("df", F.lit(0)) + 1))
    ranked = words.join(F.broadcast(counts), "w", "left").select("template", "w", idf.alias("idf"))
    out: dict[str, list[str]] = {t.name: [] for t in templates}
    for r in sorted(ranked.collect(), key=lambda r: (-r.idf, r.w)):
        out[r.template].append(r.w)
    return out


def _fewest(template: Template, need: int) -> int:
    """Fewest different words of a template that can cast ``need`` votes on one alignment."""
    times = sorted(Counter(w for _, w in phrase_words(template.text)).values(), reverse=True)
    return next(n for n in range(1, len(times) + 1) if sum(times[:n]) >= need)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, min_votes: int = MIN_VOTES
) -> DataFrame:
    """``(doc, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row of ``docs``.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is
    lower-cased; null texts have none.  For each template, the ``rare`` words of
    it that the file holds and fewest rows of ``docs`` do are looked up in the
    template's postings, and the alignments (word place less template place)
    that ``min_votes`` of their places share are candidates (all words of the
    template, where it has fewer than ``min_votes``).  The choice is made for
    each template by itself, so neither other licences nor rarer words of the
    prose take votes away, and a text cut into ``(rare - 1) / (min_votes - 1)``
    pieces by inserted words is still found.  A candidate becomes a label if each mandatory
    phrase stands, word for word, within a template length of where the
    alignment puts it.  ``score`` is the largest share of a template's words
    (common ones aside) which stand on its alignment, 0 without a label.
    Rows and ids may repeat or be null: rows are kept apart by a row number.
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(templates)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    # lower() finds the candidates; translate() then lowers A-Z alone, so no other letter passes for one of them
    hits = F.filter(
        F.transform(F.col("words"), lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(_lowered(w).alias("w"), i.alias("p")))),
        lambda h: h.isNotNull() & h["w"].isin(vocabulary),
    )
    files = stage(src.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "license-files")

    # all three tables below are as large as the templates
    order = _by_rarity(files, templates)
    postings = spark.createDataFrame([(w, t.name, k) for t in templates for k, w in phrase_words(t.text)], "w string, template string, k int")
    needs = spark.createDataFrame(
        [(t.name, len(words_of(t.text)), len(phrase_words(t.text)), len(t.phrases)) for t in templates], "template string, length int, size int, phrases int"
    ).withColumn("need", F.least(F.lit(min_votes), "size"))

    # the index: places of a file's rarest words of a template, met with the template's own
    asked = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("template"),
                F.slice(F.array_intersect(F.array(*map(F.lit, order[t.name])), F.col("held")), 1, rare).alias("rare"),
                F.lit(_fewest(t, min(min_votes, len(phrase_words(t.text))))).alias("fewest"),
            )
            for t in templates
        ]
    )
    enough = F.filter(F.col("asked"), lambda a: F.size(a["rare"]) >= a["fewest"])
    looked = (
        files.where(F.size("hits") > 0)
        .select("row", "hits", F.array_distinct("hits.w").alias("held"))
        .select("row", "hits", asked.alias("asked"))
        .select("row", "hits", F.explode(enough).alias("a"))
        .select("row", "a.template", F.explode(F.filter("hits", lambda h: F.array_contains(F.col("a.rare"), h["w"]))).alias("h"))
    )
    voted = stage(
        looked.select("row", "template", "h.w", "h.p")
        .join(F.broadcast(postings), ["template", "w"])
        .groupBy("row", "template", (F.col("p") - F.col("k")).alias("at"))
        .agg(F.count("*").alias("rare_votes"))
        .join(F.broadcast(needs), "template")
        .where("rare_votes >= need"),
        "license-candidates",
    )

    # files with a candidate only: their phrases, and all words of the template that stand on the alignment
    said = F.concat(
        *[F.transform(phrase_starts(F.col("hits"), p), lambda s: F.struct(F.lit(t.name).alias("template"), (s - _offset(t, p)).alias("at"), F.lit(j).alias("phrase"))) for t in templates for j, p in enumerate(t.phrases)]
    )
    chosen = files.select("row", "hits").join(voted.select("row").distinct(), "row", "left_semi")
    phrases = chosen.select("row", F.explode(said).alias("x")).select("row", "x.*")
    # a phrase may start a template length off: its bucket of that length or a neighbour
    bucket = F.floor(F.col("at") / F.col("length"))
    near = (
        phrases.join(F.broadcast(needs.select("template", "length")), "template")
        .select("row", "template", "phrase", F.col("at").alias("phrase_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    )
    kept = (
        voted.withColumn("bucket", bucket)
        .join(near, ["row", "template", "bucket"])
        .where(F.abs(F.col("at") - F.col("phrase_at")) <= F.col("length"))
        .groupBy("row", "template", "at")
        .agg(F.size(F.collect_set("phrase")).alias("said"), F.first("size").alias("size"), F.first("phrases").alias("phrases"))
        .where("said = phrases")
    )
    standing = (
        chosen.select("row", F.explode("hits").alias("h"))
        .select("row", "h.w", "h.p")
        .join(F.broadcast(postings), "w")
        .select("row", "template", (F.col("p") - F.col("k")).alias("at"))
    )
    told = (
        kept.join(standing, ["row", "template", "at"])
        .groupBy("row", "template", "at")
        .agg((F.count("*") / F.first("size")).alias("share"))
        .groupBy("row")
        .agg(F.collect_set("template").alias("more"), F.max("share").alias("score"))
    )

    base = {label: phrase_starts(F.col("hits"), phrase) for phrase, label in BASE.items()}
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(starts) > 0, F.lit(label)) for label, starts in base.items()])))
    marked = files.select("row", "doc", "n_words", F.concat(*base.values()).alias("places"), base_labels.alias("base"))
    return marked.join(told, "row", "left").select(
        "doc",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
