"""Secret scans: candidates by shape, false positives removed by a random forest; JVM side only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import sampled, stage, unused

#: Words that a credential follows, as they end ("api_key", "accessToken").
NAMED = "access|apikey|api|auth|bearer|credentials|credential|key|passphrase|passwd|password|private|pwd|secret|token"
#: What stands between such a word and its value.
ASSIGNED = rf"(?i:{NAMED})[\"'`]?(?:\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}|\s{{1,3}}(?i:is)\s{{1,3}})"
#: A value in quotes that such a word introduces: all of it, spaces too.
QUOTED = rf"(?<=[\"'`])(?<=(?:[=:>]\s{{0,3}}|[iI][sS]\s{{1,3}})[\"'`])(?<={ASSIGNED}[\"'`])[^\"'`\n]++(?=[\"'`])"
#: A value without quotes: up to a blank or a mark between values, less closing marks.
VALUE = r"[^\s\"'`,;&]*[^\s\"'`,;&.)\]}>]"
#: One that such a word introduces.
BARE = rf"(?<=[=:>\s])(?<=[=:>]\s{{0,3}}|[iI][sS]\s{{1,3}})(?<={ASSIGNED})(?![=:>]){VALUE}"
#: One that follows such a word after blanks only: no plain word, so it holds a digit or a mark.
FOLLOWING = rf"(?<=\s)(?![=:>])(?=[A-Za-z.:()<>-]*+[0-9@#$%^*!_+/~])(?<=(?i:{NAMED})\s{{1,3}}){VALUE}"
#: A whole run of key characters, 16 or more, with a digit in it, wherever it stands.
RUN = r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
#: No candidate begins inside a run of key characters.
CANDIDATE = f"(?<![A-Za-z0-9+/_-])(?:{QUOTED}|{BARE}|{FOLLOWING}|{RUN})"
#: What stands where a credential is to be filled in.
PLACEHOLDER = r"(?i)^([<{$%\[].*|[*x._-]+|null|none|true|false|undefined|changeme|todo|your[-_ ].*)$"
BEFORE, AFTER = 64, 32
#: Labelled findings learnt from, about.
MAX_LABELLED = 20_000
#: A dictionary word stands beside this many candidates of the table.
MIN_WORD = 5

#: Words beside a credential, words beside what only looks like one, paths of tests and samples.
CREDENTIAL = ("access", "api", "apikey", "auth", "bearer", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "token")
HARMLESS = ("card", "checksum", "commit", "digest", "dummy", "example", "fake", "hash", "id", "isbn", "md5", "order", "phone", "placeholder", "sample", "sha1", "sha256", "uuid")
SAMPLE_PATH = r"(?i)(^|[/_.-])(tests?|spec|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)"
#: Key formats that issuers publish.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

FEATURES = [
    "length", "digits", "uppers", "lowers", "distinct", "changes", "letter_digit", "upper_lower", "longest_run", "hex", "covered",
    "assigned", "quoted", "credential", "harmless", "words_before", "sample_path", "path_depth",
]


def _key(id_col: str, text_col: str, path_col: str) -> Column:
    """Rows alike in id, text and path share a key, and so their findings: 128 bits, so that no others do."""
    parts = F.col(id_col).cast("string"), F.col(text_col), F.col(path_col).cast("string")
    return F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("again"), *parts)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(key, doc, path, i, start, found, before, after)``: every candidate of the whole texts.

    ``start`` counts characters from 0.  Null texts have none.  Rows alike in
    id, text and path count once.
    """
    found = F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))
    rows = (
        docs.where(F.col(text_col).rlike(CANDIDATE))
        .select(_key(id_col, text_col, path_col).alias("key"), F.col(id_col).alias("doc"), F.col(path_col).cast("string").alias("path"), found.alias("found"), F.split(text_col, CANDIDATE, -1).alias("gaps"))
        .select(
            "key",
            "doc",
            "path",
            F.transform(
                "found",
                lambda m, i: F.struct(
                    i.alias("i"),
                    m.alias("found"),
                    F.length(F.get("gaps", i)).alias("gap"),
                    F.right(F.get("gaps", i), F.lit(BEFORE)).alias("before"),
                    F.left(F.get("gaps", i + 1), F.lit(AFTER)).alias("after"),
                ),
            ).alias("all"),
        )
        .dropDuplicates(["key"])
    )
    one = rows.select("key", "doc", "path", F.explode("all").alias("c")).select("key", "doc", "path", "c.*")
    so_far = W.partitionBy("key").orderBy("i")
    ends = F.sum(F.col("gap") + F.length("found")).over(so_far)
    return one.withColumn("start", (ends - F.length("found")).cast("long")).select("key", "doc", "path", "i", "start", "found", "before", "after")


def with_features(found: DataFrame, min_word: int = MIN_WORD) -> DataFrame:
    """``found`` with the columns of ``FEATURES``: shape, character transitions, dictionary coverage, path, neighbours.

    The dictionary is what the table itself holds: words of three letters or
    more that stand beside ``min_word`` candidates, counted over all of them.
    """
    low_before = F.lower("before")
    near = F.regexp_extract_all(low_before, F.lit(r"[a-z0-9]+"), F.lit(0))
    beside = found.select("key", "i", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("word"))
    dictionary = beside.groupBy("word").count().where(F.col("count") >= min_word).select("word")
    inside = found.select("key", "i", F.explode(F.regexp_extract_all(F.lower("found"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = inside.join(dictionary, "word").groupBy("key", "i").agg(F.sum(F.length("word")).alias("letters"))

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("found", "[+/_-]", "."), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "U")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    n = F.length("found")

    def pairs(a: str, b: str) -> Column:
        """How often the two kinds stand side by side."""
        def one(x: str) -> Column:
            return F.length("runs") - F.length(F.replace(F.col("runs"), F.lit(x), F.lit(x[0])))

        return one(a + b) + one(b + a)

    def any_of(words: tuple[str, ...], last: int) -> Column:
        return F.arrays_overlap(F.slice(F.reverse("near"), 1, last), F.array(*[F.lit(w) for w in words])).cast("double")

    table = found.join(covered, ["key", "i"], "left").withColumns({"near": near, "kinds": kinds}).withColumn("runs", runs)
    return table.withColumns(
        {
            "length": n.cast("double"),
            "digits": F.regexp_count("found", F.lit("[0-9]")) / n,
            "uppers": F.regexp_count("found", F.lit("[A-Z]")) / n,
            "lowers": F.regexp_count("found", F.lit("[a-z]")) / n,
            "distinct": F.size(F.array_distinct(F.split("found", ""))) / n,
            "changes": (F.length("runs") - 1) / n,
            "letter_digit": (pairs("a", "9") + pairs("U", "9")) / n,
            "upper_lower": pairs("U", "a") / n,
            "longest_run": F.array_max(F.transform(F.regexp_extract_all("found", F.lit("[0-9]+|[a-z]+|[A-Z]+|[+/_-]+"), F.lit(0)), F.length)) / n,
            "hex": F.col("found").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "covered": F.coalesce(F.col("letters"), F.lit(0)) / n,
            "assigned": F.col("before").rlike(r"([=:>]|\s[iI][sS]\s)\s*[\"'`]?$").cast("double"),
            "quoted": F.col("before").rlike(r"[\"'`]$").cast("double"),
            "credential": any_of(CREDENTIAL, 3),
            "harmless": any_of(HARMLESS, 3),
            "words_before": F.size(F.col("near")).cast("double"),
            "sample_path": F.coalesce(F.col("path").rlike(SAMPLE_PATH), F.lit(False)).cast("double"),
            "path_depth": F.size(F.split(F.coalesce("path", F.lit("")), "/")).cast("double"),
        }
    ).select(*found.columns, *FEATURES)


def weak_label(featured: DataFrame) -> DataFrame:
    """Labelled findings where no one has labelled any: ``featured`` with ``label`` 1, 0 or null for the rest.

    1: an issuer's published format, or a value assigned to a credential word.
    0: a UUID, a placeholder, digits alone that no credential word introduces,
    or a value that a harmless word introduces.  A bare lower-case word stays
    open: it may be prose.
    """
    named = (F.col("assigned") == 1) & (F.col("credential") == 1) & (F.col("harmless") == 0)
    prose = (F.col("quoted") == 0) & F.col("found").rlike("^[a-z]+$")
    sure = F.col("found").rlike(ISSUED) | (named & ~prose)
    harmless = ((F.col("digits") == 1) & ~named) | F.col("found").rlike(UUID) | F.col("found").rlike(PLACEHOLDER) | ((F.col("harmless") == 1) & (F.col("credential") == 0))
    return featured.withColumn("label", F.when(harmless, 0).when(sure, 1))


def train(featured: DataFrame, label_col: str = "label", max_labelled: int = MAX_LABELLED, trees: int = 20, depth: int = 6, seed: int = 3) -> RandomForestClassificationModel | float:
    """A forest from about ``max_labelled`` labelled findings; with one class only, that class as a constant."""
    rows = featured.where(F.col(label_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    picked = sampled(rows.withColumn("_pick", F.concat_ws(":", "key", "i")), "_pick", max_labelled, sum(sizes.values()))
    # in one order, so that bagging does not depend on how rows were dealt
    sample = stage(picked.select(*FEATURES, F.col(label_col).cast("double").alias("label")).repartition(1).sortWithinPartitions(*FEATURES, "label"), "secret-sample")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label").coalesce(1))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``(key, doc, i, start, found, score, is_secret)`` for every candidate of ``docs``.

    ``findings(found, label)``: labelled candidate strings; without it the
    labels are those of ``weak_label``.  Null and empty texts have no
    candidates; other columns are not read.
    """
    featured = stage(with_features(candidates(docs, id_col, text_col, path_col)), "secret-candidates")
    if findings is None:
        labelled = weak_label(featured)
    else:
        marks = findings.groupBy("found").agg(F.max("label").alias("label"))
        labelled = featured.join(marks, "found", "left")
    model = train(labelled)
    if isinstance(model, float):
        scored = featured.withColumn("score", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(featured)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("key", "doc", "i", "start", "found", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``; only texts with a candidate go through the join.

    Null and empty texts stay as they are, repeated rows repeated; all columns
    pass through, whatever their names; an empty table stays empty.
    """
    flags = (
        find_secrets(docs, id_col, text_col, path_col)
        .where("is_secret")
        .groupBy("key")
        .agg(F.collect_set("i").alias("secret_at"))
    )
    key, secret_at, names = unused(docs, "_secret_key"), unused(docs, "_secret_at"), docs.columns
    has = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    found, gaps = F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)), F.split(text_col, CANDIDATE, -1)
    rebuilt = F.concat(
        F.get(gaps, F.lit(0)),
        F.array_join(F.transform(found, lambda m, i: F.concat(F.when(F.array_contains(secret_at, i), F.lit(mark)).otherwise(m), F.get(gaps, i + 1))), ""),
    )
    some = docs.where(has).withColumn(key, _key(id_col, text_col, path_col)).join(flags.select(F.col("key").alias(key), F.col("secret_at").alias(secret_at)), key, "left")
    cleaned = some.withColumn(text_col, F.when(F.col(secret_at).isNull(), F.col(text_col)).otherwise(rebuilt)).select(*names)
    return docs.where(~has).unionByName(cleaned)
