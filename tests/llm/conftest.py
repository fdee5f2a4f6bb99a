import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, fp long, score double, ids array<int>, w long, row long, key long, label int, decoded int"


def frame(spark, rows, schema=SCHEMA):
    """Documents with columns whose names the operators use inside; rows are (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        r = (*r, *("en", "src0")[len(r) - 2 :])
        full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), "x", 1, 0.5, [1], 2, 3, 4, 1, 5))
    return spark.createDataFrame(full, schema)


@pytest.fixture()
def docs(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture()
def odd(docs):
    """Nulls in every column that is read, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 700} Passage{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "some text here"), (None, None), (4, " \n\t "), (5, "...!!!"), (6, long), (7, "é ü ß 日本 😀", None, None), (8, "one")]
    return docs(rows)


@pytest.fixture()
def empty(docs):
    return docs([(1, "x")]).limit(0)
