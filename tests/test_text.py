"""Hand-written cases and exhaustive code-point checks."""

import sys

from pyspark.sql import functions as F

from helpers import apply, one_col
from diffcorpus.functions import text as T


def _all_code_points():
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def test_whitespace_class_equals_python_isspace(spark):
    chars = _all_code_points()
    df = spark.createDataFrame([(ord(c), c) for c in chars], "cp INT, s STRING")
    blank = {r.cp for r in df.where(T.is_blank("s")).select("cp").collect()}
    assert blank == {ord(c) for c in chars if c.isspace()}
    stripped = {r.cp for r in df.where(T.py_strip(F.concat(F.col("s"), F.lit("a"), F.col("s"))) == "a").select("cp").collect()}
    assert stripped == blank


def test_line_breaks_equal_python_splitlines(spark):
    chars = _all_code_points()
    df = spark.createDataFrame([(ord(c), "a" + c + "b") for c in chars], "cp INT, s STRING")
    breaks = {r.cp for r in df.where(F.size(T.py_splitlines("s")) == 2).select("cp").collect()}
    assert breaks == {ord(c) for c in chars if len(("a" + c + "b").splitlines()) == 2}
    assert apply(spark, lambda c: F.size(T.py_splitlines(c)), ["a\r\nb"]) == [2]


def test_strip_on_long_inner_runs(spark):
    s = "x" + " " * 5000 + "y" + " \t\n"
    assert apply(spark, T.py_strip, [s, "", "   ", None]) == ["x" + " " * 5000 + "y", "", "", None]


def test_subject_line(spark):
    assert apply(spark, T.subject_line, ["\n \n  feat: a  \nb", "", "  \n\t", None, "x\u2028y"]) == [
        "feat: a",
        "",
        "",
        None,
        "x",
    ]


def test_is_conventional(spark):
    vals = ["feat: x", "feat(core): x", "feat!: x", "revert: x", "Feat: x", "feat():x", "feat: ", "fix(a b): y", "ci: x"]
    assert apply(spark, T.is_conventional, vals) == [True, True, False, False, False, False, False, True, True]


def test_has_noise(spark):
    vals = [
        "see HTTPS://x",
        "www.example",
        "www-free",
        "a\nsigned-off-by: x",
        "a\n  signed-off-by: x",  # indented: column 0 only
        "a\rsigned-off-by: x",  # Python ^ follows \n only
        "a\u2028Signed-off-by: x",
        "a\nſigned-off-by: x",  # U+017F folds to s
        "a\nsigned-off-by:",
        "a\nsigned-off-by:\u3000x",
    ]
    assert apply(spark, T.has_noise, vals) == [True, True, False, True, False, False, False, True, False, True]


def test_strip_footers(spark):
    vals = [
        "feat: a\n\nFixes #12",
        "feat: a\n  Signed-off-by: B <b@x>\nbody",
        "feat: a\nFixes: #1",
        "feat: a\nFixes #1, #2",
        "feat: a\nsigned-off-by:",
        "feat: a\n \nb",
        "feat: a\rresolves   #7  ",
        "feat: a\nCloses #١٢",  # Arabic-Indic digits are \d in Python
        "feat: a\nFıxes #3",  # U+0131 folds to i under Python's IGNORECASE
        "",
    ]
    assert apply(spark, T.strip_footers, vals) == [
        "feat: a",
        "feat: a\nbody",
        "feat: a\nFixes: #1",
        "feat: a\nFixes #1, #2",
        "feat: a\nsigned-off-by:",
        "feat: a\n\nb",
        "feat: a",
        "feat: a",
        "feat: a",
        "",
    ]


def test_clean_message_fixture_kinds(spark):
    vals = [
        "feat(src0): add de",
        "fix: handle en\n\nBody one src1\nBody two\nBody three",
        "docs: see HTTPS://example.com/src2",
        "chore: bump src3\n\nsigned-off-by: A <a@x>",
        "Update readme src4",
        "refactor: split es\n\nFixes #5",
        "feat!: breaking src6",
        "Closes #10\ntest(unit): cover en",
        "style: tidy src11   \n\n  indented body  ",
        "  build: trim me es\n  Signed-off-by: B <b@x>\nwww-free body",
        None,
        "Fixes #1\n\n  \n",
    ]
    assert apply(spark, T.clean_message, vals) == [
        "feat(src0): add de",
        "fix: handle en\n\nBody one src1\nBody two",
        None,
        None,
        None,
        "refactor: split es",
        None,
        "test(unit): cover en",
        "style: tidy src11   \n\n  indented body",
        "build: trim me es\n\nwww-free body",
        None,
        None,
    ]


def test_clean_message_exotic_breaks(spark):
    vals = ["feat: x\rsigned-off-by: y", "feat: x\u2028Signed-off-by: y", "feat: x\x1cbody\x85two\u2029three"]
    assert apply(spark, T.clean_message, vals) == ["feat: x", "feat: x", "feat: x\n\nbody\ntwo"]


def test_truncate_and_user_message(spark):
    d12000 = "a" * 11_999 + "\U0001F600"
    d12001 = "b" * 12_001
    out = apply(spark, T.truncate_diff, [d12000, d12001, "short"])
    assert out[0] == d12000
    assert out[1] == "b" * 12_000 + "\n... [diff truncated]"
    assert out[2] == "short"
    assert apply(spark, T.user_message, ["x"]) == ["Diff:\n```diff\nx\n```"]


def test_extract_diff_round_trip(spark):
    msgs = ["Diff:\n```diff\nabc\n```", "Diff:\n```diff\na```b\n```", "no block", "```diff\n```", None]
    assert apply(spark, T.extract_diff, msgs) == ["abc\n", "a", None, "", None]
    d = "c" * 12_000
    wrapped = apply(spark, lambda c: T.extract_diff(T.user_message(c)), [d])[0]
    assert wrapped == d + "\n"


def test_extract_diff_strict_raises(spark):
    import pytest

    df = one_col(spark, ["no block"])
    with pytest.raises(Exception):
        df.select(T.extract_diff("s", strict=True)).collect()


def test_norm_match_and_preview(spark):
    assert apply(spark, T.norm_match, ["  Feat: X\n", "ΟΔΟΣ", None]) == ["feat: x", "οδος", None]
    assert apply(spark, T.preview, ["a" * 200, "a" * 201]) == ["a" * 200, "a" * 200 + "..."]


def test_format_commit_and_valid_type(spark):
    df = spark.createDataFrame(
        [("feat", None, "x"), ("fix", "", "y"), ("docs", "api", "z"), ("Feature", "a", "w")], "t STRING, s STRING, d STRING"
    )
    rows = df.select(T.format_commit("t", "s", "d").alias("f"), T.valid_type("t").alias("v")).collect()
    assert [r.f for r in rows] == ["feat: x", "fix: y", "docs(api): z", "Feature(a): w"]
    assert [r.v for r in rows] == [True, True, True, False]


def test_no_python_in_text_plans(spark):
    df = one_col(spark, ["feat: a"]).select(
        T.clean_message("s"), T.user_message("s"), T.extract_diff("s"), T.norm_match("s"), T.subject_line("s")
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BatchEval" not in plan


def test_case_folding_edges(spark):
    """Dotted / dotless i, long s: Python's IGNORECASE folds them to the ASCII letters."""
    vals = ["feat: a\nfİxes #1", "feat: a\nfıxes #1", "feat: a\ncloſes #1", "feat: a\nFIXES #1"]
    assert apply(spark, T.strip_footers, vals) == ["feat: a"] * 4
    assert apply(spark, T.has_noise, ["a\nsİgned-off-by: x", "WWW.x", "htTpS://y", "feat: K"]) == [True, True, True, False]
