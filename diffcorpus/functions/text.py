"""Scalar text rules as native Column expressions (no Python UDF).

Every function takes and returns a ``Column``; they stay on the JVM and
compose into any select/filter.  Java's ``trim``, ``\\s``, ``.``, ``^`` and
``$`` differ from Python's ``str`` methods and ``re`` module, so the
character classes below spell out Python's behaviour explicitly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMMIT_TYPES, TRUNCATION_MARKER

# The characters Python's str.strip removes (str.isspace is true),
# in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Python's whitespace set (str.isspace / str.strip / re \s) and
# line boundaries (str.splitlines), written as Java regex classes.
WS_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WS_CLASS = r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


# The conventional-commit subject, the noise markers and the
# footer lines.  (?u) gives Unicode case folding as Python's re.IGNORECASE
# does; (?d) makes ^ follow "\n" only, as Python's MULTILINE does.
CONVENTIONAL_RE = r"(?d)\A(?:" + "|".join(COMMIT_TYPES) + r")(?:\([^)]+\))?: .+"
NOISE_RE = r"(?iud)https?://|www\.|(?m:^)signed-off-by:" + WS_CLASS
SIGNED_OFF_LINE_RE = r"(?iu)\Asigned-off-by:" + WS_CLASS
ISSUE_LINE_RE = r"(?iu)\A(?:fixes|closes|resolves)" + WS_CLASS + r"+#\p{Nd}+" + WS_CLASS + r"*\z"
DIFF_BLOCK_RE = r"(?s)```diff\n(.*?)```"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (bind through a one-element array)."""
    return F.get(F.transform(F.array(value), body), 0)


# --- T0 -------------------------------------------------------------------

def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes leading/trailing Unicode whitespace (a character-set trim)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def py_splitlines(c: Column | str) -> Column:
    """Python ``str.splitlines()`` (a trailing break leaves one extra ``''``)."""
    return F.split(_c(c), LINE_BREAK, -1)


def is_blank(c: Column | str) -> Column:
    """True when the text is empty or only whitespace (``not s.strip()``)."""
    return ~_c(c).rlike(NON_WS_CLASS)


# --- T1, F5, F4 -------------------------------------------------------------

def subject_line(c: Column | str) -> Column:
    """First non-blank line, stripped; ``''`` when there is none."""
    c = _c(c)
    first = F.get(F.filter(py_splitlines(c), lambda ln: ln.rlike(NON_WS_CLASS)), 0)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(py_strip(first), F.lit("")))


def is_conventional(c: Column | str) -> Column:
    """The subject line is ``type(scope): text`` with one of the ten types."""
    return subject_line(c).rlike(CONVENTIONAL_RE)


def has_noise(c: Column | str) -> Column:
    """A URL marker anywhere, or a line starting with ``signed-off-by:`` + whitespace."""
    return _c(c).rlike(NOISE_RE)


# --- T2, T3 -----------------------------------------------------------------

def _is_footer(line: Column) -> Column:
    s = py_strip(line)
    return s.rlike(SIGNED_OFF_LINE_RE) | s.rlike(ISSUE_LINE_RE)


def strip_footers(c: Column | str) -> Column:
    """Drop sign-off and lone issue-reference lines; blank lines become ``''``."""
    kept = F.filter(py_splitlines(c), lambda ln: ~(ln.rlike(NON_WS_CLASS) & _is_footer(ln)))
    lines = F.transform(kept, lambda ln: F.when(ln.rlike(NON_WS_CLASS), ln).otherwise(F.lit("")))
    return py_strip(F.array_join(lines, "\n"))


def clean_message(c: Column | str, max_lines: int = 3) -> Column:
    """Cleaned message (subject + up to ``max_lines - 1`` body lines) or null.

    Null when the raw text has noise, nothing is left after footer removal,
    or the first remaining line is not a conventional subject.
    """
    c = _c(c)

    def build(lines: Column) -> Column:
        subject = F.get(lines, 0)
        body = F.array_join(F.slice(lines, 2, max(max_lines - 1, 1)), "\n")
        out = F.when(F.size(lines) > 1, F.concat(subject, F.lit("\n\n"), body)).otherwise(subject)
        ok = (F.size(lines) > 0) & F.coalesce(py_strip(subject).rlike(CONVENTIONAL_RE), F.lit(False))
        if max_lines <= 1:
            out = subject
        return F.when(ok, out)

    nonblank = F.filter(F.split(strip_footers(c), "\n", -1), lambda ln: ln.rlike(NON_WS_CLASS))
    return F.when(c.isNull() | has_noise(c), F.lit(None).cast("string")).otherwise(let(nonblank, build))


# --- T4-T9 ------------------------------------------------------------------

def truncate_diff(c: Column | str, max_chars: int = 12_000) -> Column:
    c = _c(c)
    return F.when(F.length(c) <= max_chars, c).otherwise(
        F.concat(F.substring(c, 1, max_chars), F.lit(TRUNCATION_MARKER))
    )


def user_message(c: Column | str, max_chars: int = 12_000) -> Column:
    """``Diff:`` + a fenced ``diff`` block holding the truncated diff."""
    return F.concat(F.lit("Diff:\n```diff\n"), truncate_diff(c, max_chars), F.lit("\n```"))


def extract_diff(c: Column | str, strict: bool = False) -> Column:
    """Text of the first fenced ``diff`` block; null (or an error when strict) if none."""
    c = _c(c)
    found = F.regexp_extract(c, DIFF_BLOCK_RE, 1)
    missing = F.lit(None).cast("string")
    if strict:
        missing = F.raise_error(F.lit("the user message holds no fenced diff")).cast("string")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.rlike(DIFF_BLOCK_RE), found).otherwise(missing)


def norm_match(c: Column | str) -> Column:
    """Normalisation for exact-match scoring: strip, then lower-case."""
    return F.lower(py_strip(c))


def format_commit(type_: Column | str, scope: Column | str, description: Column | str) -> Column:
    """``type(scope): description``, or ``type: description`` when scope is null or empty."""
    t, s, d = _c(type_), _c(scope), _c(description)
    return F.when(F.coalesce(F.length(s) > 0, F.lit(False)), F.concat(t, F.lit("("), s, F.lit("): "), d)).otherwise(
        F.concat(t, F.lit(": "), d)
    )


def preview(c: Column | str, n: int = 200) -> Column:
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def valid_type(c: Column | str) -> Column:
    """the type is one of the ten conventional-commit types."""
    return _c(c).isin(*COMMIT_TYPES)
