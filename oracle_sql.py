"""DuckDB SQL for the correctness oracle: the same rules written for RE2 / DuckDB.

Independent of the Spark code path: regexes are restated in RE2 syntax
(``\\x{...}`` code points, no look-behind) and every step is plain SQL over
the driver views.
"""

from __future__ import annotations

from diffcorpus.config import COMMIT_TYPES, SYSTEM_PROMPT
from diffcorpus.sources.driver_tables import cte

# Python whitespace and line boundaries in RE2 syntax.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = "[^" + WS[1:]
LB = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
CONV = r"\A(?:" + "|".join(COMMIT_TYPES) + r")(?:\([^)]+\))?: .+"
NOISE = r"(?i)https?://|www\.|(?m:^)signed-off-by:" + WS
SIGNED = r"(?i)\Asigned-off-by:" + WS
ISSUE = r"(?i)\A(?:fixes|closes|resolves)" + WS + r"+#\p{Nd}+" + WS + r"*\z"
BLOCK = r"(?s)```diff\n(.*?)```"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(chr(92) + 'A' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def nonblank(x: str) -> str:
    return f"regexp_matches({x}, {q(NON_WS)})"


def subject(x: str) -> str:
    first = f"list_filter(string_split_regex({x}, {q(LB)}), lambda l: {nonblank('l')})[1]"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce({strip(first)}, '') END)"


def conventional(x: str) -> str:
    return f"regexp_matches({subject(x)}, {q(CONV)})"


def noise(x: str) -> str:
    return f"regexp_matches({x}, {q(NOISE)})"


def strip_footers(x: str) -> str:
    footer = f"(regexp_matches({strip('l')}, {q(SIGNED)}) OR regexp_matches({strip('l')}, {q(ISSUE)}))"
    kept = f"list_filter(string_split_regex({x}, {q(LB)}), lambda l: NOT ({nonblank('l')} AND {footer}))"
    lines = f"list_transform({kept}, lambda l: CASE WHEN {nonblank('l')} THEN l ELSE '' END)"
    return strip(f"array_to_string({lines}, {NL})")


def clean(x: str, max_lines: int = 3) -> str:
    lines = f"list_filter(string_split({strip_footers(x)}, {NL}), lambda l: {nonblank('l')})"
    body = (
        f"CASE WHEN len(ls) > 0 AND regexp_matches({strip('ls[1]')}, {q(CONV)}) THEN "
        f"CASE WHEN len(ls) > 1 THEN ls[1] || {NL} || {NL} || array_to_string(ls[2:{max_lines}], {NL}) ELSE ls[1] END END"
    )
    return f"(CASE WHEN {x} IS NULL OR {noise(x)} THEN NULL ELSE list_transform([{lines}], lambda ls: {body})[1] END)"


def truncate(x: str, n: int = 12_000) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE substring({x}, 1, {n}) || {NL} || '... [diff truncated]' END)"


def user_message(x: str) -> str:
    return f"('Diff:' || {NL} || '```diff' || {NL} || {truncate(x)} || {NL} || '```')"


def extract(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {q(BLOCK)}) THEN regexp_extract({x}, {q(BLOCK)}, 1) END)"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def preview(x: str, n: int = 200) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END)"


def format_commit(t: str, s: str, d: str) -> str:
    return f"(CASE WHEN coalesce(length({s}) > 0, false) THEN {t} || '(' || {s} || '): ' || {d} ELSE {t} || ': ' || {d} END)"


def msg(role: str, content: str) -> str:
    return f"{{'role': {q(role)}, 'content': {content}}}"


def chat(diff: str, message: str) -> str:
    return f"[{msg('system', q(SYSTEM_PROMPT))}, {msg('user', user_message(diff))}, {msg('assistant', strip(message))}]"


def inference(diff: str) -> str:
    return f"[{msg('system', q(SYSTEM_PROMPT))}, {msg('user', user_message(diff))}]"


def seeded(col: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


CURATED = (
    "CASE split WHEN 'train' THEN 'train' WHEN 'val' THEN 'valid' WHEN 'validation' THEN 'valid' "
    "WHEN 'test' THEN 'test' END"
)

BASIC = """basic AS (
  SELECT * FROM commits
  WHERE diff IS NOT NULL AND message IS NOT NULL AND length(diff) >= 20 AND length(message) BETWEEN 10 AND 500
),
dedup AS (SELECT * FROM basic QUALIFY row_number() OVER (PARTITION BY diff ORDER BY row_id) = 1)"""

CLEAN = (
    BASIC
    + f""",
cleaned AS (SELECT row_id, diff, {clean('message')} AS message, split FROM dedup),
clean AS (SELECT * FROM cleaned WHERE message IS NOT NULL)"""
)

PREPARED = (
    CLEAN
    + f""",
mode AS (
  SELECT CASE WHEN count(DISTINCT split) + coalesce(max(CASE WHEN split IS NULL THEN 1 ELSE 0 END), 0) <= 1
         THEN 'random' ELSE 'curated' END AS m FROM clean
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {seeded('row_id')}, row_id) - 1 AS rk, count(*) OVER () AS n FROM clean
),
prepared0 AS (
  SELECT row_id, diff, message,
    CASE WHEN (SELECT m FROM mode) = 'curated' THEN {CURATED}
         WHEN rk < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
         WHEN rk < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'valid'
         ELSE 'test' END AS split
  FROM ranked
),
prepared AS (SELECT * FROM prepared0 WHERE split IS NOT NULL)"""
)

GOLD = (
    PREPARED
    + f""",
gold AS (SELECT row_id, {extract(user_message('diff'))} AS diff, {strip('message')} AS gold FROM prepared WHERE split = 'test'),
scored AS (
  SELECT p.run_id, g.row_id, g.diff, g.gold, p.prediction,
    coalesce({conventional('p.prediction')}, false) AS conventional,
    coalesce({norm('p.prediction')} = {norm('g.gold')}, false) AS exact_match
  FROM gold g JOIN predictions p ON g.row_id = p.row_id
)"""
)

SUMMARY_COLS = """count(*) AS n, CAST(count_if(conventional) AS BIGINT) AS conventional,
  CAST(count_if(conventional) AS DOUBLE) / count(*) AS conventional_rate,
  CAST(count_if(exact_match) AS BIGINT) AS exact, CAST(count_if(exact_match) AS DOUBLE) / count(*) AS exact_rate"""


def with_views(*names: str) -> str:
    """``WITH`` the driver-derived views, ready for more CTEs after a comma."""
    return cte(*names).rstrip()

