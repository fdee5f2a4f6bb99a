"""The scalar rules as SQL temporary functions (SQL bodies, no Python UDF).

The bodies use the same regex constants as the Column functions; a test
checks both surfaces give equal results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import COMMIT_TYPES, IGNORE_LABEL, SYSTEM_PROMPT, TRUNCATION_MARKER
from . import text as T
from .chat import CHATML, ChatTemplate

_MESSAGES = "ARRAY<STRUCT<role STRING, content STRING>>"
_TURNS = "ARRAY<STRUCT<turn INT, role STRING, text STRING>>"
_IDS = "ARRAY<INT>"


def _lit(s: str) -> str:
    """Raw SQL string literal (no escape processing)."""
    if "'" in s:
        raise ValueError("quote in literal")
    return "r'" + s + "'"


def _str(s: str) -> str:
    """SQL string literal for arbitrary text (built with chr for control chars)."""
    parts = []
    buf = ""
    for ch in s:
        if ch == "'" or ord(ch) < 32:
            if buf:
                parts.append("'" + buf + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append("'" + buf + "'")
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else (parts[0] if parts else "''")


def _unicode_lit(chars: str) -> str:
    """SQL string literal spelling every character as a ``\\uXXXX`` escape."""
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in chars) + "'"


def _message(role: str, content: str) -> str:
    return f"named_struct('role', '{role}', 'content', {content})"


def chat_bodies(system_prompt: str = SYSTEM_PROMPT, template: ChatTemplate = CHATML) -> dict[str, str]:
    """C1-C5, Q1, Q3, Q4 over arrays of structs.

    ``py_conversation_contexts`` takes the turns of one conversation;
    ``py_contexts`` is the same as a table function, for ``LATERAL``.  For
    conversations without a bound use ``operators.contexts``.
    """
    system, t = _str(system_prompt), template
    ask, answer = _message("user", "py_user_message(diff)"), _message("assistant", "py_strip(msg)")
    wrapped = f"concat({_str(t.prefix)}, m.role, {_str(t.role_sep)}, m.content, {_str(t.suffix)})"
    # a function cannot be called on a lambda's variable: its body stands here
    strip = f"btrim(t.text, {_unicode_lit(T.PY_WHITESPACE)})"
    said = f"named_struct('role', t.role, 'content', {strip})"
    user, word = "t.role = 'user'", f"lower({strip})"
    none = f"CAST(array() AS {_MESSAGES})"
    found = f"ARRAY<STRUCT<turn INT, messages {_MESSAGES}>>"
    step = (
        "CASE WHEN s.over OR t.role IS NULL OR t.role NOT IN ('user', 'assistant') THEN s "
        f"WHEN {user} AND {word} = 'q' THEN named_struct('past', s.past, 'over', true, 'found', s.found) "
        f"WHEN {user} AND {word} = 'r' THEN named_struct('past', {none}, 'over', false, 'found', s.found) "
        f"WHEN {user} AND NOT (t.text RLIKE {_lit(T.NON_WS_CLASS)}) THEN s "
        "ELSE named_struct('past', concat(s.past, array({said})), 'over', false, 'found', "
        f"CASE WHEN {user} THEN concat(s.found, array(named_struct('turn', t.turn, 'messages', concat(array({_message('system', system)}), s.past, array({{said}}))))) ELSE s.found END) END"
    ).replace("{said}", said)
    start = f"named_struct('past', {none}, 'over', false, 'found', CAST(array() AS {found}))"
    contexts = f"aggregate(array_sort(turns), {start}, (s, t) -> {step}, s -> s.found)"
    cut = "slice(ids, 1, max_len)"
    masked = f"least(prompt_len, size({cut}))"
    return {
        f"py_chat_example(diff STRING, msg STRING) RETURNS {_MESSAGES}": f"array({_message('system', system)}, {ask}, {answer})",
        f"py_inference_messages(diff STRING) RETURNS {_MESSAGES}": f"array({_message('system', system)}, {ask})",
        f"py_first_content(messages {_MESSAGES}, wanted STRING) RETURNS STRING": "get(filter(messages, m -> m.role = wanted), 0).content",
        f"py_parse_chat(messages {_MESSAGES}) RETURNS STRUCT<diff STRING, gold STRING>": (
            "named_struct('diff', py_extract_diff(py_first_content(messages, 'user')), 'gold', py_first_content(messages, 'assistant'))"
        ),
        f"py_prompt_messages(messages {_MESSAGES}) RETURNS {_MESSAGES}": "filter(messages, m -> m.role != 'assistant')",
        f"py_render_chat(messages {_MESSAGES}, generation BOOLEAN) RETURNS STRING": (
            f"concat(array_join(transform(messages, m -> {wrapped}), ''), CASE WHEN generation THEN {_str(t.generation_prompt)} ELSE '' END)"
        ),
        f"py_tokenize_codepoints(s STRING) RETURNS {_IDS}": f"CASE WHEN s = '' THEN CAST(array() AS {_IDS}) ELSE transform(split(s, '', -1), x -> ascii(x)) END",
        f"py_attention_mask(ids {_IDS}) RETURNS {_IDS}": "array_repeat(1, size(ids))",
        f"py_mask_labels(ids {_IDS}, prompt_len INT, max_len INT) RETURNS STRUCT<input_ids {_IDS}, attention_mask {_IDS}, labels {_IDS}>": (
            f"named_struct('input_ids', {cut}, 'attention_mask', array_repeat(1, size({cut})), 'labels', "
            f"concat(array_repeat({IGNORE_LABEL}, {masked}), slice({cut}, {masked} + 1, greatest(size({cut}) - {masked}, 0))))"
        ),
        f"py_conversation_contexts(turns {_TURNS}) RETURNS {found}": contexts,
        f"py_contexts(turns {_TURNS}) RETURNS TABLE(turn INT, messages {_MESSAGES})": f"SELECT c.turn, c.messages FROM (SELECT explode({contexts}) AS c)",
    }


def function_bodies(max_diff_chars: int = 12_000, preview_len: int = 200, max_lines: int = 3) -> dict[str, str]:
    ws = _unicode_lit(T.PY_WHITESPACE)
    strip = f"btrim(s, {ws})"
    nonblank = f"{_lit(T.NON_WS_CLASS)}"
    footer = f"(btrim(l, {ws}) RLIKE {_lit(T.SIGNED_OFF_LINE_RE)} OR btrim(l, {ws}) RLIKE {_lit(T.ISSUE_LINE_RE)})"
    strip_footers = (
        f"btrim(array_join(transform(filter(split(s, {_lit(T.LINE_BREAK)}, -1), "
        f"l -> NOT (l RLIKE {nonblank} AND {footer})), l -> CASE WHEN l RLIKE {nonblank} THEN l ELSE '' END), "
        f"chr(10)), {ws})"
    )
    subject = (
        f"CASE WHEN s IS NULL THEN NULL ELSE coalesce(btrim(get(filter(split(s, {_lit(T.LINE_BREAK)}, -1), "
        f"l -> l RLIKE {nonblank}), 0), {ws}), '') END"
    )
    lines = f"filter(split(py_strip_footers(s), chr(10), -1), l -> l RLIKE {nonblank})"
    clean = (
        f"CASE WHEN s IS NULL OR s RLIKE {_lit(T.NOISE_RE)} THEN NULL ELSE get(transform(array({lines}), ls -> "
        f"CASE WHEN size(ls) > 0 AND btrim(get(ls, 0), {ws}) RLIKE {_lit(T.CONVENTIONAL_RE)} "
        f"THEN CASE WHEN size(ls) > 1 THEN concat(get(ls, 0), chr(10), chr(10), array_join(slice(ls, 2, {max(max_lines - 1, 1)}), chr(10))) "
        f"ELSE get(ls, 0) END END), 0) END"
    )
    trunc = (
        f"CASE WHEN length(s) <= {max_diff_chars} THEN s ELSE concat(substring(s, 1, {max_diff_chars}), "
        f"{_str(TRUNCATION_MARKER)}) END"
    )
    types = ", ".join(f"'{t}'" for t in COMMIT_TYPES)
    return {
        "py_strip(s STRING) RETURNS STRING": strip,
        "py_is_blank(s STRING) RETURNS BOOLEAN": f"NOT (s RLIKE {nonblank})",
        "py_subject_line(s STRING) RETURNS STRING": subject,
        "py_is_conventional(s STRING) RETURNS BOOLEAN": f"py_subject_line(s) RLIKE {_lit(T.CONVENTIONAL_RE)}",
        "py_has_noise(s STRING) RETURNS BOOLEAN": f"s RLIKE {_lit(T.NOISE_RE)}",
        "py_strip_footers(s STRING) RETURNS STRING": strip_footers,
        "py_clean_message(s STRING) RETURNS STRING": clean,
        "py_truncate_diff(s STRING) RETURNS STRING": trunc,
        "py_user_message(s STRING) RETURNS STRING": (
            f"concat('Diff:', chr(10), '```diff', chr(10), py_truncate_diff(s), chr(10), '```')"
        ),
        "py_extract_diff(s STRING) RETURNS STRING": (
            f"CASE WHEN s RLIKE {_lit(T.DIFF_BLOCK_RE)} THEN regexp_extract(s, {_lit(T.DIFF_BLOCK_RE)}, 1) END"
        ),
        "py_norm_match(s STRING) RETURNS STRING": f"lower({strip})",
        "py_format_commit(t STRING, sc STRING, d STRING) RETURNS STRING": (
            "CASE WHEN coalesce(length(sc) > 0, false) THEN concat(t, '(', sc, '): ', d) ELSE concat(t, ': ', d) END"
        ),
        "py_diff_preview(s STRING) RETURNS STRING": (
            f"CASE WHEN length(s) > {preview_len} THEN concat(substring(s, 1, {preview_len}), '...') ELSE s END"
        ),
        "py_valid_commit_type(t STRING) RETURNS BOOLEAN": f"t IN ({types})",
    }


def register(spark: SparkSession, **params) -> list[str]:
    """Create the temporary SQL functions in ``spark``; returns their names."""
    names = []
    chat = {k: params.pop(k) for k in ("system_prompt", "template") if k in params}
    for sig, body in (function_bodies(**params) | chat_bodies(**chat)).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURN {body}")
        names.append(sig.split("(")[0])
    return names
