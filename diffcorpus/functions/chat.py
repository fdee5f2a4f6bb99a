"""Chat records as ``array<struct<role, content>>`` Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SYSTEM_PROMPT
from .templates import ModelTemplate
from .text import _c, extract_diff, py_strip, user_message

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
CHAT_SCHEMA = T.StructType([T.StructField("messages", MESSAGES)])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def inference_messages(diff: Column | str, system_prompt: str = SYSTEM_PROMPT, max_chars: int = 12_000) -> Column:
    """System prompt and the user message holding the diff."""
    return F.array(message("system", F.lit(system_prompt)), message("user", user_message(diff, max_chars)))


def chat_example(
    diff: Column | str, msg: Column | str, system_prompt: str = SYSTEM_PROMPT, max_chars: int = 12_000
) -> Column:
    """System, user (diff prompt), assistant (stripped message)."""
    return F.array(
        message("system", F.lit(system_prompt)),
        message("user", user_message(diff, max_chars)),
        message("assistant", py_strip(msg)),
    )


def first_content(messages: Column | str, role: str) -> Column:
    """Content of the first message with ``role``; null when there is none."""
    return F.get(F.filter(_c(messages), lambda m: m["role"] == F.lit(role)), 0)["content"]


def parse_chat(messages: Column | str, strict: bool = False) -> Column:
    """``struct(diff, gold)`` from the first user and first assistant message.

    With ``strict`` a missing role or diff block raises, as the original does.
    """
    user = first_content(messages, "user")
    gold = first_content(messages, "assistant")
    if strict:
        user = F.coalesce(user, F.raise_error(F.lit("chat record has no user message")).cast("string"))
        gold = F.coalesce(gold, F.raise_error(F.lit("chat record has no assistant message")).cast("string"))
    return F.struct(extract_diff(user, strict).alias("diff"), gold.alias("gold"))


def prompt_messages(messages: Column | str) -> Column:
    """C4: all non-assistant messages, in order."""
    return F.filter(_c(messages), lambda m: m["role"] != F.lit("assistant"))


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each message; the default is the ChatML layout."""

    prefix: str = "<|im_start|>"
    role_sep: str = "\n"
    suffix: str = "<|im_end|>\n"
    generation_prompt: str = "<|im_start|>assistant\n"

    def render(self, messages: Column | str, add_generation_prompt: bool = False) -> Column:
        parts = F.transform(
            _c(messages),
            lambda m: F.concat(F.lit(self.prefix), m["role"], F.lit(self.role_sep), m["content"], F.lit(self.suffix)),
        )
        text = F.array_join(parts, "")
        return F.concat(text, F.lit(self.generation_prompt)) if add_generation_prompt else text


CHATML = ChatTemplate()


def render_chat(
    messages: Column | str, template: ChatTemplate | ModelTemplate = CHATML, add_generation_prompt: bool = False
) -> Column:
    """Q1: messages rendered to one text, optionally followed by the generation prompt.

    ``template``: plain parts around each message, or a model's own template.
    """
    return template.render(messages, add_generation_prompt)
