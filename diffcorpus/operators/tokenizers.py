"""Tokenizers for sequence building (Q2): ids and id counts of a text column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequences


@dataclass(frozen=True)
class CodepointTokenizer:
    """Native tokenizer: one id per code point; pad 0 falls back to ``eos_id``."""

    pad_id: int | None = 0
    eos_id: int | None = 3

    def ids(self, text: Column, limit: int | None = None) -> Column:
        """Of the first ``limit`` tokens at least; one token a code point, so the text is cut before it is split."""
        return sequences.tokenize_codepoints(F.left(text, F.lit(limit)) if limit else text)

    def count(self, text: Column) -> Column:
        return F.length(text)


class UdfTokenizer:
    """Any tokenizer given as a batch ``encode(texts) -> id lists`` (Arrow UDF).

    ``encode`` runs on the workers; build heavy state lazily inside it.
    """

    def __init__(self, encode, pad_id: int | None, eos_id: int | None):
        self.encode, self.pad_id, self.eos_id = encode, pad_id, eos_id
        self._count = sequences.tokenizer_udf(encode, count=True)

    def ids(self, text: Column, limit: int | None = None) -> Column:
        return sequences.tokenizer_udf(self.encode, limit)(text)

    def count(self, text: Column) -> Column:
        return F.coalesce(self._count(text), F.size(F.lit(None).cast(sequences.IDS)))
