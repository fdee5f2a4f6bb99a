"""Pipeline parameters, one frozen dataclass with the defaults of the original tool."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the original tool for identical results.
COMMIT_TYPES = ("feat", "fix", "chore", "refactor", "docs", "test", "style", "perf", "build", "ci")

SYSTEM_PROMPT = (
    "You are a commit message generator. Given a git diff, write a "
    "Conventional Commit message. Start with a subject line: "
    "type(scope): description (scope optional). Valid types are: feat, fix, "
    "chore, refactor, docs, test, style, perf, build, ci. You may add up to "
    "2 short body lines after a blank line if the change needs brief context. "
    "Do not include footers, issue references, URLs, or any text outside the "
    "commit message."
)

TRUNCATION_MARKER = "\n... [diff truncated]"
IGNORE_LABEL = -100
SPLIT_NAMES = ("train", "valid", "test")
# Curated split values and the output split they map to.
CURATED_SPLITS = {"train": "train", "val": "valid", "validation": "valid", "test": "test"}


@dataclass(frozen=True)
class Config:
    diff_col: str = "diff"
    message_col: str = "message"
    split_col: str = "split"
    min_diff_len: int = 20
    min_message_len: int = 10
    max_message_len: int = 500
    max_diff_chars: int = 12_000
    max_commit_lines: int = 3
    train_ratio: float = 0.8
    valid_ratio: float = 0.1
    seed: int = 42
    eval_n: int = 100
    eval_seed: int = 42
    preview_len: int = 200
    examples_k: int = 5
    max_seq_length: int = 2048
    batch_size: int = 2
    val_batches: int = 25
    small_corpus: int = 200
    system_prompt: str = SYSTEM_PROMPT


DEFAULT = Config()
