"""Both the engine and the oracle SQL take these from one module: a slip there would pass every comparison."""

import hashlib

from diffcorpus import config


def test_fixed_values():
    assert config.COMMIT_TYPES == ("feat", "fix", "chore", "refactor", "docs", "test", "style", "perf", "build", "ci")
    assert len(config.SYSTEM_PROMPT) == 420 and hashlib.md5(config.SYSTEM_PROMPT.encode()).hexdigest() == "c7f1a36af2bc44df5a26e2e9b512089b"
    assert config.TRUNCATION_MARKER == "\n... [diff truncated]" and config.IGNORE_LABEL == -100
    d = config.DEFAULT
    assert (d.min_diff_len, d.max_diff_chars, d.max_seq_length, d.batch_size, d.val_batches, d.eval_n, d.eval_seed) == (20, 12_000, 2048, 2, 25, 100, 42)
