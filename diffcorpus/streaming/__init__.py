"""Structured Streaming: prompts from arriving diffs (W1) and curation."""
