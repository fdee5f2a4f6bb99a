"""Whole pipelines: prepare (E1), evaluate (E2), build sequences."""
