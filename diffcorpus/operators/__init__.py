"""Table operators: filters, dedup, splits, ranks, scoring, sequences, contexts, generation."""
