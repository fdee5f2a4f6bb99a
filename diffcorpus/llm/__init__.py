"""Training-data operators: filters, near-duplicate search, scoring and tokenizing at corpus scale."""
