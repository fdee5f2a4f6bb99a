"""Column and SQL functions: text rules (T/F), chat records (C/Q1), SQL registration."""
