"""Sources and sinks: commit tables, diff files, chat JSONL, commit-shaped views of the test tables."""
