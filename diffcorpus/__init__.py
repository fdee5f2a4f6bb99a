"""Commit-corpus curation and scoring on Spark.

The public surface, by stage:

* text rules (Columns): ``functions.text`` -- py_strip, subject_line,
  is_conventional, has_noise, strip_footers, clean_message, truncate_diff,
  user_message, extract_diff, norm_match, format_commit, preview
* chat records (Columns): ``functions.chat`` -- chat_example,
  inference_messages, parse_chat, prompt_messages, render_chat
* SQL functions: ``functions.register.register(spark)``
* table operators: ``operators.curate`` (filters, dedup_keep_first,
  filter_funnel), ``operators.splits``, ``operators.scoring``,
  ``operators.sequences``, ``operators.contexts``, ``operators.generation``
* sources and sinks: ``sources.commits``, ``sources.chat_jsonl``
* pipelines: ``plans.prepare``, ``plans.evaluate``, ``plans.sequences``
* streams: ``streaming.prompts``, ``streaming.curate``
"""

from .config import COMMIT_TYPES, DEFAULT, SYSTEM_PROMPT, Config

__all__ = ["COMMIT_TYPES", "DEFAULT", "SYSTEM_PROMPT", "Config"]
