"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, exact_dedup, html_extract, language_id, lm_score, mixing, ngram_join, sentencepieces, substring_dedup, token_counts

_MODULES = (sentencepieces, ngram_join, mixing, exact_dedup, html_extract, substring_dedup, token_counts, lm_score, language_id, ann)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
