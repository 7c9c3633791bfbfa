"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat, conversation_repair, decontaminate, language_id, line_dedup, ngram_join, periodic_runs
from tidemark.llm import quality_classifier, quality_rules, simhash, suffix_dedup, token_counts

_GROUPS = (
    *(ngram_join, suffix_dedup, quality_classifier, language_id, bpe, token_counts, line_dedup, decontaminate, chat),
    *(quality_rules, conversation_repair, periodic_runs, simhash),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLE.items() if sql}
