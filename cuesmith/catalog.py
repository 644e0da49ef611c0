"""The library's queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import feedback_queries, fusion_queries, ledger_queries, lexicon_queries, media_queries, pair_queries, record_queries, rule_queries, source_queries, stateful_queries, stream_queries, text_queries, timeline_queries  # noqa: F401
from .plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
