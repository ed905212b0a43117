"""The engine's registered queries."""

from __future__ import annotations

from .plans import queries as plans

FLAGSHIP = plans.pdf_extract_runs


def queries() -> dict:
    return plans.queries()


def oracle_sql() -> dict[str, str]:
    return plans.oracle_sql()
