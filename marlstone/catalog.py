"""All queries of the library outside the language-model subpackage."""

from __future__ import annotations

from .plans import appearances, assembly, catalogs, edits, extraction, fills, listings, merges, models, pages, retrieval, scalars, setlists, states, texts, usage  # noqa: F401  registers queries
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
