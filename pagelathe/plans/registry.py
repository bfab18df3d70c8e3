"""All queries of the library outside the optional subpackage, and their SQL oracles."""

from __future__ import annotations

from pagelathe.plans import columns, conversations, files, logs, pages, rects, reports, stores, workbench  # noqa: F401  they register their queries
from pagelathe.plans.catalog import QUERIES, SQL, Query

FLAGSHIP = "tag_counts"


def queries() -> dict[str, Query]:
    """Query name -> function."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL."""
    return dict(SQL)
