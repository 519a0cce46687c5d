"""Names of the queries over the test tables, with their DuckDB equivalents."""

from __future__ import annotations

from sagebeam.plans import catalog, curation, fields, quality, ranking, release
from sagebeam.plans.tables import Entry, Query

_ALL: dict[str, Entry] = ranking.QUERIES | catalog.QUERIES | curation.QUERIES | quality.QUERIES | release.QUERIES | fields.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
