"""All registered queries and their SQL."""

from __future__ import annotations

from lociframe.plans import catalog_ase, catalog_curves, catalog_files, catalog_records, catalog_stats

_PARTS = (catalog_files, catalog_records, catalog_ase, catalog_curves, catalog_stats)


def queries():
    return {name: fn for part in _PARTS for name, fn in part.register.queries.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.register.sql.items()}
