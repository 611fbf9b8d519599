"""All queries of the core and their SQL, from every module that registers some."""

from __future__ import annotations

from seiche import catalogue, catalogue_commands, catalogue_events, catalogue_functions, catalogue_products, catalogue_sources, queries  # noqa: F401 (they register theirs)

QUERIES = catalogue.QUERIES | queries.QUERIES
SQL = catalogue.SQL | queries.SQL
