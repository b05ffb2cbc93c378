"""All queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import catalogue, catalogue_pages, catalogue_store

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_pages", "catalogue_store"]
