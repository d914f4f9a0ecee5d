"""All queries of the engine and their oracles, by inventory ID."""

from __future__ import annotations

from martlens.queries import customers, dataquality, models, streams, warehouse

MODULES = [warehouse, dataquality, customers, models, streams]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
