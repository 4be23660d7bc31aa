"""All queries over the driver's tables, and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from genoloom.plans import editing_queries, feature_queries, hit_queries, interval_queries, location_queries, model_queries, record_queries, relation_queries, scan_queries, sequence_queries, source_queries

_MODULES = (hit_queries, interval_queries, sequence_queries, feature_queries, location_queries, model_queries, record_queries, relation_queries, scan_queries, source_queries, editing_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
