"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

from pathfold.plans import candidate_queries, learning_queries, ledger_queries, more_queries, prep_queries, router_queries, routing_queries, source_queries, streaming_queries, uncertainty_queries  # noqa: F401
from pathfold.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
