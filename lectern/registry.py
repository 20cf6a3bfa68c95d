"""All registered queries and their SQL."""

from __future__ import annotations

from lectern.plans import desk_queries, evidence_queries, record_queries  # noqa: F401
from lectern.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
