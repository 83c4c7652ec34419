"""Every query of the engine's own operators by key, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .plans import q_composites, q_exports, q_groups, q_lists, q_reviews, q_scalars, q_sources, q_streams  # noqa: F401  (importing them registers their queries)
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
