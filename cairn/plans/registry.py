"""All queries of the library on the driver's tables, and their SQL."""

from __future__ import annotations

from cairn.plans import document_queries, drift_queries, scalar_queries, segment_queries, table_queries  # noqa: F401  they register themselves
from cairn.plans.base import QUERIES, SQL

FLAGSHIP = "a9_chi_square"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
