"""All registered queries of the engine."""

from strataweave.plans import queries_stores  # noqa: F401
from strataweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
