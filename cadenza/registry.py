"""All queries of the reference's operators, by key."""

from cadenza.plans import aggregates, columns, files, rows, streams  # noqa: F401
from cadenza.plans.suite import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
