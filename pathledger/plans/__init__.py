"""Queries over the given tables, one per operator."""

from pathledger.plans import (  # noqa: F401  (importing registers the queries)
    filtering,
    reporting,
    scalars,
    snapshots,
    storage,
    streams,
)
from pathledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
