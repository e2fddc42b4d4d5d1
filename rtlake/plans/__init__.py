"""Queries bound to the driver's tables, and the jobs that build and refresh an index."""

from rtlake.plans import more, relational, sample, scalars, wider
from rtlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "more", "relational", "sample", "scalars", "wider"]
