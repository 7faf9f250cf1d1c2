"""All registered queries of the record operators and the SQL that each must agree with."""

from __future__ import annotations

from .plans import aggregates, claims, files, layout, learning, records, relational, reviews, texts  # noqa: F401
from .plans.base import ORACLES, QUERIES

FLAGSHIP = "a19_precision_recall"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
