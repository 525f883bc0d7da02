"""Every registered query over the given tables."""

from sluicegate.catalog import data_queries, detector_queries, text_queries  # noqa: F401
from sluicegate.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
