"""Named queries over the test tables with their SQL checks."""

from armlens.catalogue import log_queries, request_queries, text_queries  # noqa: F401
from armlens.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
