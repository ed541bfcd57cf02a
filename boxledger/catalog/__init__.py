"""All registered queries. Importing this package fills the registry."""

from boxledger.catalog import cells, forms, guards, learning, pages, placement, rects, ruled, runs  # noqa: F401
from boxledger.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
