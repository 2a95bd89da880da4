"""Named queries over the driver's tables, with their SQL."""

from . import findings, queries  # noqa: F401  they fill the registry
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
