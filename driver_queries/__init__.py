"""The operators applied to the driver tables, each beside its SQL counterpart."""

from . import domain, tables, workflows  # noqa: F401  (registers the queries)
from .registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
