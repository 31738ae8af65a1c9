"""The named queries and their SQL."""

from . import activity, snapshots, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "activity", "snapshots", "tables"]
