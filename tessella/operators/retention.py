"""What is kept and what has expired, at an explicit moment in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def present_peers(peers: DataFrame, as_of_s: int, ttl_s: int = 300) -> DataFrame:
    return peers.where(F.lit(as_of_s) - F.col("last_seen_s") < ttl_s)


def kept_sessions(sessions: DataFrame, as_of_s: int, days: int = 7) -> DataFrame:
    """Without completed sessions older than that."""
    return sessions.where(~((F.col("status") == "Completed") & (F.lit(as_of_s) - F.col("updated_s") > days * DAY)))


def can_resume(checkpoints: DataFrame, as_of_s: int, hours: int = 24) -> DataFrame:
    return checkpoints.where((F.lit(as_of_s) - F.col("updated_s") < hours * 3600) & (F.col("progress") < 100))


def timed_out(transfers: DataFrame, as_of_s: int, idle_s: int) -> DataFrame:
    return transfers.where((F.col("status") == "Active") & (F.lit(as_of_s) - F.col("updated_s") > idle_s))
