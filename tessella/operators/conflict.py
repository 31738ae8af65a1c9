"""Conflicting edits of two folders and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicts(local: DataFrame, remote: DataFrame, last_sync_s: int | None) -> DataFrame:
    """Paths that both sides have changed, or one has changed and the other lacks, since the last sync.

    Columns: path, conflict_type, local_mtime, remote_mtime, local_size, remote_size. Without a last sync, differing
    hashes are a conflict and missing files are none.
    """
    a = local.select("path", F.col("content_hash").alias("local_hash"), F.col("mtime_s").alias("local_mtime"), F.col("size").alias("local_size"), F.lit(1).alias("here"))
    b = remote.select("path", F.col("content_hash").alias("remote_hash"), F.col("mtime_s").alias("remote_mtime"), F.col("size").alias("remote_size"), F.lit(1).alias("there"))
    since = F.lit(last_sync_s).cast("long")
    both = F.col("here").isNotNull() & F.col("there").isNotNull()
    modified = both & (F.col("local_hash") != F.col("remote_hash")) & (since.isNull() | ((F.col("local_mtime") > since) & (F.col("remote_mtime") > since)))
    deleted = ~both & since.isNotNull() & (F.coalesce("local_mtime", "remote_mtime") > since)
    kind = F.when(modified, "BothModified").when(deleted, "DeletedModified")
    return a.join(b, "path", "full_outer").withColumn("conflict_type", kind).where("conflict_type is not null").select("path", "conflict_type", "local_mtime", "remote_mtime", "local_size", "remote_size")


def auto_resolution(conflict_type: Column, local_mtime: Column, remote_mtime: Column, default: str = "KeepNewer", enabled: bool = True) -> Column:
    """KeepLocal, KeepRemote, Manual or another default. Ties keep the local side; an existing file beats a deletion."""
    if not enabled:
        return F.lit("Manual")
    newer = F.when(remote_mtime > local_mtime, "KeepRemote").otherwise("KeepLocal") if default == "KeepNewer" else F.lit(default)
    surviving = F.when(local_mtime.isNotNull(), "KeepLocal").otherwise("KeepRemote")
    return F.when(conflict_type == "BothModified", newer).when(conflict_type == "DeletedModified", surviving).otherwise(F.lit(default))


def winner(strategy: str, local_mtime: Column, remote_mtime: Column, local_size: Column, remote_size: Column) -> Column:
    """Intent of the named strategies: NewerWins and LargerWins compare, BackupBoth keeps both, anything else asks."""
    if strategy == "NewerWins":
        return F.when(F.coalesce(remote_mtime, F.lit(-1)) > F.coalesce(local_mtime, F.lit(-1)), "remote").otherwise("local")
    if strategy == "LargerWins":
        return F.when(F.coalesce(remote_size, F.lit(-1)) > F.coalesce(local_size, F.lit(-1)), "remote").otherwise("local")
    return F.lit("both" if strategy == "BackupBoth" else "manual")


def unresolved(log: DataFrame) -> DataFrame:
    return log.where("not resolved")


def marked_resolved(log: DataFrame, paths: DataFrame) -> DataFrame:
    done = paths.select("path").distinct().withColumn("__done", F.lit(True))
    return log.join(done, "path", "left").withColumn("resolved", F.col("resolved") | F.coalesce("__done", F.lit(False))).drop("__done")


def without_resolved(log: DataFrame) -> DataFrame:
    return log.where("not resolved")
