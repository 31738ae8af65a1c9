"""Differences between snapshots, by file and by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 524_288


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Added, Deleted and Modified paths; equal hashes are no change. Paths are unique on each side."""
    a = source.select("path", F.col("content_hash").alias("old_hash"), F.col("size").alias("old_size"), F.lit(1).alias("in_source"))
    b = target.select("path", F.col("content_hash").alias("new_hash"), F.col("size").alias("new_size"), F.lit(1).alias("in_target"))
    kind = F.when(F.col("in_source").isNull(), "Added").when(F.col("in_target").isNull(), "Deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "Modified")
    return a.join(b, "path", "full_outer").withColumn("change_type", kind).where("change_type is not null").drop("in_source", "in_target")


def _chunk_rows(source: DataFrame, target: DataFrame, cache: DataFrame) -> DataFrame:
    """The changes of manifest_diff(), a row for each chunk of the new version (one with nulls if there is none): whether
    the old version of the file has that chunk (had) and whether the cache has it (cached). Chunks meet by equality of
    path and hash, so a file of any number of chunks costs no more than its chunks."""
    a = source.select("path", F.col("content_hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("chunk_hashes").alias("old"), F.lit(1).alias("in_source"))
    b = target.select("path", F.col("content_hash").alias("new_hash"), F.col("size").alias("new_size"), F.col("chunk_hashes").alias("new"), F.lit(1).alias("in_target"))
    kind = F.when(F.col("in_source").isNull(), "Added").when(F.col("in_target").isNull(), "Deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "Modified")
    changed = a.join(b, "path", "full_outer").withColumn("change_type", kind).where("change_type is not null")
    new = F.posexplode_outer(F.when(F.col("change_type") != "Deleted", F.col("new"))).alias("seq", "hash")
    rows = changed.select("path", "change_type", "old_hash", "new_hash", "old_size", "new_size", new)
    old = changed.where("change_type = 'Modified'").select("path", F.explode("old").alias("hash")).distinct()
    rows = rows.join(old.withColumn("had", F.lit(True)), ["path", "hash"], "left")
    return rows.join(cache.select("hash").distinct().withColumn("cached", F.lit(True)), "hash", "left")


def required_chunks(source: DataFrame, target: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, seq, hash) of the chunks to fetch: of added files all that are not cached, of modified files those that the
    old version lacks too. A chunk that a file holds twice is listed twice."""
    return _chunk_rows(source, target, cache).where("hash is not null and cached is null and had is null").select("path", "seq", "hash")


def chunk_diff(source: DataFrame, target: DataFrame, cache: DataFrame) -> DataFrame:
    """Changes with their chunks to fetch in order; same size and nothing to fetch is MetadataOnly."""
    fetch = F.when(F.col("hash").isNotNull() & F.col("cached").isNull() & F.col("had").isNull(), F.struct("seq", "hash"))
    rows = _chunk_rows(source, target, cache).groupBy("path", "change_type", "old_hash", "new_hash", "old_size", "new_size")
    out = rows.agg(F.transform(F.array_sort(F.collect_list(fetch)), lambda x: x["hash"]).alias("required"))
    metadata = (F.col("change_type") == "Modified") & (F.size("required") == 0) & (F.col("old_size") == F.col("new_size"))
    return out.withColumn("change_type", F.when(metadata, "MetadataOnly").otherwise(F.col("change_type")))


def transfer_size(required: Column) -> Column:
    return (F.size(required) * CHUNK_BYTES).cast("long")


def stats(changes: DataFrame) -> DataFrame:
    """Nine counters of chunk_diff(), in one pass. Bytes to add and modify are those of the target, to delete those of the
    source; unique_chunks counts distinct chunks to fetch."""
    rows = changes.select("change_type", "old_size", "new_size", F.posexplode_outer("required").alias("seq", "hash"))
    head = F.coalesce(F.col("seq"), F.lit(0)) == 0  # the first row of each change
    files = lambda kind: F.count_if(head & (F.col("change_type") == kind))
    size = lambda kind, column: F.coalesce(F.sum(F.when(head & (F.col("change_type") == kind), F.col(column))), F.lit(0)).cast("long")
    return rows.agg(files("Added").alias("files_added"), files("Modified").alias("files_modified"), files("Deleted").alias("files_deleted"), files("MetadataOnly").alias("metadata_only"), size("Added", "new_size").alias("bytes_to_add"), size("Modified", "new_size").alias("bytes_to_modify"), size("Deleted", "old_size").alias("bytes_to_delete"), F.count("hash").alias("total_chunks"), F.count_distinct("hash").alias("unique_chunks"))


def priority(change_type: Column, size: Column) -> Column:
    return F.when(change_type == "Modified", 100).when((change_type == "Added") & (size < 1_000_000), 80).when(change_type == "Added", 50).when(change_type == "MetadataOnly", 20).otherwise(10)


def prioritised(changes: DataFrame) -> DataFrame:
    out = changes.withColumn("transfer_size", transfer_size(F.col("required")))
    return out.withColumn("priority", priority(F.col("change_type"), F.col("transfer_size")))


def priority_order() -> list[Column]:
    """High priority first, then small transfers, then by path."""
    return [F.col("priority").desc(), F.col("transfer_size").asc(), F.col("path").asc()]


def acknowledged(changes: DataFrame, acked: DataFrame) -> DataFrame:
    """The changes with chunks still to fetch after some have been acknowledged; changes without any are done."""
    left = changes.select("path", "change_type", F.posexplode("required").alias("seq", "hash")).join(acked.select("hash").distinct(), "hash", "left_anti")
    return left.groupBy("path", "change_type").agg(F.count("*").alias("n_left"))


def of_type(changes: DataFrame, kind: str) -> DataFrame:
    return changes.where(F.col("change_type") == kind)


def for_peers(peers: DataFrame, versions: DataFrame, current: DataFrame, folder: str = "folder") -> DataFrame:
    """Changes that bring each peer from the version that it has to the current one.

    peers has peer_id and version (null: none yet), versions has version and the entries of every version. Each version is
    compared once, however many peers have it. What it lacks is found from the versions that each path is in, so nothing
    but the changes themselves is multiplied.
    """
    own = F.coalesce(F.col("version").cast("string"), F.lit("")).alias("has")
    held = peers.select("peer_id", own)
    wanted = held.select("has").distinct()
    entries = versions.select(own, "path", F.col("content_hash").alias("old_hash")).join(wanted, "has", "left_semi")
    now = current.select("path", F.col("content_hash").alias("new_hash"), F.lit(1).alias("in_target"))
    kind = F.when(F.col("in_target").isNull(), "Deleted").when(F.col("old_hash") != F.col("new_hash"), "Modified")
    old = entries.join(now, "path", "left").select("has", "path", kind.alias("change_type")).where("change_type is not null")
    inside = entries.groupBy("path").agg(F.collect_set("has").alias("inside"))
    every = wanted.agg(F.collect_set("has").alias("every"))  # one row
    lacking = F.array_except("every", F.coalesce("inside", F.array().cast("array<string>")))
    added = now.join(inside, "path", "left").crossJoin(every).select(F.explode(lacking).alias("has"), "path", F.lit("Added").alias("change_type"))
    return held.join(old.unionByName(added), "has").select("peer_id", "path", "change_type")
