"""Rows of state and wire tables: tagged states as JSON, projections of entries, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decoded_hash
from ..schemas import PEER_STATE


def peer_state(text: Column) -> Column:
    """The tagged state in a JSON text; anything that is no such text is Idle."""
    parsed = F.from_json(text, PEER_STATE)
    idle = F.struct(F.lit("Idle").alias("tag"), F.lit(None).cast("double").alias("progress"), F.lit(None).cast("string").alias("error"))
    return F.when(parsed.isNotNull() & parsed["tag"].isNotNull(), parsed).otherwise(idle)


def wire_entry(entries: DataFrame) -> DataFrame:
    """Manifest entries as wire rows: binary hashes, whole seconds."""
    return entries.select("path", "size", decoded_hash(F.col("content_hash")).alias("content_hash"), F.transform("chunk_hashes", decoded_hash).alias("chunk_hashes"), "mode", F.col("mtime_s").alias("modified_s"))


def from_wire(rows: DataFrame, now_s: int) -> DataFrame:
    """And back; a missing time is that of the call."""
    return rows.select("path", "size", F.lower(F.hex("content_hash")).alias("content_hash"), F.transform("chunk_hashes", lambda h: F.lower(F.hex(h))).alias("chunk_hashes"), "mode", F.coalesce("modified_s", F.lit(now_s)).alias("mtime_s"))


def status(peers: DataFrame, folders: DataFrame) -> DataFrame:
    """How many peers, connected peers and folders there are."""
    return peers.agg(F.count("*").alias("peers"), F.count_if("connected").alias("connected")).crossJoin(folders.agg(F.count("*").alias("folders")))  # one row each
