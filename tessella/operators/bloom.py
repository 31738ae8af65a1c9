"""Bloom filters as tables of bits, and what two folders learn from them.

A bit of an item is the first 32 bits of md5(i ':' item) modulo m, for i below k, which Spark and DuckDB compute alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(n: int, p: float = 0.01, least: int = 100) -> tuple[int, int]:
    """Bits and hash functions for n items (``least`` at least) at a false positive rate p."""
    n = max(n, least)
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, int(m / n * math.log(2) + 0.5))


def bit_of(item: Column, i: Column, m: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), item).cast("binary")), 1, 8), 16, 10).cast("long") % m


def bits_of(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(item, bit) rows."""
    return items.select(F.col(item).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).select("item", bit_of(F.col("item"), F.col("i"), m).alias("bit"))


def build(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """The set bits."""
    return bits_of(items, item, m, k).select("bit").distinct()


def probe(items: DataFrame, item: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """(item, maybe): whether all bits of an item are set."""
    asked = bits_of(items.select(item).distinct(), item, m, k)
    return asked.join(bits.withColumn("__set", F.lit(1)), "bit", "left").groupBy("item").agg((F.count("__set") == F.count("*")).alias("maybe"))


def false_positive_rate(m: int, k: int, added: int) -> float:
    """added counts every insertion, repeated ones too."""
    return (1 - math.exp(-k * added / m)) ** k


def reported_changes(local: DataFrame, path_bits: DataFrame, hash_bits: DataFrame, remote_size: int) -> DataFrame:
    """Local files whose path or hash is surely not in the remote folder; each is reported as Added."""
    m, k = parameters(remote_size)
    paths = probe(local, "path", path_bits, m, k).select(F.col("item").alias("path"), F.col("maybe").alias("path_maybe"))
    hashes = probe(local, "content_hash", hash_bits, m, k).select(F.col("item").alias("content_hash"), F.col("maybe").alias("hash_maybe"))
    return local.select("path", "content_hash").join(paths, "path").join(hashes, "content_hash").where("not (path_maybe and hash_maybe)").select("path", F.lit("Added").alias("change_type"))


def suspected_paths(local: DataFrame, path_bits: DataFrame, remote_size: int) -> DataFrame:
    """Local paths that are surely not in the remote folder; edits of a path are not seen."""
    m, k = parameters(remote_size)
    return probe(local, "path", path_bits, m, k).where("not maybe").select(F.col("item").alias("path"))


def similarity(count_a: Column, count_b: Column, root_a: Column, root_b: Column) -> Column:
    """0 if a folder is empty, 1 for equal roots, else the ratio of the file counts."""
    return F.when((count_a == 0) | (count_b == 0), 0.0).when(root_a == root_b, 1.0).otherwise(F.least(count_a, count_b) / F.greatest(count_a, count_b))


def sync_stats(rows: DataFrame) -> DataFrame:
    """Of rows with plain_bytes and sent_bytes: bytes saved (never below 0), their share, the ratio, and totals."""
    saved = F.greatest(F.col("plain_bytes") - F.col("sent_bytes"), F.lit(0))
    out = rows.agg(F.sum(saved).cast("long").alias("bytes_saved"), F.avg(saved).alias("mean_saved"), F.sum("plain_bytes").alias("plain"), F.sum("sent_bytes").alias("sent"))
    return out.select("bytes_saved", "mean_saved", F.when(F.col("plain") > 0, F.col("bytes_saved") / F.col("plain") * 100).otherwise(0.0).alias("savings_percent"), F.when(F.col("plain") > 0, F.col("sent") / F.col("plain")).otherwise(1.0).alias("compression_ratio"))
