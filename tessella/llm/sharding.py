"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of doc_id, then checksum, then size (nulls first; rows equal in all three are
interchangeable). A keyed Feistel network permutes that range, and the permuted number gives shard = number mod shards
and slot = number div shards. So the place of every row can be computed from its number, N and the key alone, shard
sizes differ by one row at most, and slots have no gaps.

The network works on pairs (left, right) with left < a and right < b for a = ceil(sqrt(N)), b = ceil(N / a); each round
adds a keyed function of one half to the other, modulo that half's size. Numbers of N and more are walked on along their
cycle until they come below N. There are fewer than a such numbers, so the driver finds the longest walk exactly and the
expression is unrolled that often: no case is left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..numbering import numbered
from .scratch import Scratch

ROUND_KEYS = (748183, 520397, 917629, 265003)
MULTIPLIER = 40503
MODULUS = 2147483647
SQUARE_MODULUS = 2147483629


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _let(x, f):
    """f(x) with x evaluated once: columns get a lambda variable, numpy arrays are passed on."""
    return F.transform(F.array(x), f)[0] if isinstance(x, Column) else f(x)


def _round(x, key: int, size: int):
    """The keyed function of one half, below ``size``; all products stay below 2**63."""
    return _let((x % MODULUS * MULTIPLIER + key) % MODULUS, lambda y: (y * y + key) % SQUARE_MODULUS % size)


def permute_once(x, a: int, b: int, keys=ROUND_KEYS):
    """One pass of the network over 0 <= x < a * b, for numpy arrays and columns alike."""
    if not isinstance(x, Column):
        left, right = x // b, x % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + _round(left, key, b)) % b
            else:
                left = (left + _round(right, key, a)) % a
        return left * b + right
    pair = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))

    def turn_left(key):
        return lambda p: F.struct(((p["l"] + _round(p["r"], key, a)) % a).alias("l"), p["r"].alias("r"))

    def turn_right(key):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _round(p["l"], key, b)) % b).alias("r"))

    for i, key in enumerate(keys):
        pair = _let(pair, (turn_right if i % 2 else turn_left)(key))
    return _let(pair, lambda p: p["l"] * b + p["r"])


def longest_walk(n: int, keys=ROUND_KEYS) -> int:
    """How many passes the number below n that walks farthest needs to come below n again."""
    a, b = halves(n)
    start = at = np.arange(n, a * b, dtype=np.int64)
    passes = 1
    while len(at):
        at = permute_once(at, a, b, keys)
        outside = (at >= n) & (at != start)  # a cycle that stays outside is never entered from below n
        start, at = start[outside], at[outside]
        passes += 1
    return passes


def permuted(number: Column, n: int, keys=ROUND_KEYS) -> Column:
    """The permuted row number, for a column of numbers 0..n-1."""
    a, b = halves(n)
    walk = F.sequence(F.lit(1), F.lit(longest_walk(n, keys)))
    # The accumulator is -1 before the first pass; a number below n stays as it is.
    return F.aggregate(walk, F.lit(-1).cast("long"), lambda got, _: F.when((got >= 0) & (got < n), got).otherwise(permute_once(F.when(got < 0, number).otherwise(got), a, b, keys)))


def feistel_shards(df: DataFrame, order: list[str], shards: int, scratch: Scratch, keys=ROUND_KEYS) -> DataFrame:
    """df with row_number, shard and slot. An empty table stays empty."""
    rows, n = numbered(df, order, scratch)
    rows = rows.withColumn("__place", permuted(F.col("row_number"), max(n, 1), keys))
    return rows.withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn("slot", F.call_function("div", F.col("__place"), F.lit(shards))).drop("__place")


def shard_documents(documents: DataFrame, shards: int = 40, keys=ROUND_KEYS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    size counts the UTF-8 bytes of the text plus 16. A null text counts as empty (size 16, checksum 0); null and repeated
    doc_ids, repeated rows and further columns are allowed. The law is ``rows``: shard counts differ by one at most, so
    grown_shard, which belongs to another law, is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = feistel_shards(slim, ["doc_id", "text_crc32", "size"], shards, Scratch(documents.sparkSession, "shards"), keys)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
