"""Bounded, stratified samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def one_of_each(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows for each label: the one with the smallest hash of its key in each of ``most`` bins.

    It is one aggregation with partial sums, so a label that holds nearly all rows costs no more than the others.
    """
    bins = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(most))
    order = F.struct(F.xxhash64(F.col(key), F.lit(2)), F.col(key))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(label).alias(label), bins.alias("__bin")).agg(F.min_by(F.col(key), order).alias(key)).drop("__bin")
