"""Windows over ordered rows: offsets, latest versions, last writes, speeds, recent samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(key: str, order: str, length: str) -> Column:
    """The sum of the lengths before each row of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long")


def gaps(chunks: DataFrame) -> DataFrame:
    """Chunks whose offset is not the sum of the lengths before them; empty for sound chunk tables."""
    return chunks.withColumn("expected", running_offset("path", "seq", "length")).where("expected <> offset")


def last_write(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in the given order: upsert. Only a row for each key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def first_write(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the given order: insert or ignore."""
    w = Window.partitionBy(*keys).orderBy(*[c.asc() for c in order])
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def most_recent(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def recent_drained(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 10_000, drained: int = 5_000) -> DataFrame:
    """What a buffer holds that drops its oldest ``drained`` samples whenever it has more than ``most``."""
    w = Window.partitionBy(*keys)
    counted = rows.withColumn("__n", F.count("*").over(w)).withColumn("__nth", F.row_number().over(w.orderBy(*[c.desc() for c in order])))
    over = F.greatest(F.col("__n") - most, F.lit(0))
    held = F.col("__n") - F.ceil(over / F.lit(float(drained))) * drained
    return counted.where(F.col("__nth") <= held).drop("__n", "__nth")


def bandwidth(samples: DataFrame, key: str = "key", micros: str = "us", total: str = "bytes", span_s: int = 30) -> DataFrame:
    """Bytes a second over the samples of the last ``span_s`` seconds, the earliest bound excluded.

    0 with fewer than two samples, without elapsed time, and where the total has fallen.
    """
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-span_s * 1_000_000 + 1, 0)
    first = F.min(F.struct(micros, total)).over(w)
    last = F.max(F.struct(micros, total)).over(w)
    elapsed = (last[micros] - first[micros]) / 1e6
    delta = F.greatest(last[total] - first[total], F.lit(0))
    return samples.withColumn("bandwidth", F.when(elapsed > 0, delta / elapsed).otherwise(0.0))


def instant_speed(samples: DataFrame, key: str = "key", micros: str = "us", total: str = "bytes", tie: str = "id") -> DataFrame:
    """MiB a second between a sample and the one before it; 0 for the first and without elapsed time."""
    w = Window.partitionBy(key).orderBy(micros, tie)
    seconds = (F.col(micros) - F.lag(micros).over(w)) / 1e6
    delta = F.greatest(F.col(total) - F.lag(total).over(w), F.lit(0))
    return samples.withColumn("speed", F.when(seconds > 0, delta / seconds / 1048576.0).otherwise(0.0))


def average_speed(total: Column, elapsed_s: Column) -> Column:
    return F.when(elapsed_s > 0, total / elapsed_s / 1048576.0).otherwise(0.0)


def eta_seconds(percent: Column, elapsed_s: Column) -> Column:
    """Whole seconds left: unknown at 0 percent, none at 100."""
    total = F.call_function("div", elapsed_s.cast("long") * 100, percent.cast("long"))
    return F.when(percent <= 0, F.lit(None).cast("long")).when(percent >= 100, F.lit(0).cast("long")).otherwise(F.greatest(total - elapsed_s.cast("long"), F.lit(0)))


def percentile_at(values: Column, percent: int) -> Column:
    """Of a sorted array, the entry at place n * percent div 100, counted from 0; null if empty."""
    return F.when(F.size(values) > 0, F.element_at(values, (F.call_function("div", F.size(values) * percent, F.lit(100)) + 1).cast("int")))


def access_stats(events: DataFrame, key: str = "hash", at: str = "ts") -> DataFrame:
    """How often and when last each key was touched; also the update-mode aggregation of a stream."""
    return events.groupBy(key).agg(F.count("*").alias("accesses"), F.max(at).alias("last_access"))
