"""Global row numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str = "row_number") -> tuple[DataFrame, int]:
    """df with a gapless global number in the given order (nulls first), and the number of rows.

    A range exchange deals the rows, each partition counts its own, and one count for each partition is added up. Rows
    that are equal in all columns of the order are dealt over several partitions, so no repeated value fills one task.
    """
    part, local = f"__{name}_part", f"__{name}_local"
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    read = scratch.cut(df.withColumn(local, F.monotonically_increasing_id() % 1009))  # else the range sample runs df twice
    dealt = read.repartitionByRange(*by, F.col(local)).sortWithinPartitions(*by)
    kept = scratch.cut(dealt.withColumn(part, F.spark_partition_id()).withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # One row for each partition: few enough for one task to add up; Spark broadcasts them if they are small.
    sizes = scratch.cut(kept.groupBy(part).agg(F.count("*").alias("__n")))
    before = F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.cut(sizes.select(part, F.coalesce(before, F.lit(0)).alias("__before")))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return kept.join(offsets, part).withColumn(name, F.col("__before") + F.col(local)).drop(part, local, "__before"), total
