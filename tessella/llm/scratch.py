"""Tables of the operators, written with Arrow batches of whole texts kept small."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch as Tables

#: setting, its values when nobody has chosen one, size while an operator's table is written
SIZES = (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000", None), "512"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b", None), "16m"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches that are small in rows and in bytes; a session that has set a size keeps it, others get theirs back."""
    changed = []
    for name, plain, size in SIZES:
        before = spark.conf.get(name, None)
        if before in plain:
            changed.append(name)
            spark.conf.set(name, size)
    try:
        yield
    finally:
        for name in changed:
            spark.conf.unset(name)


class Scratch(Tables):
    def cut(self, df: DataFrame) -> DataFrame:
        with small_batches(self.spark):
            return super().cut(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
