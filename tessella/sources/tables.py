"""Metadata tables with upserts, as versions of a Parquet folder.

A merge writes a whole new version and only then becomes visible: readers take the highest version whose write has ended.
So a failed job leaves the table as it was, and old versions stay readable until they are vacuumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import first_write, last_write
from ..schemas import TABLES

VERSION = "v="


class VersionedTable:
    """One table of schemas.TABLES below a root folder."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.schema = TABLES[name]
        self.path = f"{root.rstrip('/')}/{name}"

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """The versions that are complete, oldest first."""
        where, system = self._folder(self.path)
        if not system.exists(where):
            return []
        jvm = self.spark._jvm
        names = [s.getPath().getName() for s in system.listStatus(where)]
        found = [int(n[len(VERSION) :]) for n in names if n.startswith(VERSION)]
        return sorted(v for v in found if system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{VERSION}{v}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a given one; without any, no rows."""
        have = self.versions()
        if version is None and not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{VERSION}{have[-1] if version is None else version}")

    def _write(self, rows: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{VERSION}{version}")
        return version

    def upsert(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> int:
        """New rows replace those with equal keys; among new rows with equal keys the last in the given order counts."""
        fresh = last_write(rows, list(keys), list(order) or [F.lit(0)]).select(*self.schema.names)
        rest = self.read().join(fresh.select(*keys), list(keys), "left_anti").select(*self.schema.names)
        return self._write(rest.unionByName(fresh))

    def insert_or_ignore(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> int:
        """Rows whose keys the table has are left out; among new rows with equal keys the first counts."""
        have = self.read().select(*keys)
        fresh = first_write(rows, list(keys), list(order) or [F.lit(0)]).select(*self.schema.names)
        return self._write(self.read().unionByName(fresh.join(have, list(keys), "left_anti").select(*self.schema.names)))

    def add_references(self, chunks: DataFrame) -> int:
        """For the chunks table: a new chunk starts with one reference, each further use adds one."""
        used = chunks.groupBy("hash").agg(F.min("size").alias("new_size"), F.count("*").alias("uses"))
        both = self.read().join(used, "hash", "full_outer")
        return self._write(both.select("hash", F.coalesce("size", "new_size").alias("size"), (F.coalesce("ref_count", F.lit(0)) + F.coalesce("uses", F.lit(0))).alias("ref_count")))

    def delete(self, keys: DataFrame) -> int:
        return self._write(self.read().join(keys, keys.columns, "left_anti"))

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete all but the newest versions; returns those that are gone."""
        gone = self.versions()[: -keep or None]
        for version in gone:
            where, system = self._folder(f"{self.path}/{VERSION}{version}")
            system.delete(where, True)
        return gone
