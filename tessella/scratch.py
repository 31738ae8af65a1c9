"""Cutting lineage through tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder of its own; a cluster without it is an
    error, because its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessella_scratch", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    spark._tessella_scratch = tempfile.mkdtemp(prefix="tessella-")
    return spark._tessella_scratch


class Scratch:
    """Tables that one operator run writes to the shared folder, so that a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and return it as read back: its plan starts at the written files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        self.tables.append(out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of this run that no later plan reads."""
        self.tables = [t for t in self.tables if all(t is not df for df in dfs)]
        for df in dfs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tessella_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def keep(self, *dfs: DataFrame) -> None:
        """Delete all tables of this run but these, which the result still reads."""
        self.drop(*(t for t in self.tables if all(t is not df for df in dfs)))
