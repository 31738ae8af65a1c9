"""Folders, tables and stores: reading and writing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import INDEXER_IGNORED, ignored
from ..numbering import numbered
from ..operators.chunking import ChunkerConfig, chunks
from ..operators.manifest import file_hash
from ..operators.store import with_shard
from ..schemas import TABLES
from ..scratch import Scratch


ENTRY = "path string, kind string, size long, mtime timestamp, problem string"
CONTENT = "path string, size long, mtime timestamp, data binary, problem string"
BATCH = 32 << 20


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    return system, base.rstrip("/") or "/"


def _local_entries(base: str, below: str, follow_links: bool) -> Iterator[tuple]:
    """One folder of a local or mounted disk; a link that leads back to a folder around it is a problem, no folder."""
    for entry in os.scandir(os.path.join(base, below)):
        path = f"{below}/{entry.name}" if below else entry.name
        if entry.is_symlink() and not follow_links:
            continue
        try:
            stat = entry.stat()
            if entry.is_dir():
                real = os.path.realpath(entry.path)
                around = entry.is_symlink() and f"{os.path.realpath(os.path.dirname(entry.path))}/".startswith(f"{real.rstrip('/')}/")
                yield path, "problem" if around else "folder", 0, None, "link to a folder around it" if around else None
            elif entry.is_file():
                yield path, "file", stat.st_size, stat.st_mtime_ns // 1000, None
        except OSError as problem:
            yield path, "problem", 0, None, str(problem)


def _entries(system: fs.FileSystem, base: str, below: str, follow_links: bool) -> Iterator[tuple]:
    try:
        if isinstance(system, fs.LocalFileSystem):
            yield from _local_entries(base, below, follow_links)
            return
        for info in system.get_file_info(fs.FileSelector(f"{base}/{below}" if below else base)):
            path = f"{below}/{info.base_name}" if below else info.base_name
            if info.type == fs.FileType.Directory:
                yield path, "folder", 0, None, None
            else:
                yield path, "file", info.size, (info.mtime_ns or 0) // 1000, None
    except OSError as problem:
        if not below:
            raise
        yield below, "problem", 0, None, str(problem)


def listing(spark: SparkSession, folder: str, scratch: Scratch, patterns: Sequence[str] = INDEXER_IGNORED, follow_links: bool = False) -> DataFrame:
    """Every file below a folder, empty ones included: path (relative), kind, size, mtime, problem.

    Folders are listed by the executors, one level of the tree at a time. Ignored names are left out, ignored folders with
    all they hold. Links count only with ``follow_links``. What cannot be listed has the kind problem and says why; a
    folder that is not there is an error.
    """
    types = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
    names = ["path", "kind", "size", "mtime", "problem"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                for some in batched(_entries(system, base, below, follow_links), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    level, out = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = scratch.cut(level.mapInArrow(run, ENTRY).where(~ignored(F.col("path"), patterns)))
        out.append(found.where("kind <> 'folder'"))
        level = found.where("kind = 'folder'").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level = level.repartition("path")  # deals the folders of one level to all tasks


def contents(files: DataFrame, folder: str) -> DataFrame:
    """The files of listing() with their data, or with the problem that kept it from being read; no shuffle of contents."""
    names = ["path", "size", "mtime", "data", "problem"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            at, held, rows = 0, 0, []
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        rows.append((stream.read(), None))
                except OSError as problem:
                    rows.append((None, str(problem)))
                held += len(rows[-1][0] or b"")
                if held >= BATCH or i + 1 == len(batch):
                    data, told = zip(*rows, strict=True)
                    kept = batch.slice(at, len(rows))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(data, pa.binary()), pa.array(told, pa.string())], names=names)
                    at, held, rows = i + 1, 0, []

    return files.where("kind = 'file'").select("path", "size", "mtime").repartition("path").mapInArrow(run, CONTENT)


def scan(spark: SparkSession, folder: str, patterns: Sequence[str] = INDEXER_IGNORED, content: bool = True, follow_links: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The files below a folder: path (relative), size, mtime, data. Names are filtered before contents are read.

    Files without any byte are files too. Files that cannot be read are left out; ``contents`` tells them.
    """
    found = listing(spark, folder, scratch or Scratch(spark, "listing"), patterns, follow_links)
    if not content:
        return found.where("kind = 'file'").select("path", "size", "mtime")
    return contents(found, folder).where("problem is null").drop("problem")


def walk_order(files: DataFrame) -> DataFrame:
    """By path components, so a/b comes before a.b."""
    return files.orderBy(F.split("path", "/"))


def walk_ranks(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Every file with its rank, counted from 1, in the order of walk_order."""
    rows, _ = numbered(files.withColumn("__parts", F.split("path", "/")), ["__parts"], scratch, "rank")
    return rows.withColumn("rank", F.col("rank") + 1).drop("__parts")


def index_folder(spark: SparkSession, folder: str, config: ChunkerConfig | None = None, patterns: Sequence[str] = INDEXER_IGNORED, follow_links: bool = False) -> DataFrame:
    """The manifest of a folder: path, size, mtime, content_hash, chunk_hashes. Unreadable files are left out.

    Contents are read once; only hashes are shuffled. A file without chunks is in the manifest if it is empty.
    """
    scratch = Scratch(spark, "index")
    found = listing(spark, folder, scratch, patterns, follow_links)
    cut = chunks(contents(found, folder).where("problem is null"), config or ChunkerConfig())
    lists = cut.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "hash"))), lambda x: x["hash"]).alias("chunk_hashes"))
    out = found.where("kind = 'file'").join(lists, "path", "left").where((F.col("size") == 0) | F.col("chunk_hashes").isNotNull())
    hashes = F.coalesce("chunk_hashes", F.array().cast("array<string>"))
    return out.select("path", "size", "mtime", file_hash(hashes).alias("content_hash"), hashes.alias("chunk_hashes"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A metadata table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append_table(rows: DataFrame, root: str, name: str) -> None:
    rows.select(*TABLES[name].names).write.mode("append").parquet(f"{root}/{name}")


def write_objects(objects: DataFrame, root: str, compression: str = "zstd") -> None:
    """Append objects, partitioned by shard; an object is skipped that the store has already."""
    sharded = with_shard(objects.dropDuplicates(["hash"]))
    try:
        have = read_objects(objects.sparkSession, root).select("hash")
        sharded = sharded.join(have, "hash", "left_anti")
    except Exception as problem:  # noqa: BLE001  (the first write meets no store yet)
        if "PATH_NOT_FOUND" not in str(problem):
            raise
    sharded.repartition("shard").write.mode("append").option("compression", compression).partitionBy("shard").parquet(f"{root}/objects")


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("hash string, size long, data binary, shard string").parquet(f"{root}/objects")


def store_sink(root: str):
    """For writeStream.foreachBatch: each micro-batch of objects is one append."""

    def write(batch: DataFrame, _: int) -> None:
        write_objects(batch, root)

    return write


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
