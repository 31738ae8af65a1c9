"""Folder snapshots: totals, Merkle roots, subtree hashes, versions, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decoded_hash, first_component
from ..numbering import numbered
from ..scratch import Scratch
from .series import last_write

BLOCK = 1024


def little_endian(value: Column, size: int) -> Column:
    """The lowest ``size`` bytes of an integer, lowest first."""
    text = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1))))


def joined_bytes(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def file_hash(chunk_hashes: Column) -> Column:
    """The hash of a file is that of its chunk hashes' joined hex text, not of its bytes."""
    return F.sha2(F.array_join(chunk_hashes, "").cast("binary"), 256)


def folder_id(path: Column) -> Column:
    return F.sha2(path.cast("binary"), 256)


def leaf_hash(path: Column, size: Column, content_hash: Column, mode: Column, mtime_s: Column, chunk_hashes: Column) -> Column:
    """Of path, size, content hash, mode (zeros if null), mtime and chunk hashes; hashes that are no hex count as zeros."""
    mode_bytes = F.coalesce(little_endian(mode, 4), F.unhex(F.lit("00000000")))
    chunks = joined_bytes(F.transform(chunk_hashes, decoded_hash))
    return F.sha2(F.concat(path.cast("binary"), little_endian(size, 8), decoded_hash(content_hash), mode_bytes, little_endian(mtime_s, 8), chunks), 256)


def merkle_leaves(entries: DataFrame) -> DataFrame:
    return entries.select("path", leaf_hash(*(F.col(c) for c in ("path", "size", "content_hash", "mode", "mtime_s", "chunk_hashes"))).alias("leaf"))


def _folded(hashes: Column, nodes: Column, levels: int) -> Column:
    """A block of a tree level after some levels of pairing, and how many nodes the whole level has then.

    An odd node is paired with itself; a level of one node stays as it is.
    """

    def pairs(a: Column) -> Column:
        count = F.ceil(F.size(a) / 2).cast("int")
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.sha2(F.concat(F.unhex(F.element_at(a, 2 * i - 1)), F.unhex(F.coalesce(F.get(a, 2 * i - 1), F.element_at(a, 2 * i - 1)))), 256))

    start = F.struct(hashes.alias("h"), nodes.cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, lambda s, _: F.when(s["n"] <= 1, s).otherwise(F.struct(pairs(s["h"]).alias("h"), F.ceil(s["n"] / 2).cast("long").alias("n"))))


def places(rows: DataFrame, by: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """rows with their place i in path order within each value of ``by``; the size n of each; the largest size."""
    rows, _ = numbered(rows, [by, "path"], scratch, "__number")
    rows = scratch.cut(rows)
    sizes = scratch.cut(rows.groupBy(F.col(by).alias("__of")).agg(F.min("__number").alias("__first"), F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    placed = rows.join(sizes.drop("n"), F.col(by).eqNullSafe(F.col("__of"))).withColumn("i", F.col("__number") - F.col("__first"))
    return placed.drop("__number", "__of", "__first"), sizes.drop("__first"), most


def merkle_root(leaves: DataFrame, key: str | None = None, levels: int = 10) -> DataFrame:
    """Root for each key (or of all rows): leaves in path order are paired level by level, an odd one with itself.

    Leaves are numbered by a range exchange, not in one task. Each aggregation takes aligned blocks of 2**levels nodes up
    that many levels, so a million leaves need two shuffles and no task holds more than a block. Without leaves and without
    a key, the root is the hash of nothing.
    """
    by = key or "__all"
    rows = leaves if key else leaves.withColumn(by, F.lit(0))
    rows, sizes, most = places(rows.select(by, "path", F.col("leaf").alias("h")), by, Scratch(leaves.sparkSession, "merkle"))
    rows = rows.join(sizes, rows[by].eqNullSafe(sizes["__of"])).select(by, "i", "n", "h")
    while most > 1:
        block = rows.groupBy(by, F.call_function("div", F.col("i"), F.lit(2**levels)).alias("i"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("t"))
        up = block.select(by, "i", _folded(F.transform("t", lambda x: x["h"]), F.col("n"), levels).alias("f"))
        rows = up.select(by, "i", F.col("f.n").alias("n"), F.col("f.h")[0].alias("h"))
        most = -(-most // 2**levels)
    if key:
        return rows.select(key, F.col("h").alias("root"))
    return rows.agg(F.coalesce(F.max("h"), F.sha2(F.lit("").cast("binary"), 256)).alias("root"))


def verified(stored: Column, computed: Column) -> Column:
    """A missing stored hash does not verify."""
    return F.coalesce(stored == computed, F.lit(False))


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def subtree_hashes(entries: DataFrame) -> DataFrame:
    """A hash for each top-level folder, over its files in path order.

    Records are hashed in blocks of ``BLOCK``, block hashes again, until one is left; so no folder is one group.
    """
    rows = entries.select(first_component(F.col("path")).alias("subtree"), "path", F.concat("path", F.col("size").cast("string"), "content_hash").alias("h"))
    rows, _, most = places(rows, "subtree", Scratch(entries.sparkSession, "subtrees"))
    rows = rows.select("subtree", "i", "h")
    first = True
    while most > 1 or first:
        block = F.call_function("div", F.col("i"), F.lit(BLOCK)).alias("i")
        grouped = rows.groupBy("subtree", block).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("t"))
        text = F.array_join(F.transform("t", lambda x: x["h"]), "")
        hashed = F.sha2(text.cast("binary"), 256)
        rows = grouped.select("subtree", "i", (hashed if first else F.when((F.size("t") == 1) & (F.col("i") == 0), F.col("t")[0]["h"]).otherwise(hashed)).alias("h"))
        most, first = -(-most // BLOCK), False
    return rows.select("subtree", F.col("h").alias("hash"))


def inclusion_proof(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """For each of the paths that has a leaf: path, leaf, index and the siblings on its way to the root, lowest first.

    A sibling is its level, its hash and whether it stands on the left; an odd node is its own sibling, as in merkle_root.
    One join a level follows the wanted paths up; a level is half as large as the one below.
    """
    spark = leaves.sparkSession
    scratch = Scratch(spark, "proof")
    level, _, most = places(leaves.select(F.lit(0).alias("all"), "path", F.col("leaf").alias("h")), "all", scratch)
    level = scratch.cut(level.select("path", "i", "h"))
    way = level.join(paths.select("path").distinct(), "path").select("path", F.col("h").alias("leaf"), F.col("i").alias("index"), F.col("i").alias("at"))
    way = scratch.cut(way)
    steps, nth = [], 0
    level = level.select("i", "h")
    while most > 1:
        beside = F.when(F.col("at") % 2 == 1, F.col("at") - 1).when(F.col("at") + 1 < most, F.col("at") + 1).otherwise(F.col("at"))
        wanted = way.select("path", "at", beside.alias("i"))
        steps.append(wanted.join(level, "i").select("path", F.struct(F.lit(nth).alias("level"), F.col("h").alias("hash"), (F.col("at") % 2 == 1).alias("left")).alias("step")))
        half = level.groupBy(F.call_function("div", F.col("i"), F.lit(2)).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        level = scratch.cut(half.select("i", F.sha2(F.concat(F.unhex("a"), F.unhex("b")), 256).alias("h")))
        way = way.withColumn("at", F.call_function("div", F.col("at"), F.lit(2)))
        most, nth = -(-most // 2), nth + 1
    heads = way.select("path", "leaf", "index")
    if not steps:
        return heads.withColumn("siblings", F.lit(None).cast("array<struct<level:int,hash:string,left:boolean>>")).withColumn("siblings", F.coalesce("siblings", F.array()))
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    return heads.join(every.groupBy("path").agg(F.array_sort(F.collect_list("step")).alias("siblings")), "path", "left")


def proven_root(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(h: Column, s: Column) -> Column:
        return F.sha2(F.when(s["left"], F.concat(F.unhex(s["hash"]), F.unhex(h))).otherwise(F.concat(F.unhex(h), F.unhex(s["hash"]))), 256)

    return F.aggregate(siblings, leaf, up)


def tree_depth(n: Column) -> Column:
    return F.least(F.when(n > 1, F.ceil(F.log2(n))).otherwise(0), F.lit(10)).cast("long")


def latest(manifests: DataFrame) -> DataFrame:
    """The newest version of each device and folder."""
    return last_write(manifests, ["device_id", "folder_path"], [F.col("version")])


def next_versions(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("device_id", "folder_path").agg((F.max("version") + 1).alias("next_version"))


def entries_of(manifests: DataFrame, manifest_files: DataFrame, files: DataFrame) -> DataFrame:
    """The files of manifests, by path."""
    return manifests.select("manifest_id").join(manifest_files, "manifest_id").join(files, "file_id")


def details(entries: DataFrame, paths: DataFrame) -> DataFrame:
    return entries.join(paths, "path", "left_semi")
