"""The object store as a table: writes, deduplication, integrity, packing, garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE_OBJECT = 10 << 20
PACKABLE = 64 << 10


def new_objects(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each hash that the store lacks (hash, size), ready to be appended."""
    return incoming.groupBy("hash").agg(F.min("size").alias("size")).join(stored.select("hash"), "hash", "left_anti")


def object_rows(texts: DataFrame, data: str = "data") -> DataFrame:
    """(hash, size, data) of contents; written with partitionBy('shard') after with_shard()."""
    content = F.col(data).cast("binary")
    return texts.select(F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("size"), content.alias("data"))


def with_shard(objects: DataFrame) -> DataFrame:
    """One level of 256 shards by the first two hex digits; a second level would make 65,536 small folders."""
    return objects.withColumn("shard", F.substring("hash", 1, 2))


def shard_path(hash_: Column) -> Column:
    return F.concat_ws("/", F.lit("objects"), F.substring(hash_, 1, 2), F.substring(hash_, 3, 2), F.substring(hash_, 5, 60))


def read(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    return objects.join(hashes.select("hash").distinct(), "hash", "left_semi")


def checked_read(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """The objects asked for, and whether each is sound: its content there, of its size, and with its hash."""
    sound = (F.sha2("data", 256) == F.col("hash")) & (F.octet_length("data") == F.col("size"))
    return read(objects, hashes).withColumn("sound", F.coalesce(sound, F.lit(False)))


def without(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    return objects.join(hashes.select("hash").distinct(), "hash", "left_anti")


def ref_counts(references: DataFrame) -> DataFrame:
    """How often each chunk is used, by any file and place."""
    return references.groupBy("hash").agg(F.count("*").alias("ref_count"), F.min("length").alias("size"))


def dedup_ratio(references: DataFrame) -> DataFrame:
    """Duplicate share of references, and of bytes."""
    counts = ref_counts(references)
    out = counts.agg(F.sum("ref_count").alias("refs"), F.count("*").alias("unique_chunks"), F.sum(F.col("ref_count") * F.col("size")).alias("logical"), F.sum("size").alias("stored"))
    return out.select("unique_chunks", (F.col("refs") - F.col("unique_chunks")).alias("duplicate_chunks"), F.when(F.col("refs") > 0, (F.col("refs") - F.col("unique_chunks")) / F.col("refs")).otherwise(0.0).alias("dedup_ratio"), F.col("logical").cast("long").alias("logical_bytes"), F.col("stored").cast("long").alias("stored_bytes"))


def statistics(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("object_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def integrity(objects: DataFrame) -> DataFrame:
    """One row: verified, corrupt (content and hash differ) and unreadable (no content) objects, health in percent."""
    state = F.when(F.col("data").isNull(), "error").when(F.sha2("data", 256) == F.col("hash"), "verified").otherwise("corrupt")
    out = objects.select(state.alias("state")).agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("verified", "corrupt", "error")))
    return out.withColumn("health_percent", F.when(F.col("total") == 0, 100.0).otherwise(F.col("verified") / F.col("total") * 100)).withColumn("healthy", (F.col("corrupt") == 0) & (F.col("error") == 0))


def corrupt(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("data").isNull() | (F.sha2("data", 256) != F.col("hash"))).select("hash")


def corruption_score(objects: DataFrame) -> DataFrame:
    bad = F.coalesce(F.sha2("data", 256) != F.col("hash"), F.lit(True))
    return objects.agg(F.count("*").alias("checked"), F.count_if(bad).alias("corrupt")).withColumn("integrity_score", F.when(F.col("checked") == 0, 1.0).otherwise(1 - F.col("corrupt") / F.col("checked")))


def shard_counts(objects: DataFrame) -> DataFrame:
    return with_shard(objects).groupBy("shard").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def shard_balance(objects: DataFrame) -> DataFrame:
    """Unbalanced if the fullest shard has more than three times the objects of the emptiest."""
    return shard_counts(objects).agg(F.count("*").alias("shards"), F.min("objects").alias("fewest"), F.max("objects").alias("most")).withColumn("unbalanced", F.col("most") > 3 * F.col("fewest"))


def largest(objects: DataFrame, n: int = 20, over: int = LARGE_OBJECT) -> DataFrame:
    """The n largest objects above a size: a top-k report."""
    return objects.where(F.col("size") > over).orderBy(F.col("size").desc(), F.col("hash").asc()).limit(n)


def orphans(stored_paths: DataFrame, objects: DataFrame) -> DataFrame:
    """Stored paths that belong to no object."""
    return stored_paths.join(objects.select(shard_path(F.col("hash")).alias("path")), "path", "left_anti")


def pack_batches(objects: DataFrame, per_pack: int = 1000, per_flush: int = 100, key: str = "shard") -> DataFrame:
    """Small objects with their flush and pack by count, each shard packed by itself so that shards pack in parallel."""
    w = Window.partitionBy(key).orderBy("hash")
    small = with_shard(objects).where(F.col("size") <= PACKABLE)
    nth = F.row_number().over(w) - 1
    return small.select(key, "hash", "size", nth.alias("nth")).select(key, "hash", "size", F.call_function("div", F.col("nth"), F.lit(per_flush)).alias("flush"), F.call_function("div", F.col("nth"), F.lit(per_pack)).alias("pack"))


def pack_by_size(objects: DataFrame, most_bytes: int = 256 << 20, most_objects: int = 1000, key: str = "shard") -> DataFrame:
    """Packs that close when they reach a size or a count: an ordered fold for each shard, streamed in order.

    Rows are sorted inside the shuffle and pass through batch by batch, so no shard is held in memory.
    """

    def run(batches):
        at, pack, size, count = None, 0, 0, 0
        for rows in batches:
            out = []
            for shard, n in zip(rows[key], rows["size"], strict=True):
                if shard != at:
                    at, pack, size, count = shard, 0, 0, 0
                elif size >= most_bytes or count >= most_objects:
                    pack, size, count = pack + 1, 0, 0
                size, count = size + n, count + 1
                out.append(pack)
            yield rows.assign(pack=out)

    small = with_shard(objects).where(F.col("size") <= PACKABLE).select(key, "hash", "size")
    return small.repartition(F.col(key)).sortWithinPartitions(key, "hash").mapInPandas(run, f"{key} string, hash string, size long, pack long")


def pack_index(packed: DataFrame, key: str = "shard") -> DataFrame:
    """Offset of each object in its pack."""
    w = Window.partitionBy(key, "pack").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def pack_bytes(indexed: DataFrame, key: str = "shard") -> DataFrame:
    """The packs themselves: shard, pack, bytes; the data of the objects of pack_index(), one after another by hash."""
    parts = F.array_sort(F.collect_list(F.struct("hash", F.hex(F.col("data").cast("binary")).alias("hex"))))
    return indexed.groupBy(key, "pack").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), "")).alias("bytes"))


def read_packed(packs: DataFrame, index: DataFrame, hashes: DataFrame, key: str = "shard") -> DataFrame:
    """Objects read back from their packs: hash, size, data, sound (the content has the hash)."""
    rows = read(index.select(key, "pack", "hash", "offset", "size"), hashes).join(packs, [key, "pack"])
    out = rows.select("hash", "size", F.substring("bytes", F.col("offset").cast("int") + 1, F.col("size").cast("int")).alias("data"))
    return out.withColumn("sound", F.sha2("data", 256) == F.col("hash"))


def batch_flushes(writes: DataFrame, most: int = 100, most_bytes: int = 10 << 20, most_ms: int = 100) -> DataFrame:
    """Whether a buffer with n items, bytes and an age in ms is flushed."""
    return writes.withColumn("flush", (F.col("n") >= most) | (F.col("bytes") >= most_bytes) | (F.col("age_ms") >= most_ms))


def garbage(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Kept and removable objects and the bytes that removal frees; the documented intent of collection."""
    marked = objects.join(live.select("hash").distinct().withColumn("__live", F.lit(1)), "hash", "left")
    return marked.agg(F.count("__live").alias("kept"), (F.count("*") - F.count("__live")).alias("removable"), F.coalesce(F.sum(F.when(F.col("__live").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("reclaimed_bytes"))


def repack(packs: DataFrame, live: DataFrame, least: float = 0.5) -> DataFrame:
    """Packs whose live share of bytes is below ``least``, with that share; the documented intent of repacking."""
    marked = packs.join(live.select("hash").distinct().withColumn("__live", F.lit(1)), "hash", "left")
    out = marked.groupBy("shard", "pack").agg((F.coalesce(F.sum(F.when(F.col("__live").isNotNull(), F.col("size"))), F.lit(0)) / F.sum("size")).alias("live_share"))
    return out.where(F.col("live_share") < least)


def expired_partials(partials: DataFrame, as_of_s: int, hours: int = 24) -> DataFrame:
    return partials.where(F.lit(as_of_s) - F.col("mtime_s") > hours * 3600)


def partial_state(partials: DataFrame, as_of_s: int) -> DataFrame:
    """Of resumable writes: expired, size_mismatch, hash_mismatch, complete or open."""
    state = F.when(F.col("expires_s") < as_of_s, "expired").when(F.col("bytes_received") > F.col("total_size"), "size_mismatch").when(F.col("bytes_received") < F.col("total_size"), "open").when(F.col("actual_hash") != F.col("expected_hash"), "hash_mismatch").otherwise("complete")
    return partials.withColumn("state", state)


def resumable_temp(listing: DataFrame, target: str) -> DataFrame:
    """The longest temporary file beside a target, which a write can go on from."""
    beside = listing.where(F.col("path").startswith(f"{target}.tmp."))
    return beside.agg(F.max_by("path", F.struct("size", "path")).alias("path"), F.max("size").alias("size"))
