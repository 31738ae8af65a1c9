"""File events: debouncing, batching, renames, folders. Batch and streaming forms give the same rows for complete input.

Time is event time. The streaming forms need a watermark; events that come later than it allows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIND_RANK = {"Created": 0, "Modified": 1, "Removed": 2}


def debounced(events: DataFrame, gap_us: int, key: str = "path") -> DataFrame:
    """The last event of each burst of a key; a quiet time of ``gap_us`` or more ends a burst.

    events has key, us (microseconds), seq (a tie-break) and kind. Columns: key, burst, us, kind, n_events.
    """
    w = Window.partitionBy(key).orderBy("us", "seq")
    starts = (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(gap_us)) >= gap_us).cast("int")
    bursts = events.withColumn("__new", starts).withColumn("burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return bursts.groupBy(key, "burst").agg(F.max("us").alias("us"), F.max_by("kind", F.struct("us", "seq")).alias("kind"), F.count("*").alias("n_events"))


def debounced_stream(events: DataFrame, gap_us: int, watermark: str, key: str = "path", at: str = "ts") -> DataFrame:
    """The streaming form, for a timestamp column. A session window merges at exactly its gap, hence one microsecond less."""
    gap = f"{gap_us - 1} microseconds"
    out = events.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("burst"), F.col(key))
    return out.agg(F.max(at).alias(at), F.max_by("kind", F.struct(at, "seq")).alias("kind"), F.count("*").alias("n_events")).select(key, at, "kind", "n_events")


def renames_split(events: DataFrame) -> DataFrame:
    """A rename becomes the removal of the old path and the creation of the new one."""
    parts = F.when(F.col("kind") == "Renamed", F.array(F.struct(F.col("old_path").alias("path"), F.lit("Removed").alias("kind")), F.struct(F.col("path").alias("path"), F.lit("Created").alias("kind")))).otherwise(F.array(F.struct(F.col("path").alias("path"), F.col("kind").alias("kind"))))
    rest = [c for c in events.columns if c not in ("path", "kind", "old_path")]
    return events.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.path", "p.kind")


def kind_rank(kind: Column) -> Column:
    out = F.lit(1)
    for name, rank in KIND_RANK.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def batches(events: DataFrame, window_us: int = 500_000, most: int = 100) -> DataFrame:
    """Events of each tumbling window, creations before changes before removals, in batches of ``most``."""
    split = renames_split(events).withColumn("window", F.call_function("div", F.col("us"), F.lit(window_us)))
    w = Window.partitionBy("window").orderBy(kind_rank(F.col("kind")), "us", "seq", "path")
    return split.withColumn("nth", F.row_number().over(w) - 1).withColumn("batch", F.call_function("div", F.col("nth"), F.lit(most))).select("window", "batch", "nth", "path", "kind", "us", "seq")


def paired_renames(events: DataFrame, key: str = "cookie", most_us: int = 1_000_000) -> DataFrame:
    """MovedFrom and MovedTo with the same key within the time are a rename; a MovedTo alone is a creation, a MovedFrom
    alone is left out."""
    start = events.where("kind = 'MovedFrom'").select(key, F.col("path").alias("old_path"), F.col("us").alias("from_us"))
    end = events.where("kind = 'MovedTo'").select(key, "path", "us")
    out = end.join(start, (end[key] == start[key]) & (F.col("us") - F.col("from_us")).between(0, most_us), "left")
    return out.select(end[key], "path", "old_path", "us", F.when(F.col("old_path").isNull(), "Created").otherwise("Renamed").alias("kind"))


def paired_renames_stream(events: DataFrame, watermark: str = "2 seconds", key: str = "cookie", most: str = "1 second") -> DataFrame:
    """The streaming form: an outer join of two streams with a bound on time, which also bounds its state."""
    start = events.where("kind = 'MovedFrom'").select(F.col(key).alias("from_key"), F.col("path").alias("old_path"), F.col("ts").alias("from_ts")).withWatermark("from_ts", watermark)
    end = events.where("kind = 'MovedTo'").select(F.col(key).alias("to_key"), "path", "ts").withWatermark("ts", watermark)
    on = F.expr(f"to_key = from_key and ts between from_ts and from_ts + interval {most}")
    return end.join(start, on, "leftOuter").select("path", "old_path", "ts", F.when(F.col("old_path").isNull(), "Created").otherwise("Renamed").alias("kind"))


def paired_by_file_id(events: DataFrame) -> DataFrame:
    """Two Renamed events of one file_id in succession are the old and the new path."""
    w = Window.partitionBy("file_id").orderBy("us", "seq")
    nth = F.row_number().over(w)
    out = events.where("kind = 'Renamed'").withColumn("nth", nth).withColumn("new_path", F.lead("path").over(w))
    return out.where("nth % 2 = 1 and new_path is not null").select("file_id", F.col("path").alias("old_path"), F.col("new_path").alias("path"), "us")


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folders_of(events: DataFrame, folders: DataFrame) -> DataFrame:
    """The deepest watched folder of each event's path, by whole components; none if no folder matches.

    Every event is joined on its few ancestors, so no event meets folders that it cannot be in.
    """
    up = events.select("seq", "path", F.explode(ancestors(F.col("path"))).alias("folder"))
    found = up.join(folders.select("folder").distinct(), "folder").groupBy("seq", "path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return events.select("seq", "path").join(found, ["seq", "path"], "left")


def folders_to_reindex(events: DataFrame, folders: DataFrame) -> DataFrame:
    """The watched folders that events touch, each once; a removal alone does not start a new index run."""
    return folders_of(events.where("kind <> 'Removed'"), folders).where("folder is not null").select("folder").distinct()


def overflows(events: DataFrame) -> DataFrame:
    """How many overflow markers there are; each calls for a rescan."""
    return events.agg(F.count_if(F.col("kind") == "Overflow").alias("overflows"))


def read_events(spark, path: str, schema, most_files: int = 100) -> DataFrame:
    """A stream of event rows from a folder of Parquet files, ``most_files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
