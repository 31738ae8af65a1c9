"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("hash", T.StringType())])
CHUNK_WITH_DATA = T.StructType([*CHUNK.fields, T.StructField("data", T.BinaryType())])
MANIFEST_ENTRY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("chunk_hashes", T.ArrayType(T.StringType())),
    T.StructField("mode", T.IntegerType()),
])
FS_EVENT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("old_path", T.StringType())])
SESSION_EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("event", T.StringType()), T.StructField("value", T.DoubleType())])
PEER_STATE = T.StructType([T.StructField("tag", T.StringType()), T.StructField("progress", T.DoubleType()), T.StructField("error", T.StringType())])
OBJECT = T.StructType([T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])
TABLES = {
    "files": T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.TimestampNTZType()), T.StructField("content_hash", T.StringType()), T.StructField("mode", T.IntegerType())]),
    "chunks": T.StructType([T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()), T.StructField("ref_count", T.LongType())]),
    "manifests": T.StructType([T.StructField("device_id", T.StringType()), T.StructField("folder_path", T.StringType()), T.StructField("version", T.LongType()), T.StructField("manifest_hash", T.StringType()), T.StructField("file_count", T.LongType()), T.StructField("total_size", T.LongType())]),
}
