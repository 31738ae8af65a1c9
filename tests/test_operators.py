"""Small tables with known results."""

import hashlib
import struct

from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.operators import bloom, conflict, diff, manifest, metrics, series, store, transfer

ENTRY = "path string, size long, content_hash string, chunk_hashes array<string>, mtime_s long, mode int"


def entries(spark, *rows):
    return spark.createDataFrame([(p, s, h, c, t, m) for p, s, h, c, t, m in rows], ENTRY)


def entry(path, size=10, h="h", chunks=("c",), t=0, mode=420):
    return path, size, h, list(chunks), t, mode


def test_three_kinds_of_change(spark):
    a = entries(spark, entry("same", h="1"), entry("mod", 2048, "2", ["x", "y"]), entry("gone", 512, "3"))
    b = entries(spark, entry("same", h="1"), entry("mod", 3072, "2b", ["x", "z", "z"]), entry("new", 1024, "4", ["n", "x"]))
    cache = spark.createDataFrame([("n",)], "hash string")
    out = {r.path: r for r in diff.chunk_diff(a, b, cache).collect()}
    assert {p: r.change_type for p, r in out.items()} == {"mod": "Modified", "gone": "Deleted", "new": "Added"}
    assert out["mod"].required == ["z", "z"] and out["new"].required == ["x"] and out["gone"].required == []
    told = diff.stats(diff.chunk_diff(a, b, cache)).first()
    assert (told.files_added, told.files_modified, told.files_deleted, told.metadata_only) == (1, 1, 1, 0)
    assert (told.bytes_to_add, told.bytes_to_modify, told.bytes_to_delete, told.total_chunks, told.unique_chunks) == (1024, 3072, 512, 3, 2)


def test_metadata_only_and_no_change_for_mode_alone(spark):
    a = entries(spark, entry("m", 5, "1", ["x"]), entry("mode", 5, "1", ["x"], mode=420))
    b = entries(spark, entry("m", 5, "2", ["x"]), entry("mode", 5, "1", ["x"], mode=493))
    out = diff.chunk_diff(a, b, spark.createDataFrame([], "hash string")).collect()
    assert [(r.path, r.change_type) for r in out] == [("m", "MetadataOnly")]


def test_scale_of_a_thousand_files(spark):
    a = spark.range(1000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit("h").alias("content_hash"))
    b = spark.range(1050).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") < 100, "n").otherwise("h").alias("content_hash"))
    counts = {r.change_type: r["count"] for r in diff.manifest_diff(a, b).groupBy("change_type").count().collect()}
    assert counts == {"Modified": 100, "Added": 50}


def test_priorities_and_acknowledgement(spark):
    rows = [("large", "Added", ["a", "b", "c"]), ("small", "Added", ["d"]), ("mod", "Modified", ["e"]), ("del", "Deleted", [])]
    out = spark.createDataFrame(rows, "path string, change_type string, required array<string>")
    assert [r.path for r in diff.prioritised(out).orderBy(*diff.priority_order()).collect()] == ["mod", "small", "large", "del"]
    acked = spark.createDataFrame([("a",), ("d",), ("e",)], "hash string")
    assert [(r.path, r.n_left) for r in diff.acknowledged(out, acked).collect()] == [("large", 2)]


def plain_root(rows):
    def leaf(p, size, h, chunks, t, mode):
        raw = lambda x: bytes.fromhex(x) if len(x) == 64 else bytes(32)
        return hashlib.sha256(p.encode() + struct.pack("<Q", size) + raw(h) + struct.pack("<I", mode or 0) + struct.pack("<q", t) + b"".join(map(raw, chunks))).digest()

    level = [leaf(*r) for r in sorted(rows, key=lambda r: r[0].encode())]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex() if level else hashlib.sha256(b"").hexdigest()


def test_merkle_root_for_every_small_size(spark):
    hexes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(9)]
    for n in (0, 1, 2, 3, 5, 8, 9):
        rows = [entry(f"p{i}", i, hexes[i], hexes[: i % 3], 100 + i, None if i == 2 else 493) for i in range(n)]
        assert manifest.merkle_root(manifest.merkle_leaves(entries(spark, *rows[::-1]))).first().root == plain_root(rows)


def test_merkle_root_over_blocks(spark):
    for n, levels in ((1025, 10), (17, 2), (16, 2), (33, 1), (21, 2)):
        rows = [entry(f"p{i:05d}", i) for i in range(n)]
        assert manifest.merkle_root(manifest.merkle_leaves(entries(spark, *rows)), levels=levels).first().root == plain_root(rows)


def test_merkle_root_for_each_folder_and_bad_hex(spark):
    rows = [entry("a/1", h="zz"), entry("a/2"), entry("a/3"), entry("b/1")]
    leaves = manifest.merkle_leaves(entries(spark, *rows)).withColumn("folder", scalar.first_component(F.col("path")))
    got = {r.folder: r.root for r in manifest.merkle_root(leaves, "folder").collect()}
    assert got == {"a": plain_root(rows[:3]), "b": plain_root(rows[3:])}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    rows = spark.range(1000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("path"))
    m, k = bloom.parameters(1000)
    assert (m, k) == (9586, 7) and bloom.false_positive_rate(m, k, 1000) < 0.02
    bits = bloom.build(rows, "path", m, k)
    assert bloom.probe(rows, "path", bits, m, k).where("not maybe").count() == 0
    others = rows.select(F.concat(F.lit("o"), "path").alias("path"))
    assert bloom.probe(others, "path", bits, m, k).where("maybe").count() < 30


def test_conflicts_and_resolution(spark):
    a = entries(spark, entry("both", h="1", t=100), entry("old", h="1", t=5), entry("mine", t=100), entry("eq", h="s", t=100))
    b = entries(spark, entry("both", h="2", t=200), entry("old", h="2", t=200), entry("eq", h="s", t=300))
    out = {r.path: r for r in conflict.conflicts(a, b, 50).collect()}
    assert {p: r.conflict_type for p, r in out.items()} == {"both": "BothModified", "mine": "DeletedModified"}
    assert set(r.path for r in conflict.conflicts(a, b, None).collect()) == {"both", "old"}
    told = conflict.conflicts(a, b, 50).select("path", conflict.auto_resolution(F.col("conflict_type"), F.col("local_mtime"), F.col("remote_mtime")).alias("r"))
    assert {r.path: r.r for r in told.collect()} == {"both": "KeepRemote", "mine": "KeepLocal"}


def test_packs_close_by_size_and_count(spark):
    rows = [(f"00{i:03d}", s) for i, s in enumerate([60, 50, 10, 10, 10, 90, 5])]
    out = store.pack_by_size(spark.createDataFrame(rows, "hash string, size long"), most_bytes=100, most_objects=3).orderBy("hash").collect()
    expected, pack, size, count = [], 0, 0, 0
    for i, (_, s) in enumerate(rows):
        if i and (size >= 100 or count >= 3):
            pack, size, count = pack + 1, 0, 0
        size, count = size + s, count + 1
        expected.append(pack)
    assert [r.pack for r in out] == expected


def test_integrity(spark):
    good = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(good, 1, bytearray(b"x")), (good, 1, bytearray(b"y")), (good, 1, None)], "hash string, size long, data binary")
    told = store.integrity(rows).first()
    assert (told.total, told.verified, told.corrupt, told.error, told.healthy) == (3, 1, 1, 1, False)
    assert store.integrity(rows.limit(0)).first().health_percent == 100.0


def test_transfer_and_resume_rules(spark):
    rows = [(1, "a", 0, "add"), (1, "a", 1, "complete"), (1, "b", 2, "add"), (1, "c", 3, "add"), (1, "c", 4, "fail"), (1, "d", 5, "complete"), (1, "d", 6, "fail")]
    told = transfer.chunk_states(spark.createDataFrame(rows, "session_id long, hash string, seq long, event string")).first()
    assert (told.completed, told.pending, told.failed) == (2, 1, 2)
    pushes = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("b", 2, 2)], "request_id string, priority int, seq long")
    assert [r.request_id for r in transfer.scheduled(pushes, 1).collect()] == ["a"]


def test_series_rules(spark):
    one = spark.range(1)
    told = one.select(series.eta_seconds(F.lit(0), F.lit(10)).alias("a"), series.eta_seconds(F.lit(100), F.lit(10)).alias("b"), series.eta_seconds(F.lit(30), F.lit(10)).alias("c"), series.percentile_at(F.array(*map(F.lit, range(10))), 95).alias("p")).first()
    assert tuple(told) == (None, 0, 23, 9)
    rows = spark.createDataFrame([("k", 0, 0), ("k", 30_000_000, 300), ("k", 31_000_000, 400), ("k", 32_000_000, 100)], "key string, us long, bytes long")
    assert [r.bandwidth for r in series.bandwidth(rows).orderBy("us").collect()] == [0.0, 0.0, 100.0, 0.0]
    buffer = spark.range(13).select(F.lit(1).alias("k"), "id")
    assert series.recent_drained(buffer, ["k"], [F.col("id")], most=10, drained=5).count() == 8


def test_health_edges(spark):
    rows = spark.createDataFrame([(100, 0, 0.9, 60.0, 0, 0), (100, 2, 0.9, 60.0, 0, 0), (100, 10, 0.9, 60.0, 0, 0), (100, 10, 0.1, 10.0, 0, 0), (100, 10, 0.1, 10.0, 101, 1001)], "n long, e long, h double, t double, p long, f long")
    score = metrics.health_score(*(F.col(c) for c in "nehtpf"))
    got = rows.select(score.alias("s")).withColumn("x", metrics.health_status(F.col("s"))).collect()
    assert [(r.s, r.x) for r in got] == [(1.0, "Healthy"), (0.9, "Healthy"), (0.7, "Warning"), (0.3, "Unknown"), (0.1, "Unknown")]


def test_ignored_names(spark):
    rows = spark.createDataFrame([(n,) for n in ("d/.git", "a.tmp", "a.swp", "x~", ".#l", "#a#", "ok")], "p string")
    got = rows.select("p", scalar.ignored(F.col("p")).alias("i"), scalar.ignored(F.col("p"), scalar.WATCHER_IGNORED).alias("w")).collect()
    assert [r.i for r in got] == [True, True, False, False, False, False, False]
    assert [r.w for r in got] == [True, True, True, True, True, False, False]  # "#*#" is taken literally
