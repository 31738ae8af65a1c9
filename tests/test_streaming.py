"""Streams give what the batch forms give; state machines follow their rules."""

import datetime as dt

from tessella.sources import files
from tessella.streaming import events as ev
from tessella.streaming import state

T0 = dt.datetime(2024, 1, 1)


def event_rows(offsets_ms):
    return [(T0 + dt.timedelta(milliseconds=ms), i, "p", k, None) for i, (ms, k) in enumerate(offsets_ms)]


def test_debounce_in_batch_and_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.schemas import FS_EVENT

    rows = spark.createDataFrame(event_rows([(0, "Created"), (400, "Modified"), (900, "Removed"), (1399, "Created"), (2000, "Modified")]), FS_EVENT)
    rows.write.parquet(str(tmp_path / "in"))
    batch = ev.debounced(rows.select("path", "seq", "kind", F.unix_micros("ts").alias("us")), 500_000)
    expected = sorted((r.kind, r.n_events) for r in batch.collect())
    assert expected == [("Created", 2), ("Modified", 1), ("Modified", 2)]
    # a late marker moves the watermark on, so that all bursts close
    spark.createDataFrame([(T0 + dt.timedelta(hours=1), 99, "z", "End", None)], FS_EVENT).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ev.debounced_stream(ev.read_events(spark, str(tmp_path / "in"), FS_EVENT), 500_000, "0 seconds")
    run = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.kind, r.n_events) for r in spark.table("debounced").collect() if r.path == "p")
    assert got == expected


def test_renames(spark):
    rows = spark.createDataFrame([(1, 0, "MovedFrom", "a"), (1, 500_000, "MovedTo", "b"), (2, 0, "MovedTo", "c"), (3, 0, "MovedFrom", "d"), (4, 0, "MovedFrom", "e"), (4, 2_000_000, "MovedTo", "f")], "cookie long, us long, kind string, path string")
    got = sorted((r.path, r.old_path, r.kind) for r in ev.paired_renames(rows).collect())
    assert got == [("b", "a", "Renamed"), ("c", None, "Created"), ("f", None, "Created")]


def test_deepest_folder_by_whole_components(spark):
    rows = spark.createDataFrame([(0, "a/b/c"), (1, "ab/c"), (2, "a"), (3, "x")], "seq long, path string")
    folders = spark.createDataFrame([("a",), ("a/b",)], "folder string")
    assert {r.seq: r.folder for r in ev.folders_of(rows, folders).collect()} == {0: "a/b", 1: None, 2: "a", 3: None}


def run_machine(spark, step, rows):
    out = state.folded(spark.createDataFrame([("k", i, float(t), e, v) for i, (t, e, v) in enumerate(rows)], "key string, seq long, ts double, event string, value double"), step)
    return [r.output for r in out.orderBy("seq").collect()]


def test_circuit_breaker(spark):
    rows = [(0, "failure", 0.0), (1, "failure", 0.0), (2, "success", 0.0), (12, "success", 0.0), (13, "success", 0.0), (14, "failure", 0.0), (15, "success", 0.0)]
    assert run_machine(spark, state.circuit_breaker(2, 2, 10), rows) == ["Closed", "Open", "Open", "HalfOpen", "Closed", "Closed", "Closed"]
    assert run_machine(spark, state.circuit_breaker(1, 2, 10), [(0, "failure", 0.0), (10, "failure", 0.0), (11, "success", 0.0)]) == ["Open", "Open", "Open"]


def test_rate_limit_counts_accepted_attempts_only(spark):
    rows = [(0.0, "", 0.0), (0.1, "", 0.0), (0.2, "", 0.0), (0.9, "", 0.0), (1.0, "", 0.0), (1.05, "", 0.0)]
    assert run_machine(spark, state.rate_limit(2, 1.0), rows) == ["accepted", "accepted", "rejected", "rejected", "accepted", "rejected"]


def test_session_fails_on_a_wrong_message(spark):
    assert run_machine(spark, state.sync_session(), [(0, "hello", 0.0), (1, "manifest", 0.0), (2, "summary", 0.0)]) == ["Negotiating", "Failed", "Failed"]


def test_saves_by_count_and_by_time(spark):
    from tessella.operators.transfer import count_saves

    rows = spark.createDataFrame([(s, i) for s in "ab" for i in range(7)], "session_id string, seq long")
    assert sorted((r.session_id, r.seq) for r in count_saves(rows, 3).where("saved").collect()) == [("a", 2), ("a", 5), ("b", 2), ("b", 5)]
    times = [(t, "", 0.0) for t in (5.0, 10.0, 14.9, 15.0, 24.0, 25.5, 40.0)]
    assert run_machine(spark, state.save_cadence(10.0), times) == ["kept", "kept", "kept", "saved", "kept", "saved", "saved"]


def test_machine_on_a_stream_equals_batch(spark, tmp_path):
    schema = "key string, seq long, ts double, event string, value double"
    rows = spark.createDataFrame([(f"k{i % 3}", i, float(i), "failure" if i % 4 else "success", 0.0) for i in range(30)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = state.folded_stream(ev.read_events(spark, str(tmp_path / "in"), schema), state.circuit_breaker(3, 1, 5))
    run = stream.writeStream.format("memory").queryName("machine").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.table("machine").collect()))
    assert got == sorted(map(tuple, state.folded(rows, state.circuit_breaker(3, 1, 5)).collect()))


def test_folder_index_and_store(spark, tmp_path):
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.txt").write_bytes(b"x" * 3000)
    (folder / "b.tmp").write_bytes(b"no")
    (folder / "empty").write_bytes(b"")
    from tessella.operators.chunking import SMALL
    from tessella.operators.store import object_rows

    rows = {r.path: r for r in files.index_folder(spark, str(folder), SMALL).collect()}
    assert set(rows) == {"sub/a.txt", "empty"} and rows["sub/a.txt"].size == 3000 and len(rows["sub/a.txt"].chunk_hashes) > 1
    assert rows["empty"].size == 0 and rows["empty"].chunk_hashes == []
    root = str(tmp_path / "store")
    for _ in range(2):
        files.write_objects(object_rows(files.scan(spark, str(folder))), root)
    assert files.read_objects(spark, root).count() == 2


def test_listing_keeps_empty_files_and_tells_problems(spark, tmp_path):
    from tessella.scratch import Scratch

    folder = tmp_path / "f"
    (folder / "a" / "b").mkdir(parents=True)
    (folder / ".git").mkdir()
    for name in ("x", "a/y", "a/b/z", ".git/config", "a/gone"):
        (folder / name).write_bytes(b"" if name == "x" else name.encode())
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "w").write_bytes(b"far")
    (folder / "a" / "link").symlink_to(folder / "a" / "y")
    (folder / "a" / "out").symlink_to(tmp_path / "far")
    (folder / "a" / "b" / "back").symlink_to(folder / "a")
    (folder / "a" / "dangling").symlink_to(folder / "nothing")
    plain = {r.path: r.size for r in files.scan(spark, str(folder), content=False).collect()}
    assert plain == {"x": 0, "a/y": 3, "a/b/z": 5, "a/gone": 6}
    assert {r.path for r in files.scan(spark, f"file://{folder}").collect()} == set(plain)
    followed = {r.path: r.kind for r in files.listing(spark, str(folder), Scratch(spark, "t"), follow_links=True).collect()}
    assert followed == {**dict.fromkeys(plain, "file"), "a/link": "file", "a/out/w": "file", "a/b/back": "problem", "a/dangling": "problem"}
    found = files.listing(spark, str(folder), Scratch(spark, "t"))
    (folder / "a" / "gone").unlink()
    told = {r.path: r.problem is None for r in files.contents(found, str(folder)).collect()}
    assert told == {"x": True, "a/y": True, "a/b/z": True, "a/gone": False}
