from pyspark.sql import functions as F

from tessella.sources.tables import VersionedTable


def chunk(spark, *rows):
    return spark.createDataFrame(list(rows), "hash string, size long, ref_count long")


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_upsert_ignore_delete_and_vacuum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "chunks")
    assert content(table) == [] and table.versions() == []
    assert table.upsert(chunk(spark, ("a", 1, 1), ("b", 2, 1)), ["hash"]) == 1
    table.upsert(chunk(spark, ("b", 3, 7), ("b", 9, 9), ("c", 1, 1)), ["hash"], [F.col("size")])
    assert content(table) == [("a", 1, 1), ("b", 9, 9), ("c", 1, 1)]
    assert content(table, 1) == [("a", 1, 1), ("b", 2, 1)]
    table.insert_or_ignore(chunk(spark, ("a", 5, 5), ("d", 1, 1), ("d", 2, 2)), ["hash"], [F.col("size")])
    assert content(table) == [("a", 1, 1), ("b", 9, 9), ("c", 1, 1), ("d", 1, 1)]
    table.delete(spark.createDataFrame([("a",)], "hash string"))
    assert [r[0] for r in content(table)] == ["b", "c", "d"]
    assert table.vacuum() == [1, 2, 3] and table.versions() == [4]


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "chunks")
    table.upsert(chunk(spark, ("a", 1, 1)), ["hash"])
    (tmp_path / "chunks" / "v=2").mkdir()
    assert table.versions() == [1] and table.upsert(chunk(spark, ("b", 1, 1)), ["hash"]) == 2
    assert [r[0] for r in content(table)] == ["a", "b"]


def test_references(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "chunks")
    table.add_references(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "hash string, size long"))
    table.add_references(spark.createDataFrame([("a", 1), ("c", 3)], "hash string, size long"))
    assert content(table) == [("a", 1, 3), ("b", 2, 1), ("c", 3, 1)]
