import zlib

import numpy as np
import pytest

from tessella.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 101, 300, 1023, 1025])
def test_every_number_has_its_own_place(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    a, b = sharding.halves(n)
    at = sharding.permute_once(np.arange(n), a, b)
    while (at >= n).any():
        at = np.where(at >= n, sharding.permute_once(at, a, b), at)
    assert sorted(at.tolist()) == list(range(n)) and got == [int(at[i]) for i in range(n)]


def test_query_equals_a_plain_shuffle(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    n = len(docs)
    a, b = sharding.halves(n)
    at = sharding.permute_once(np.arange(n), a, b)
    while (at >= n).any():
        at = np.where(at >= n, sharding.permute_once(at, a, b), at)
    expected = {i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", int(at[k] % 40), int(at[k] // 40), None) for k, (i, t) in enumerate(docs)}
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in queries.op9_feistel_sharding(spark, small).collect()}
    assert got == expected


def test_odd_rows(odd, none):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == 11 and sorted(r.row_number for r in rows) == list(range(11))
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(16, 0)}
    assert sharding.shard_documents(none, 4).count() == 0
