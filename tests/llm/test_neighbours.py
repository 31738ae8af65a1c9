import numpy as np
from pyspark.sql import functions as F

from tessella.llm import neighbours, queries


def plain(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, expected):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) for q, e in expected.items()) / sum(map(len, expected.values()))


def test_recall_and_scores_on_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, expected = answers(queries.op4_pruned_graph_neighbours(spark, sf)), plain(rows, 10)
    assert recall(got, expected) >= 0.95
    true = {q: dict(plain([(i, v) for i, v in rows], len(rows))[q]) for q in list(expected)[:3]}
    assert all(abs(true[q][i] - s) < 1e-9 for q in true for i, s in got[q])


def test_a_walk_visits_a_small_part_of_a_full_shard(spark):
    """Clustered vectors, one shard of the default size: recall and the share of vectors that a query looks at."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 32))
    x = (centres[rng.integers(0, 64, neighbours.SHARD)] + rng.normal(size=(neighbours.SHARD, 32)) * 0.6).round(4)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    share = frame.agg(F.avg("visited_share"), F.max("visited_share")).first()
    got = recall(answers(frame), plain(rows, 10))
    print("visited", share, "recall", got)
    assert share[1] < 0.10 and got >= 0.9


def test_several_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(frame, F.col("vec_id") % 100 == 0, 10, shard=300, block=4))
    assert recall(got, plain(rows, 10)) >= 0.95


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 300)] + [(i, [0.0, 1.0]) for i in range(300, 305)]
    got = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0))
    assert got == plain(rows, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0]), (7, []), (8, [1.0]), (0, [1.0, 1.0]), (200, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rep string")
    got = answers(neighbours.nearest(frame, F.col("vec_id") % 100 == 0))
    assert {q: [i for i, _ in a] for q, a in got.items()} == {0: [6, 100], 100: [0, 6]}
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
