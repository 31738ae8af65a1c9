"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors are one node: the graph holds each distinct vector once, with its smallest vec_ids (one more than are asked
for; no answer can need others). Distinct vectors are dealt by hash into shards of about ``SHARD``. In a shard, vectors
are inserted in rounds: a greedy beam search from fixed entries proposes neighbours, and relaxed distance pruning keeps a
neighbour only if no kept one is nearer to it by the factor ``ALPHA``, which leaves diverse edges; the edges are mirrored
and pruned again. Queries, in blocks, search every shard by beam search; the nearest of all shards are merged. Distances
that are returned are Euclidean, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARD, DEGREE, BEAM, SEARCH_BEAM, ALPHA, ENTRIES, WIDE, ROUND = 8192, 32, 64, 64, 1.2, 8, 4, 256


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query: places of the nearest vectors found (-1 if fewer), their squared distances, how many were looked at.

    Nearest first.

    All queries of a block walk together; each step expands the ``WIDE`` nearest entries of every beam not yet expanded.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for no vector
    seen[:, -1] = True
    ids = np.full((n, beam), -1)
    near = np.full((n, beam), np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    fresh = np.broadcast_to(entries, (n, len(entries)))
    while True:
        fresh = np.where(seen[rows, fresh], -1, fresh)
        order = np.sort(fresh, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        fresh = order
        seen[rows, fresh] = True
        away = x[fresh] - queries[:, None]
        far = np.where(fresh < 0, np.inf, np.einsum("qnd,qnd->qn", away, away))
        all_ids, all_near = np.concatenate([ids, fresh], 1), np.concatenate([near, far], 1)
        all_open = np.concatenate([opened, fresh < 0], 1)
        keep = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        ids, near, opened = all_ids[rows, keep], all_near[rows, keep], all_open[rows, keep]
        waiting = np.where(opened, np.inf, near)
        pick = np.argpartition(waiting, min(WIDE, beam - 1), axis=1)[:, :WIDE]
        usable = np.isfinite(waiting[rows, pick])
        if not usable.any():
            return ids, near, seen.sum(axis=1) - 1
        opened[rows, pick] = True
        fresh = np.where(usable[:, :, None], edges[np.where(usable, ids[rows, pick], 0)], -1).reshape(n, -1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each point from its candidates (-1 for none): the nearest left is kept and drops those it covers."""
    rows = np.arange(len(points))
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    away = x[order] - x[points][:, None]
    far = np.where(order < 0, np.inf, np.einsum("pnd,pnd->pn", away, away))
    by = np.argsort(far, axis=1, kind="stable")[:, : 4 * degree]
    order, far = order[rows[:, None], by], far[rows[:, None], by]
    vectors, left = x[order], far.copy()
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[ok, k] = order[rows, best][ok]
        apart = vectors - vectors[rows, best][:, None]
        covered = alpha * alpha * np.einsum("pnd,pnd->pn", apart, apart) <= far
        left[covered] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges and search entries of the graph over the rows of x."""
    rng = np.random.default_rng(seed)
    n = len(x)
    middle = ((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), middle))
    edges = np.full((n, DEGREE), -1)
    start = min(n - 1, 8)
    if start > 0:
        edges[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, ROUND):
            points = order[at : at + ROUND]
            found, _, _ = beam_search(x, edges, entries, x[points], BEAM)
            edges[points] = robust_prune(x, points, np.concatenate([found, edges[points]], 1), DEGREE, alpha)
            source, target = np.repeat(points, DEGREE), edges[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            if not len(target):
                continue
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            counts = np.diff(np.append(first, len(target)))
            incoming = np.full((len(first), counts.max(initial=0)), -1)
            incoming[np.repeat(np.arange(len(first)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
            for part in range(0, len(first), ROUND):
                own = target[first[part : part + ROUND]]
                edges[own] = robust_prune(x, own, np.concatenate([edges[own], incoming[part : part + ROUND]], 1), DEGREE, alpha)
    return edges, entries


def packed_graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: the graph of one shard."""
    rows = rows.sort_values("rep")
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    edges, entries = build_graph(x.astype(np.float32))
    blobs = [rows["rep"].to_numpy(np.int64), x, edges.astype(np.int32), entries.astype(np.int32)]
    return pd.DataFrame([[key[0], key[1], *(b.tobytes() for b in blobs)]], columns=["shard", "dims", "reps", "vectors", "edges", "entries"])


def packed_queries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: one block of queries."""
    rows = rows.sort_values("rep")
    return pd.DataFrame([[key[0], key[1], rows["rep"].to_numpy(np.int64).tobytes(), np.stack(rows["embedding"].to_numpy()).astype(np.float64).tobytes()]], columns=["block", "dims", "query_reps", "queries"])


def searched(most: int):
    """For mapInArrow: the nearest distinct vectors of a shard for each query; ``visited`` is told once for each query.

    Rows come by shard: the shard's graph (block -1), then the blocks of queries, one after another. So a task holds one
    graph and one block.
    """

    def found(row: dict, graph: tuple) -> pa.RecordBatch:
        reps, x, edges, entries = graph
        query_reps, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(q), ROUND):
            some = q[at : at + ROUND]
            ids, _, looked = beam_search(x.astype(np.float32), edges, entries, some.astype(np.float32), max(SEARCH_BEAM, 2 * most))
            far = np.where(ids < 0, np.inf, np.sqrt(((x[ids] - some[:, None]) ** 2).sum(axis=2)))
            names = np.where(ids < 0, np.iinfo(np.int64).max, reps[ids])
            order = np.lexsort((names, far), axis=1)[:, :most]
            line = np.arange(len(some))[:, None]
            far, names = far[line, order], names[line, order]
            visited = np.zeros_like(names)
            visited[:, 0] = looked
            real = np.isfinite(far)
            for column, values in zip(out, (np.repeat(query_reps[at : at + ROUND], real.sum(axis=1)), names[real], far[real], visited[real]), strict=True):
                column.append(values)
        arrays = [pa.array(np.concatenate([*c, np.zeros(0, t)]).astype(t)) for c, t in zip(out, (np.int64, np.int64, np.float64, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["query_rep", "rep", "score", "visited"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] < 0:
                    reps, entries = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["entries"], np.int32).astype(np.int64)
                    x = np.frombuffer(row["vectors"], np.float64).reshape(len(reps), row["dims"])
                    graph = reps, x, np.frombuffer(row["edges"], np.int32).reshape(len(reps), -1).astype(np.int64), entries
                else:
                    yield found(row, graph)

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 10, shard: int = SHARD, block: int = 4096) -> DataFrame:
    """The k nearest rows found for each row where ``is_query`` holds: query_id, rank, vec_id, score, visited_share.

    visited_share is the part of all distinct vectors that the query's walks looked at.

    Candidates are all rows with another vec_id and a vector of the same length; ties go to the smaller vec_id; with fewer
    than k candidates all found are returned. Rows with a null vec_id and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Rows that repeat both vec_id and vector count once; further columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    vector = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("embedding")
    rows = embeddings.select("vec_id", is_query.alias("asks"), vector).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = scratch.cut(rows.where(sound).groupBy("embedding", "vec_id").agg(F.max("asks").alias("asks")))
    # Only the k + 1 smallest ids of equal vectors can be answers; the limit is applied before rows are dealt by vector.
    low = rows.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(f"nth <= {k + 1}")
    nodes = scratch.cut(low.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("rep", "ids", "embedding", F.size("embedding").alias("dims")))
    asking = scratch.cut(rows.where("asks").join(nodes.select("rep", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"))
    count = nodes.count()
    shards = max(1, round(count / shard))
    # Each shard is much work and few bytes: a number of partitions of its own keeps Spark from putting them together, and
    # more partitions than shards keep two of few shards from meeting in one.
    spread = max(2 * shards, min(12 * shards, 256))
    dealt = nodes.select("rep", "embedding", "dims", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard")).repartition(spread, "shard")
    graphs = scratch.cut(dealt.groupBy("shard", "dims").applyInPandas(packed_graph, "shard int, dims int, reps binary, vectors binary, edges binary, entries binary"))
    unique = scratch.cut(asking.select("rep").distinct())
    blocks = max(1, -(-unique.count() // block))
    queries = nodes.join(unique, "rep", "left_semi").select("rep", "embedding", "dims", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    queries = scratch.cut(queries.groupBy("block", "dims").applyInPandas(packed_queries, "block int, dims int, query_reps binary, queries binary"))
    # Each block of queries goes to every shard; a graph goes nowhere but to its own task.
    none = F.lit(None).cast("binary")
    rows = graphs.select("shard", "dims", F.lit(-1).alias("block"), F.col("reps").alias("ids"), "vectors", "edges", "entries")
    asks = queries.join(graphs.select("shard", "dims"), "dims").select("shard", "dims", "block", F.col("query_reps").alias("ids"), F.col("queries").alias("vectors"), none.alias("edges"), none.alias("entries"))
    met = rows.unionByName(asks).repartition(spread, "shard").sortWithinPartitions("shard", "dims", "block")
    found = scratch.cut(met.mapInArrow(searched(k + 1), "query_rep long, rep long, score double, visited long"))
    share = found.groupBy("query_rep").agg((F.sum("visited") / F.lit(max(count, 1))).alias("visited_share"))
    best = found.drop("visited").withColumn("nth", F.row_number().over(Window.partitionBy("query_rep").orderBy("score", "rep"))).where(f"nth <= {k + 1}")
    wide = scratch.cut(best.join(nodes.select("rep", "ids"), "rep").select("query_rep", "score", F.explode("ids").alias("vec_id")))
    answers = asking.join(wide, asking.rep == wide.query_rep).where("vec_id <> query_id").drop("rep")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(f"rank <= {k}")
    return ranked.join(share, "query_rep").select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score", "visited_share")
