"""Document quality from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, of digits or of other signs; case is kept and digits are all alike. Each token falls into one
of ``buckets`` hash buckets. A bucket has a fixed sparse random index vector, and its word vector is the sum of the index
vectors of the tokens up to two places before and after it, over the whole corpus. A document is the mean and the spread
of the word vectors of all its tokens. A network with one hidden layer maps that to a probability, calibrated by a
temperature on rows that its weights have not seen.

Word vectors use every document. Only the network is fitted on a sample: at most ``per_label`` labelled documents for
each label value, weighted so that labels count as often as they occur among all training labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import id_remainder, one_of_each
from .text_arrays import BYTE_VALUE, U, raw, slices, spans

BUCKETS, DIMENSIONS, SPARSE, REACH = 65536, 32, 2, 2
FEATURES = 2 * DIMENSIONS + REACH + 2
KIND = np.full(256, 3, np.uint8)  # 0 space and control, 1 letter, 2 digit, 3 other
KIND[:33] = 0
KIND[127] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
SAME_DIGIT = np.arange(256, dtype=np.uint8)
SAME_DIGIT[48:58] = 48


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMENSIONS, (BUCKETS, SPARSE)), rng.choice([-1.0, 1.0], (BUCKETS, SPARSE))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and the number of tokens before each text (one more entry)."""
    data, at = raw(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    cuts = np.flatnonzero(new)
    word = kind[cuts[:-1]] > 0
    starts, ends = cuts[:-1][word], cuts[1:][word]
    buckets = (spans(BYTE_VALUE[SAME_DIGIT[data]], starts, ends) & U(BUCKETS - 1)).astype(np.int64)
    return buckets, np.searchsorted(starts, at)


def neighbour_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: of each bucket met in this task, the sum of the index vectors of its neighbours."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    for batch in slices(batches, "text"):
        buckets, before = tokens(batch.column("text"))
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        for apart in range(1, REACH + 1):
            together = owner[apart:] == owner[:-apart]
            a, b = buckets[:-apart][together], buckets[apart:][together]
            for left, right in ((a, b), (b, a)):
                for s in range(SPARSE):
                    total += np.bincount(left * DIMENSIONS + places[right, s], signs[right, s], BUCKETS * DIMENSIONS)
    total = total.reshape(BUCKETS, DIMENSIONS)
    met = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(total[met, d].astype(np.int64)) for d in range(DIMENSIONS))], names=["bucket", *(f"d{d}" for d in range(DIMENSIONS))])


def word_vectors(documents: DataFrame) -> np.ndarray:
    """buckets x dimensions, of unit length, each with its own index vector mixed in; a fixed size for any corpus."""
    schema = "bucket int, " + ", ".join(f"d{d} long" for d in range(DIMENSIONS))
    sums = documents.select("text").mapInArrow(neighbour_sums, schema)
    rows = sums.groupBy("bucket").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMENSIONS))).toPandas()
    total = np.zeros((BUCKETS, DIMENSIONS))
    total[rows["bucket"].to_numpy(np.int64)] = rows[[f"d{d}" for d in range(DIMENSIONS)]].to_numpy(float)
    total = np.sign(total) * np.log1p(np.abs(total))
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    return (total + own / np.sqrt(SPARSE)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of the word vectors of each text: mean, spread, length of the mean, how many equal the one or two before them.

    The last entry is the logarithm of the number of tokens. Zeros without tokens.
    """
    buckets, before = tokens(texts)
    n = len(before) - 1
    out = np.zeros((n, FEATURES), np.float32)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        of = vectors[buckets]
        counts = np.diff(before)[some][:, None]
        mean = np.add.reduceat(of, before[some]) / counts
        square = np.add.reduceat(of * of, before[some]) / counts
        out[some, :DIMENSIONS] = mean
        out[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, 2 * DIMENSIONS] = np.linalg.norm(mean, axis=1)
        owner = np.repeat(np.arange(n), np.diff(before))
        for apart in range(1, REACH + 1):
            same = np.zeros(len(buckets), np.float32)
            same[apart:] = (buckets[apart:] == buckets[:-apart]) & (owner[apart:] == owner[:-apart])
            out[some, 2 * DIMENSIONS + apart] = np.add.reduceat(same, before[some]) / counts[:, 0]
        out[some, -1] = np.log1p(counts[:, 0]) / 10
    return out


def features(vectors: np.ndarray, keep: list[str]):
    """For mapInArrow: the columns in keep and the pooled vector of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pooled(batch.column("text"), vectors)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=[*keep, "x"])

    return run


class Network:
    """One hidden layer of rectified units and a logistic output, fitted by Adam; temperature scales the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, steps: int = 600, seed: int = 11):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2  # for the temperature
        if len(set(y[~aside])) < 2 or not aside.any():
            aside[:] = False
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.shift) / self.scale
        fit, target, w = z[~aside], y[~aside], weight[~aside] / weight[~aside].sum()
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        self.temperature = 1.0
        for t in range(1, steps + 1):
            pre = fit @ self.p[0] + self.p[1]
            act = np.maximum(pre, 0)
            d = (1 / (1 + np.exp(-np.clip(act @ self.p[2] + self.p[3], -30, 30))) - target) * w
            back = np.outer(d, self.p[2]) * (pre > 0)
            grads = [fit.T @ back + 1e-4 * self.p[0], back.sum(0), act.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                self.p[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if aside.any():
            logit, target, w = self.logit(x[aside]), y[aside], weight[aside]
            loss = lambda t: float((w * np.logaddexp(0, np.where(target == 1, -logit, logit) / t)).sum())
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_quality(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, fold: int = 5, held: int = 0, per_label: int = 2048) -> Network | None:
    """The network, from labelled documents outside the held-out fold; None unless both labels occur."""
    usable = labels.where(F.col("quality").isin(0, 1) & (id_remainder(fold) != held)).select("doc_id", "quality").distinct()
    counts = {r[0]: r[1] for r in usable.groupBy("quality").agg(F.count("*")).collect()}
    chosen = F.broadcast(one_of_each(usable, "quality", "doc_id", per_label))  # 2 * per_label rows at most
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(features(vectors, ["doc_id", "quality"]), "doc_id long, quality int, x array<float>").toPandas()
    rows = rows.sort_values("doc_id").drop_duplicates(["doc_id", "quality"])
    y = rows["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    weight = np.where(y == 1, counts.get(1, 0) / max((y == 1).sum(), 1), counts.get(0, 0) / max((y == 0).sum(), 1))
    return Network(np.stack(rows["x"].to_numpy()).astype(float), y, weight)


def score_quality(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, per_label: int = 2048, accept: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    score is the probability of label 1. Null and empty texts are scored like any text, from the all-zero vector. Without
    training rows of both labels every score is 0.5. Null doc_ids are scored but never learned from; repeated rows get
    equal scores; further columns are ignored; an empty table gives an empty result.
    """
    vectors = word_vectors(documents)
    network = fit_quality(documents, labels, vectors, fold, held, per_label)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = len(batch)
            p = network.probability(pooled(batch.column("text"), vectors).astype(float)) if network else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= accept).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(id_remainder(fold) == held, F.lit(False)).alias("held_out")
    return documents.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accept_quality(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, per_label: int = 2048, accept: float = 0.3) -> DataFrame:
    """The documents, all columns as they are, whose score (as in score_quality) is at least ``accept``; no shuffle."""
    vectors = word_vectors(documents)
    network = fit_quality(documents, labels, vectors, fold, held, per_label)
    if network is None:
        return documents

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(network.probability(pooled(batch.column("text"), vectors).astype(float)) >= accept))

    return documents.mapInArrow(run, documents.schema)
