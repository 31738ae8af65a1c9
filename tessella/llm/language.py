"""Language of a text by a small convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes (ASCII letters in lower case, the last window padded). Bytes are embedded,
filters of several widths run over a window, each keeps its largest response, and a softmax layer gives probabilities.
A document's probabilities are the means over all its windows, weighted by their bytes. The network is trained in numpy on
at most ``per_language`` labelled documents for each language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import id_remainder, one_of_each
from .text_arrays import LOWER, raw, slices

WINDOW, EMBEDDING, FILTERS, WIDTHS, BLOCK = 128, 16, 16, (2, 3, 4), 64


def byte_windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover every byte of every text, the text that each belongs to, and its bytes."""
    sizes = np.diff(at)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[:-1][owner] + nth * WINDOW
    size = np.minimum(WINDOW, at[1:][owner] - start)
    place = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    padded = np.append(LOWER[data], np.uint8(0))
    return np.where(inside, padded[np.minimum(place, len(data))], 0).astype(np.uint8), owner, size


class ByteNetwork:
    """Embedding, filters, largest response and softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["c"] = np.zeros(len(languages))

    def tables(self) -> dict[int, np.ndarray]:
        """For each width: what each byte adds to each filter at each tap."""
        return {w: (self.p["e"] @ self.p[f"w{w}"]).astype(np.float32) for w in WIDTHS}

    def responses(self, x: np.ndarray, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each window, and where it is."""
        best, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            got = tables[w][0][x[:, :n]]
            for k in range(1, w):
                got += tables[w][k][x[:, k : k + n]]
            at = got.argmax(axis=1)
            best.append(np.take_along_axis(got, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
            where.append(at)
        return np.concatenate(best, 1), np.stack(where)

    def largest(self, x: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """As responses(), without the places."""
        best = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            got = tables[w][0].take(x[:, :n], axis=0)
            for k in range(1, w):
                got += tables[w][k].take(x[:, k : k + n], axis=0)
            best.append(got.max(axis=1) + self.p[f"b{w}"])
        return np.concatenate(best, 1)

    def probabilities(self, x: np.ndarray, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        return softmax(np.maximum(self.largest(x, tables), 0) @ self.p["o"] + self.p["c"])

    def fit(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, steps: int = 400, batch: int = 64, seed: int = 6) -> None:
        """Learn windows x of ``sizes`` bytes; a window is drawn as often as its language's share of bytes says."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        shares = [sizes[b] / sizes[b].sum() for b in by]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            rows = np.concatenate([rng.choice(b, max(1, batch // len(by)), p=p) for b, p in zip(by, shares, strict=True)])  # languages in equal parts
            xb, yb = x[rows], y[rows]
            best, where = self.responses(xb, self.tables())
            act = np.maximum(best, 0)
            d = softmax(act @ self.p["o"] + self.p["c"])
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            g = {"o": act.T @ d, "c": d.sum(0), "e": np.zeros_like(self.p["e"])}
            back = (d @ self.p["o"].T) * (best > 0)
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"], g[f"w{w}"] = part.sum(0), np.zeros_like(self.p[f"w{w}"])
                for k in range(w):
                    seen = np.take_along_axis(xb, where[i] + k, 1)  # the bytes that the largest responses came from
                    g[f"w{w}"][k] = np.einsum("bf,bfe->ef", part, self.p["e"][seen])
                    np.add.at(g["e"], seen, part[:, :, None] * self.p[f"w{w}"][k].T[None])
            for k, grad in g.items():
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad * grad - v[k])
                self.p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_language(documents: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 256, windows: int = 8, rows: int = 1 << 17) -> ByteNetwork | None:
    """The network, from labelled documents outside the held-out fold; None without any.

    The sample, which bounds the fitting only: at most ``per_language`` documents for each language, and ``windows`` evenly
    spread windows of each. With so many languages that this would pass ``rows`` windows, each gets an equal part of them,
    one document at least. Windows of any length are learned, by their bytes.
    """
    usable = documents.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (id_remainder(modulus) != held)).select("doc_id", "lang")
    languages = usable.select("lang").distinct().count()
    most = max(1, min(per_language, rows // (windows * max(1, languages))))
    chosen = one_of_each(usable, "lang", "doc_id", most)
    if languages * most <= rows // windows:  # a proven bound; with more languages Spark decides by their size
        chosen = F.broadcast(chosen)
    picked = documents.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, owner, size = byte_windows(*raw(batch.column("text")))
            bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
            picks = [a + np.unique(np.linspace(0, b - a - 1, windows).astype(int)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
            at = np.concatenate([*picks, np.zeros(0, int)]).astype(int)
            langs, ids = (batch.column(c).take(pa.array(owner[at], pa.int64())) for c in ("lang", "doc_id"))
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array([x[r].tobytes() for r in at], pa.binary()), pa.array(size[at])], names=["doc_id", "lang", "x", "size"])

    found = picked.mapInArrow(cut, "doc_id long, lang string, x binary, size long").toPandas().sort_values(["lang", "doc_id", "x"])
    if not len(found):
        return None
    names = sorted(found["lang"].unique())
    network = ByteNetwork(names)
    network.fit(np.stack([np.frombuffer(b, np.uint8) for b in found["x"]]), found["lang"].map(names.index).to_numpy(), found["size"].to_numpy(float))
    return network


def identify_language(documents: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 256) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    lang_pred is ``und`` with score 0 for a null text, a text without a letter, and without training rows. Null doc_ids
    are predicted but never learned from; repeated rows get equal predictions; ties go to the first language in order;
    further columns are ignored; an empty table gives an empty result.
    """
    network = fit_language(documents, modulus, held, per_language)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        names = np.array([*network.languages, "und"] if network else ["und"], object)
        for batch in slices(batches, "text"):
            n = len(batch)
            total = np.zeros((n, len(names) - 1))
            weight = np.zeros(n)
            if network:
                x, owner, size = byte_windows(*raw(batch.column("text")))
                for at in range(0, len(x), BLOCK):
                    p = network.probabilities(x[at : at + BLOCK], tables) * size[at : at + BLOCK, None]
                    np.add.at(total, owner[at : at + BLOCK], p)
                np.add.at(weight, owner, size)
            known = np.asarray(batch.column("has_letter"), bool) & (weight > 0)
            pick = np.where(known, total.argmax(axis=1) if total.shape[1] else -1, len(names) - 1)
            score = np.where(known, total.max(axis=1, initial=0) / np.maximum(weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[pick], pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(id_remainder(modulus) == held, F.lit(False)).alias("held_out")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return documents.select("doc_id", held_out, letter, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
