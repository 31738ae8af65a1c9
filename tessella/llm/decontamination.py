"""Documents that hold benchmark passages, by latent semantic retrieval.

1. Words (letters and digits, case folded for ASCII and Latin-1) of every document become numbers of the benchmark's
   vocabulary; other words share one number. This is the only pass over the texts.
2. Passages are ``PASSAGE`` words. Document frequencies of all passages of the corpus give the TF-IDF weights.
3. A randomised SVD of the passage matrix: every task sums A^T (A Omega) over its rows for one random matrix Omega of
   ``RANK`` columns, the sums are added up, and the driver turns them into singular vectors (Nystroem). Benchmark items
   take part with as much weight in total as the corpus. The matrix has one row for each vocabulary word, so its size is
   bounded by the words of the benchmark, not by the corpus. Sums are integers, so they don't depend on an order.
4. Every passage, one starting every ``STEP`` words, is projected and compared with all items by cosine.
5. Every run of ``GRAM`` words that a document shares with an item is a candidate as well, whatever its cosine: in a large
   benchmark the other vocabulary words of a passage hide a short item. So each verbatim copy is a candidate.
6. Around each local maximum above the threshold and each shared run, the longest common subsequence of item and words
   must cover enough of the item, and also enough of its answer (its last sentence). So paraphrases that keep the order of
   most words count.

Items shorter than ``SHORT`` words say too little for that; they must stand in a document word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import BYTE_VALUE, raw, runs, slices, spans, windows

PASSAGE, STEP, RANK, SHORT, FREQUENT = 48, 16, 64, 8, 192
GRAM, SHARED = 3, 32
SCALE = 1 << 20
BLOCKS = PASSAGE // STEP
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of words before each text (one more entry)."""
    data, at = raw(texts)
    data = FOLD[data]
    if len(data) > 1:  # U+00C0..U+00DE but the multiplication sign, as UTF-8
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    starts, ends, before = runs(WORD[data], at)
    return spans(BYTE_VALUE[data], starts, ends), before


class Items:
    """A block of benchmark items: numbers of their words in the vocabulary of all items, answers."""

    def __init__(self, rows: list[tuple[int, str]], vocabulary: np.ndarray):
        rows = [(i, t) for i, t in rows if t]
        hashes, before = folded_words(pa.array([t for _, t in rows], pa.string()))
        self.vocabulary = vocabulary
        numbers = np.searchsorted(self.vocabulary, hashes)
        own = [numbers[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
        self.ids = [i for (i, _), w in zip(rows, own, strict=True) if len(w)]
        self.words = [w for w in own if len(w)]
        texts = [t for (_, t), w in zip(rows, own, strict=True) if len(w)]
        last = [([p for p in re.split(r"[.!?]+\s*", t) if p.strip()] or [""])[-1] for t in texts]
        ends, at = folded_words(pa.array(last, pa.string()))
        ends = [ends[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.answers = [np.searchsorted(self.vocabulary, e) if len(e) else w[-SHORT:] for e, w in zip(ends, self.words, strict=True)]

    @property
    def size(self) -> int:
        return len(self.vocabulary)


def different_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the hash of each different word of this task's texts."""
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(folded_words(batch.column("text"))[0]).view(np.int64))], names=["word"])


def numbered_words(vocabulary: np.ndarray):
    """For mapInArrow: the vocabulary numbers of the words of each document, as bytes; the last number is any other."""
    kind = np.uint16 if len(vocabulary) < 65535 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(vocabulary, np.uint64(0))
        for batch in slices(batches, "text"):
            hashes, before = folded_words(batch.column("text"))
            at = np.searchsorted(vocabulary, hashes)
            numbers = np.where(table[at] == hashes, at, len(vocabulary)).astype(kind)
            numbers[at == len(vocabulary)] = len(vocabulary)
            out = [numbers[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "words"])

    return run


def unpacked(batches: Iterable[pa.RecordBatch], size: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the written numbers: the rows, all numbers, and how many are before each document."""
    kind = np.uint16 if size < 65535 else np.uint32
    for batch in slices(batches, "words", most=most * np.dtype(kind).itemsize):
        data, at = raw(batch.column("words").cast(pa.large_binary()))
        yield batch, np.frombuffer(data.tobytes(), kind).astype(np.int64), at // np.dtype(kind).itemsize


def cuts(before: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of ``step`` words of each document, and the document of each."""
    sizes = np.diff(before)
    counts = -(-sizes // step)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return before[:-1][owner] + nth * step, owner


def frequencies(size: int):
    """For mapInArrow: in how many of this task's passages each vocabulary word is; -1 for the number of passages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(size + 1, np.int64), 0
        for _, numbers, before in unpacked(batches, size):
            starts, _ = cuts(before, PASSAGE)
            if len(starts):
                passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(numbers))))
                known = numbers < size
                keys = np.unique(passage[known] * (size + 1) + numbers[known])
                total += np.bincount(keys % (size + 1), minlength=size + 1)
                passages += len(starts)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1).astype(np.int32)), pa.array(np.append(total[met], passages))], names=["word", "n"])

    return run


class Sums:
    """Sums of table rows over stretches of words: the most frequent words by a product with their counts."""

    def __init__(self, idf: np.ndarray):
        self.size = len(idf)
        self.top = np.argsort(idf, kind="stable")[:FREQUENT]
        self.place = np.full(self.size + 1, -1)
        self.place[self.top] = np.arange(len(self.top))

    def split(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the frequent words in each stretch, then the other known words and the stretch of each."""
        stretch = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(numbers))))
        place = self.place[numbers]
        often = place >= 0
        width = len(self.top)
        counts = np.bincount(stretch[often] * width + place[often], minlength=len(starts) * width).reshape(len(starts), width).astype(np.float32)
        seldom = np.flatnonzero(~often & (numbers < self.size))
        return counts, numbers[seldom], stretch[seldom]

    def rows(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray) -> np.ndarray:
        counts, words, stretch = parts
        out = counts @ table[self.top]
        if len(words):
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            out[stretch[first]] += np.add.reduceat(table[words], first)
        return out


def sketch(numbers: np.ndarray, starts: np.ndarray, idf: np.ndarray, omega: np.ndarray, sums: Sums) -> np.ndarray:
    """A^T (A Omega) for passages that begin at starts, each a TF-IDF row of unit length."""
    out = np.zeros_like(omega)
    if not len(starts):
        return out
    parts = counts, words, stretch = sums.split(numbers, starts)
    norm = (counts @ (idf[sums.top] ** 2).astype(np.float32)) + np.bincount(stretch, idf[words] ** 2, len(starts))
    rows = sums.rows(parts, (omega * idf[:, None]).astype(omega.dtype)) / np.maximum(norm, 1e-12)[:, None].astype(omega.dtype)
    out[sums.top] = counts.T @ rows
    if len(words):
        order = np.argsort(words, kind="stable")
        each = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
        out[words[order][each]] += np.add.reduceat(rows[stretch[order]], each)
    return out * idf[:, None].astype(omega.dtype)


def sketches(size: int, idf: np.ndarray, omega: np.ndarray):
    """For mapInArrow: this task's part of A^T (A Omega), a row for each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros_like(omega, dtype=np.float64), Sums(idf)
        for _, numbers, before in unpacked(batches, size):
            total += sketch(numbers, cuts(before, PASSAGE)[0], idf, omega, sums)
        met = np.flatnonzero(total.any(axis=1))
        whole = np.rint(total[met] * SCALE).astype(np.int64)  # integers, so that no order of adding up changes the sums
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(whole[:, c]) for c in range(omega.shape[1]))], names=["word", *(f"y{c}" for c in range(omega.shape[1]))])

    return run


def singular_vectors(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors of A, best first, from Y = A^T A Omega."""
    q, r = np.linalg.qr(y)
    core = omega.T @ y
    inner = r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-10, hermitian=True) @ r.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return q @ vectors[:, np.argsort(-values)]


def common(words: np.ndarray, masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of words and an item of that size, bit by bit over the item."""
    full = (1 << size) - 1
    state = full
    for w in words:
        hit = masks.get(w)
        if hit:
            u = state & hit
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def bit_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Grams:
    """Runs of GRAM words of the items that are not short.

    A run that more than SHARED items have says little and leads to few of them: only to those that have no rarer one. So
    every item keeps a run, and a verbatim copy of it is met, while boilerplate of many items costs little.
    """

    def __init__(self, words: list[np.ndarray]):
        own = [i for i, w in enumerate(words) if len(w) >= SHORT]
        sizes = np.array([len(words[i]) for i in own], np.int64)
        flat = np.concatenate([words[i] for i in own] or [np.zeros(0, np.int64)])
        item, at = np.repeat(own, sizes).astype(np.int64), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.flatnonzero(at + GRAM <= np.repeat(sizes, sizes))
        hashes, item, at = windows(flat.astype(np.uint64) + np.uint64(1), GRAM)[inside], item[inside], at[inside]
        _, number = np.unique(hashes, return_inverse=True)
        having = np.bincount(np.unique(np.stack([number, item]), axis=1)[0])[number] if len(number) else number
        least = np.full(len(words), np.iinfo(np.int64).max)
        np.minimum.at(least, item, having)
        kept = np.flatnonzero((having <= SHARED) | (having == least[item]))
        rarest = kept[having[kept] > SHARED]  # one for each item that has no other
        kept = np.union1d(kept[having[kept] <= SHARED], rarest[np.unique(item[rarest], return_index=True)[1]])
        kept = kept[np.argsort(hashes[kept], kind="stable")]
        self.item, self.at = item[kept], at[kept]
        self.keys, self.first, self.n = np.unique(hashes[kept], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.slot(self.keys)] = True

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.bits) - 1)).astype(np.int64)

    def met(self, numbers: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
        """Document, item and the place where the item would begin, once for STEP neighbouring places; in order of documents."""
        rolled = windows(numbers.astype(np.uint64) + np.uint64(1), GRAM)
        places = np.flatnonzero(self.bits[self.slot(rolled)])
        key = np.searchsorted(self.keys, rolled[places])
        same = key < len(self.keys)
        same[same] = self.keys[key[same]] == rolled[places[same]]
        places, key = places[same], key[same]
        doc = np.searchsorted(before, places, side="right") - 1
        inside = places + GRAM <= before[doc + 1]
        places, key, doc = places[inside], key[inside], doc[inside]
        n = self.n[key]
        entry = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, item, begin = np.repeat(doc, n), self.item[entry], np.repeat(places, n) - self.at[entry]
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] // STEP != begin[:-1] // STEP))[: len(doc)]
        return list(zip(doc[new].tolist(), item[new].tolist(), begin[new].tolist(), strict=True))


def retrieved(items: Items, idf: np.ndarray, projection: np.ndarray, cosine: float, overlap: float, answer: float):
    """For mapInArrow: confirmed pairs of documents and items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = items.size
        table = np.vstack([projection, np.zeros((1, projection.shape[1]))]).astype(np.float32)
        query, of = [], []
        for i, w in enumerate(items.words):
            if len(w) >= SHORT:
                for a in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2):
                    query.append(table[w[a : a + PASSAGE]].sum(axis=0))
                    of.append(i)
        of = np.array(of, np.int64)
        query = unit(np.array(query, np.float32).reshape(len(of), table.shape[1]))
        masks = [(bit_masks(w), bit_masks(a)) for w, a in zip(items.words, items.answers, strict=True)]
        short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(items.words):
            if len(w) < SHORT:
                short.setdefault(len(w), {}).setdefault(int(windows(w.astype(np.uint64) + np.uint64(1), len(w))[0]), []).append(i)
        sums, grams, present = Sums(idf), Grams(items.words), np.zeros(size + 1, bool)
        query_of = np.searchsorted(of, np.arange(len(items.words) + 1))
        farthest = max(map(len, items.words)) // 2 + STEP
        for batch, numbers, before in unpacked(batches, size):
            best: dict[tuple[int, int], tuple] = {}
            starts, owner = cuts(before, STEP)
            if len(starts) and len(of):
                each = sums.rows(sums.split(numbers, starts), table)
                rows = each.copy()
                for k in range(1, BLOCKS):
                    rows[:-k][owner[:-k] == owner[k:]] += each[k:][owner[:-k] == owner[k:]]
                near = np.round(unit(rows) @ query.T, 5)  # so that the number of items in a block shows nowhere
                high = near >= cosine
                apart = owner[1:] != owner[:-1]
                high[1:] &= (near[1:] >= near[:-1]) | apart[:, None]  # local maxima
                high[:-1] &= (near[:-1] >= near[1:]) | apart[:, None]
                last = -1
                for b, j in zip(*(x.tolist() for x in np.nonzero(high)), strict=True):
                    i, doc = int(of[j]), int(owner[b])
                    if b != last:
                        if last >= 0:
                            present[around] = False
                        around = numbers[max(before[doc], starts[b] - farthest) : min(before[doc + 1], starts[b] + PASSAGE + farthest)]
                        present[around] = True
                        last = b
                    item = items.words[i]
                    if np.count_nonzero(present[item]) < overlap * len(item):  # bounds the common subsequence
                        continue
                    reach = len(item) // 2 + STEP
                    low, end = max(before[doc], starts[b] - reach), min(before[doc + 1], starts[b] + PASSAGE + reach)
                    region = numbers[low:end].tolist()
                    share = common(region, masks[i][0], len(item)) / len(item)
                    if share < overlap or share <= best.get((doc, i), (0, 0))[1]:
                        continue
                    told = common(region, masks[i][1], len(items.answers[i])) / len(items.answers[i])
                    if told >= answer:
                        best[doc, i] = (float(near[b, j]), share, told, int(low - before[doc]), int(end - before[doc]))
                if last >= 0:
                    present[around] = False
                for doc, i, begin in grams.met(numbers, before):
                    item = items.words[i]
                    reach = len(item) // 2 + STEP
                    low, end = max(int(before[doc]), begin - reach), min(int(before[doc + 1]), begin + len(item) + reach)
                    around = numbers[low:end]
                    present[around] = True
                    enough = np.count_nonzero(present[item]) >= overlap * len(item)
                    present[around] = False
                    if not enough:
                        continue
                    region = around.tolist()
                    share = common(region, masks[i][0], len(item)) / len(item)
                    if share < overlap or share <= best.get((doc, i), (0, 0))[1]:
                        continue
                    told = common(region, masks[i][1], len(items.answers[i])) / len(items.answers[i])
                    if told >= answer:
                        blocks = slice(int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, end)))
                        best[doc, i] = (float(near[blocks, query_of[i] : query_of[i + 1]].max()), share, told, int(low - before[doc]), int(end - before[doc]))
            for length, wanted in short.items():
                rolled = windows(numbers.astype(np.uint64) + np.uint64(1), length)
                for at in np.flatnonzero(np.isin(rolled, np.array(list(wanted), np.uint64))).tolist():
                    doc = int(np.searchsorted(before, at, side="right") - 1)
                    if at + length <= before[doc + 1]:
                        for i in wanted[int(rolled[at])]:
                            best.setdefault((doc, i), (1.0, 1.0, 1.0, int(at - before[doc]), int(at - before[doc]) + length))
            keys = sorted(best)
            ids = batch.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64()))
            columns = list(zip(*(best[k] for k in keys), strict=True)) or [[]] * 5
            types = (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for _, i in keys], pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "end_word"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def contaminated(documents: DataFrame, benchmark: DataFrame, cosine: float = 0.5, overlap: float = 0.7, answer: float = 0.5, block: int = 20000) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer, first_word, end_word.

    cosine is that of the passage there, which may be below the threshold where a shared run of words led to the item.
    lcs and answer are the shares of the item and of its answer that the words from first_word to end_word have in order.
    Vocabulary, weights and SVD are one for the whole benchmark. Only the search takes its items in blocks of about
    ``block``, which bounds what a task holds and changes no row. Null and empty texts and items, and null item_ids, match
    nothing; null doc_ids are reported as such; repeated rows are reported each; further columns are ignored. Without
    documents or items the result is empty.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontamination")
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, end_word long"
    found = rows.select("text").mapInArrow(different_words, "word long").distinct().toPandas()  # a number for each word of the benchmark
    vocabulary = np.unique(found["word"].to_numpy(np.int64).view(np.uint64))
    if not len(vocabulary):
        return spark.createDataFrame([], schema)
    kind = "doc_id long, words binary"
    words = scratch.cut(documents.select("doc_id", "text").mapInArrow(numbered_words(vocabulary), kind))
    own = scratch.cut(rows.select(F.col("item_id").alias("doc_id"), "text").mapInArrow(numbered_words(vocabulary), kind))
    idf, projection = latent_space(words, own, len(vocabulary))
    blocks = max(1, -(-rows.count() // block))
    out = None
    for nth in range(blocks):
        items = Items(sorted(map(tuple, rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == nth).collect())), vocabulary)
        if items.words:
            near = words.mapInArrow(retrieved(items, idf, projection, cosine, overlap, answer), schema)
            out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], schema) if out is None else out


def latent_space(words: DataFrame, own: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each vocabulary word, and its row of the projection, from the words of documents and of items."""

    def counted(table: DataFrame) -> dict[int, int]:  # a row for each vocabulary word
        return dict(map(tuple, table.select("words").mapInArrow(frequencies(size), "word int, n long").groupBy("word").agg(F.sum("n")).collect()))

    counts = counted(words)
    passages, mine = counts.pop(-1, 0), counted(own).get(-1, 0)
    seen = np.zeros(size)
    seen[list(counts)] = list(counts.values())
    idf = np.log((passages + 1) / (seen + 1)) + 0.1
    omega = np.random.default_rng(99).normal(size=(size, RANK)).astype(np.float32)
    columns = [f"y{c}" for c in range(RANK)]

    def summed(table: DataFrame) -> np.ndarray:  # a row for each vocabulary word
        parts = table.select("words").mapInArrow(sketches(size, idf, omega), "word int, " + ", ".join(f"{c} long" for c in columns))
        rows = parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        y = np.zeros((size, RANK))
        y[rows["word"].to_numpy(np.int64)] = rows[columns].to_numpy(float) / SCALE
        return y

    y = summed(words) + max(1.0, passages / max(mine, 1)) * summed(own)
    return idf, idf[:, None] * singular_vectors(y, omega.astype(float))
