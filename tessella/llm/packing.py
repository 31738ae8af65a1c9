"""Packing of tokenised documents into sequences by best-two-fit.

Only the lengths of the pieces decide a packing, and there are at most ``capacity`` different ones. So the driver plans
on the count of each length: it fills a sequence greedily (the longest length that is left and fits, again and again),
then replaces its smallest piece by the two unpacked lengths that fit the widened gap most tightly, if they fill more,
and uses the pattern found as often as the counts allow. Every pattern uses up a length or nearly so, and the plan stays
a few thousand rows for any number of documents. Pieces find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import slices

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
BLOCK, KNOWN, KNOWN_SIGNS = 1 << 21, 1 << 18, 1 << 22
ID = np.dtype("<u4")
BEFORE_SPACE = re.compile(r"\S(?=\s)")
LETTER, DIGIT, SPACE, OTHER = range(4)
CONTRACTED = {b"s": 1, b"t": 1, b"m": 1, b"d": 1, b"re": 2, b"ve": 2, b"ll": 2}  # letters that an apostrophe takes along
_encoders: dict[str, Encoder] = {}


def sign_classes() -> np.ndarray:
    """The class of each code point below 256."""
    signs = [chr(i) for i in range(256)]
    tests = [(LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\p{White_Space}")]
    return np.array([next((k for k, t in tests if regex.fullmatch(t, c)), OTHER) for c in signs], np.uint8)


CLASSES = sign_classes()
#: Byte-level models see each byte as a visible sign: itself where it is one, else the next free one from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


def pre_token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level tokenizers begin, in UTF-8 texts of code points below 256 that begin at ``at``.

    A run of letters, of digits or of other signs is one, with the blank before it; of white space before a sign, the last
    sign stands alone or is that blank; an apostrophe alone takes an English ending along.
    """
    n = len(data)
    kind = CLASSES[data]
    lead = np.flatnonzero(data >= 0xC2)  # of two bytes
    kind[lead] = kind[lead + 1] = CLASSES[(data[lead].astype(np.int64) & 3) << 6 | data[lead + 1] & 0x3F]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start |= edge
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    blank = (kind[begin] == SPACE) & ~edge[end]
    begin, end = begin[blank], end[blank]
    last = end - np.where(data[end - 1] >= 0x80, 2, 1)
    start[last] = True
    joined = data[last] == 0x20
    start[end[joined]] = False
    alone = np.flatnonzero(data[: n - 1] == 0x27)
    alone = alone[start[alone] & (kind[alone + 1] == LETTER) & ~edge[alone + 1]]
    text = data.tobytes()
    limits = np.append(at, n)
    for i, to in zip(alone.tolist(), limits[np.searchsorted(limits, alone, side="right")].tolist(), strict=True):
        taken = CONTRACTED.get(text[i + 1 : i + 2]) or (CONTRACTED.get(text[i + 1 : i + 3]) if i + 3 <= to else None)
        if taken:
            start[i + 1] = False
            start[i + 1 + taken] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts by ``tokenizers``, each different pre-token being encoded once.

    Texts are cut into pre-tokens, with numpy where all code points are below 256, by the pattern of the tokenizers' package
    otherwise, and the library's model encodes those it has not met yet. Up to ``KNOWN`` of them with up to
    ``KNOWN_SIGNS`` bytes are remembered, those met most recently longest. Added strings of the file (special ones) become
    their ids, as in the library's own ``encode``. Long texts are taken in blocks that end before a white-space sign after
    another sign: no pre-token crosses such a place. So memory follows the block.
    """

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[bytes, bytes] = {}  # ids as their 4 bytes each
        self.older: dict[bytes, bytes] = {}
        self.signs = 0

    def learn(self, new: set[bytes]) -> None:
        """Make these pre-tokens known."""
        found = {p: self.older[p] for p in new if p in self.older}
        rest = new.difference(found)
        for p in rest:
            made = self.tokenize(p.decode("latin-1").translate(BYTE_SIGNS))
            found[p] = array("I", [t.id for t in made]).tobytes()
        self.known |= found
        self.signs += sum(map(len, found))

    def forget(self) -> None:
        if len(self.known) > KNOWN or self.signs > KNOWN_SIGNS:
            self.older, self.known, self.signs = ({} if self.signs > KNOWN_SIGNS else self.known), {}, 0

    def ids(self, pre_tokens: list[bytes]) -> list[bytes]:
        new = set(pre_tokens).difference(self.known)
        if new:
            self.learn(new)
        return [self.known[p] for p in pre_tokens]

    def blocks(self, text: str) -> Iterator[str | int]:
        """A text's blocks, and the ids of added strings between them."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                yield self.added[part]
                continue
            at = 0
            while at < len(part):
                end = BEFORE_SPACE.search(part, at + BLOCK) if len(part) - at > BLOCK else None
                to = end.end() if end else len(part)
                yield part[at:to]
                at = to

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of some texts of code points below 256."""
        at = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [np.zeros(0, ID) for _ in texts]
        starts = pre_token_starts(data, at)
        offsets = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, own = np.asarray(coded.indices), self.ids(coded.dictionary.to_pylist())
        self.forget()
        sizes = np.array(list(map(len, own)), np.int64) // ID.itemsize
        flat, first = np.frombuffer(b"".join(own), ID), np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        out = flat[np.repeat(first[which] - (ends - counts), counts) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[np.searchsorted(starts, at)].tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, k, _), ids in zip(waiting, self.together([b for *_, b in waiting]), strict=True):
                out[i][k] = ids
            waiting.clear()

        for i, text in enumerate(texts):
            for block in self.blocks(text):
                if isinstance(block, int):
                    out[i].append(np.array([block], ID))
                elif block.isascii() or max(block) < "\u0100":
                    waiting.append((i, len(out[i]), block.encode()))
                    out[i].append(np.zeros(0, ID))
                    size += len(block)
                else:
                    out[i].append(np.frombuffer(b"".join(self.ids([p.encode() for p in self.pattern.findall(block)])), ID))
                    self.forget()
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, ID) for x in out]


def encoder(path: str) -> Encoder:
    """The encoder of the byte-level BPE file at path, one for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(path: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """For mapInArrow: the pieces of each document, with the rank of each among its task's pieces of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", most=1 << 21):
            out: list[tuple] = []
            texts = encode.many([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(own, np.array([end_id], ID))
                to = len(ids) % capacity or min(capacity, len(ids))
                at = piece = 0
                while at < len(ids):
                    out.append((doc_id, piece, at, to - at, zlib.crc32(ids[at:to].tobytes()), part, int(ranks[to - at])))
                    ranks[to - at] += 1
                    at, to, piece = to, to + capacity, piece + 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return run


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces of it in each}) for pieces of the given lengths; all are packed."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        free, rest, chosen = capacity, left.copy(), []
        while free and len(fits := np.flatnonzero(rest[1 : free + 1])):
            length = int(fits[-1]) + 1
            chosen.append(length)
            rest[length] -= 1
            free -= length
        if free and len(chosen) > 1:
            small = chosen[-1]
            gap = free + small
            lengths = np.flatnonzero(rest[1 : gap + 1]) + 1
            best = (small, None)
            for x in lengths[::-1]:
                if 2 * x < best[0]:
                    break
                others = lengths[lengths <= min(x, gap - x)]
                if len(others) and others[-1] == x and rest[x] < 2:
                    others = others[:-1]
                if len(others) and x + others[-1] > best[0]:
                    best = (int(x + others[-1]), (int(x), int(others[-1])))
            if best[1]:
                chosen[-1:] = best[1]
        pattern = Counter(chosen)
        times = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * times
        plan.append((times, dict(pattern)))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, first sequence, pieces in a sequence, first offset), by rank."""
    used, out, sequence = Counter(), {}, 0
    for times, pattern in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            out.setdefault(length, []).append((used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def placed(where: dict[int, np.ndarray]):
    """For mapInArrow: sequence_id and offset of each piece, by its length and rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                rows = where[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
                nth = ranks[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + nth // row[:, 2]
                offset[mine] = row[:, 3] + nth % row[:, 2] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text by the tokenizer file at ``path`` plus ``end_id``; a null or empty text is that id
    alone. Documents longer than ``capacity`` are cut into pieces of that length, the first may be shorter. Repeated rows
    and null doc_ids are packed as rows of their own; further columns are ignored; an empty table gives no pieces.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.cut(documents.select("doc_id", "text").mapInArrow(token_pieces(path, capacity, end_id), PIECES))
    sizes = scratch.cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length at most
    where = places(best_two_fit(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.cut(sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"))
    scratch.keep(pieces, offsets)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
