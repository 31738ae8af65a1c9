"""Words of many texts at once, as numpy arrays over Arrow's buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. ``Words`` holds the words of some texts joined
by one space each, so that any run of words of a text is a slice of bytes. Equality is decided on such bytes, on exact
numbers given to equal words of a slice, or on cryptographic digests. The 64-bit values of words and of runs of words only
choose candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
BLOCK = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, at least; up to a block's number of entries is kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def slices(batches: Iterable[pa.RecordBatch], *columns: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice have ``most`` bytes at most, or are of one row."""
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for column in columns:
            texts = batch.column(batch.schema.get_field_index(column))
            sizes += np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        sizes = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of True that crosses no bound, and the number of runs before each bound."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def next_space(data: np.ndarray, at: int) -> int:
    """The first place of white space from ``at`` on, or the end."""
    while at < len(data):
        found = np.flatnonzero(SPACE[data[at : at + (1 << 16)]])
        if len(found):
            return at + int(found[0])
        at += 1 << 16
    return len(data)


def blocks(data: np.ndarray, overlap: int = 0, most: int = BLOCK) -> Iterator[tuple[np.ndarray, int]]:
    """Stretches of about ``most`` bytes of one text, and how many of their last words belong to the next stretch too.

    Each is followed by the ``overlap`` words after it (fewer at the end of the text), so every run of overlap + 1 words is
    in exactly one stretch. Only a single word longer than ``most`` makes a longer stretch.
    """
    at = 0
    while True:
        cut = next_space(data, at + most) if len(data) - at > most else len(data)
        if cut == len(data):
            yield data[at:], 0
            return
        look, n, end = 1 << 14, 0, cut
        while overlap:
            tail = data[cut : cut + look]
            _, ends, _ = runs(~SPACE[tail], np.array([0, len(tail)]))
            whole = ends if cut + look >= len(data) else ends[ends < len(tail)]
            if len(whole) >= overlap or cut + look >= len(data):
                n = min(overlap, len(whole))
                end = cut + int(whole[n - 1]) if n else cut
                break
            look *= 4
        yield data[at:end], n
        at = cut


class Words:
    """The words of some texts: joined bytes, start and end of each word there, number of words before each text.

    One entry more than texts ends ``before``. Long texts are read in blocks, so little more than the result is held.
    """

    def __init__(self, texts: pa.Array | np.ndarray, lower: bool = False):
        data, at = raw(texts) if isinstance(texts, pa.Array) else (texts, np.array([0, len(texts)]))
        made, starts, ends, before, done, base = [], [], [], [np.zeros(1, np.int64)], 0, 0
        stretches = [(data, at)] if len(data) <= 2 * BLOCK or len(at) > 2 else [(b, np.array([0, len(b)])) for b, _ in blocks(data)]
        count = 0
        for part, bounds in stretches:
            inside = ~SPACE[part]
            a, b, n = runs(inside, bounds)
            sizes = b - a
            b = np.cumsum(sizes + 1) - 1
            out = np.full(int(b[-1]) + 1 if len(b) else 0, 0x20, np.uint8)
            keep = np.ones(len(out), bool)
            keep[b] = False
            out[keep] = (LOWER[part] if lower else part)[inside]
            made.append(out)
            starts.append((b - sizes + base).astype(np.int32 if len(data) < 2**31 - 1 else np.int64))
            ends.append((b + base).astype(starts[-1].dtype))
            before.append(n[1:] + count)
            base, count = base + len(out), count + len(a)
        self.data = made[0] if len(made) == 1 else np.concatenate(made)
        self.starts = starts[0] if len(made) == 1 else np.concatenate(starts)
        self.ends = ends[0] if len(made) == 1 else np.concatenate(ends)
        self.before = np.concatenate(before) if len(made) == 1 else np.array([0, count])
        self.view = memoryview(self.data)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))

    def run(self, first: int, last: int) -> memoryview:
        """The bytes of the words from first to last - 1, joined by one space."""
        return self.view[self.starts[first] : self.ends[last - 1]] if last > first else self.view[:0]

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words only, and the different words by number (with a space each)."""
        offsets = np.append(self.starts, len(self.data)).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        coded = array.dictionary_encode()
        return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def values(different: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of the words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, different.to_pylist())), np.uint64)


def shingle_keys(numbers: np.ndarray, kinds: int, size: int) -> np.ndarray:
    """For each run of ``size`` entries, by its start: a number that is equal for equal runs only."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys, spread = numbers, max(kinds, 1)
    for k in range(1, size):
        if spread * max(kinds, 1) >= 2**63:
            _, keys = np.unique(keys, return_inverse=True)
            spread = int(keys.max()) + 1
        keys, spread = keys[: len(numbers) - k] * kinds + numbers[k:], spread * max(kinds, 1)
    return keys[:n]


def spans(entries: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of entries[start:end] for each span, equal for equal sequences."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(entries)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(entries * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def windows(entries: np.ndarray, size: int) -> np.ndarray:
    """spans() of each run of ``size`` consecutive entries, by the entry that it starts at."""
    n = len(entries) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return spans(entries, starts, starts + size)
