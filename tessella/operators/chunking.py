"""Content-defined chunking: the one table function that needs custom code.

``compat`` cuts where the rolling hash of the documented algorithm does; its outgoing byte leaves traces, so boundaries do
not come back after an edit. ``resync`` is a cyclic polynomial that depends on the last 48 bytes only, so they do.
``fixed`` cuts every ``max_size`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNK
from .series import running_offset

M64 = (1 << 64) - 1
WINDOW = 48


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes in bytes. avg_size is only validated; mask_bits set the mean size."""

    min_size: int = 256 << 10
    avg_size: int = 1 << 20
    max_size: int = 4 << 20
    mask_bits: int = 20
    mode: str = "compat"

    def __post_init__(self) -> None:
        if not 256 <= self.min_size < self.avg_size < self.max_size <= 16 << 20:
            raise ValueError("sizes must rise from min (256 bytes at least) over avg to max (16 MiB at most)")
        if not 1 <= self.mask_bits <= 32:
            raise ValueError("mask_bits must be 1 to 32")
        if self.mode not in ("compat", "resync", "fixed"):
            raise ValueError("mode must be compat, resync or fixed")


SMALL = ChunkerConfig(512, 2048, 8192, 11)


def gear_table() -> list[int]:
    """256 values from a 64-bit shift register."""
    state, out = 0x45AABBCCDDEEFF00, []
    for i in range(256):
        state ^= state << 13 & M64
        state ^= state >> 7
        state ^= state << 17 & M64
        out.append((state + i * 0x517CC1B727220A95) & M64)
    return out


GEAR = gear_table()


def _turned(x: int, by: int) -> int:
    by %= 64
    return (x << by | x >> (64 - by)) & M64


# What a byte adds is turned once a step; after WINDOW steps it is taken out in this form.
OUT = [_turned(g, WINDOW) for g in GEAR]


def boundaries(data: bytes, config: ChunkerConfig) -> list[int]:
    """Ends of the chunks of data, in order; none for no bytes. Only bytes past min_size of a chunk are looked at."""
    out, at, size, mask = [], 0, len(data), (1 << config.mask_bits) - 1
    while at < size:
        begin = at + (config.max_size if config.mode == "fixed" else config.min_size)
        if begin >= size:
            out.append(size)
            break
        if config.mode == "fixed":
            at = begin
            out.append(at)
            continue
        end = min(at + config.max_size, size)
        at = end
        if begin + WINDOW <= end:
            h = 0
            if config.mode == "compat":
                for b in data[begin : begin + WINDOW]:
                    h = ((h << 1 | h >> 63) + GEAR[b]) & M64
                for old, new, place in zip(data[begin : end - WINDOW], data[begin + WINDOW : end], range(begin + WINDOW, end), strict=True):
                    h = (h - OUT[old]) & M64
                    h = ((h << 1 | h >> 63) + GEAR[new]) & M64
                    if not h & mask:
                        at = place + 1
                        break
            else:
                for b in data[begin : begin + WINDOW]:
                    h = (h << 1 & M64 | h >> 63) ^ GEAR[b]
                for old, new, place in zip(data[begin : end - WINDOW], data[begin + WINDOW : end], range(begin + WINDOW, end), strict=True):
                    h = (h << 1 & M64 | h >> 63) ^ OUT[old] ^ GEAR[new]
                    if not h & mask:
                        at = place + 1
                        break
        out.append(at)
    return out


GEARS, OUTS = np.array(GEAR, np.uint64), np.array(OUT, np.uint64)
LANES = 16


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def cyclic_hashes(data: np.ndarray) -> np.ndarray:
    """For each run of WINDOW bytes, by its start: the hash of ``resync``. Runs are doubled in length until they fit."""
    h = {1: GEARS[data]}
    for n in (1, 2, 4, 8, 16):
        h[2 * n] = _rotated(h[n][:-n], n) ^ h[n][n:]
    last = len(data) - WINDOW + 1
    return _rotated(h[32][:last], 16) ^ h[16][32 : 32 + last]


def resync_boundaries(data: bytes, config: ChunkerConfig) -> list[int]:
    """boundaries() of ``resync``: all hashes at once, then one look-up for each chunk."""
    size = len(data)
    found = np.zeros(0, np.int64)
    if size > config.min_size + WINDOW:
        whole = np.frombuffer(data, np.uint8)
        parts = []
        for a in range(0, size - WINDOW + 1, 1 << 20):
            h = cyclic_hashes(whole[a : a + (1 << 20) + WINDOW - 1])
            parts.append(np.flatnonzero(h & np.uint64((1 << config.mask_bits) - 1) == 0) + a + WINDOW)
        found = np.concatenate(parts)  # where a chunk may end
    out, at = [], 0
    while at < size:
        end = min(at + config.max_size, size)
        if at + config.min_size < size:
            k = int(np.searchsorted(found, at + config.min_size + WINDOW + 1))
            if k < len(found) and found[k] < end:
                end = int(found[k])
        else:
            end = size
        out.append(end)
        at = end
    return out


def compat_boundaries(files: list[bytes], config: ChunkerConfig) -> list[list[int]]:
    """boundaries() of ``compat`` for many files: its hash is a true recurrence, so each file is a lane of numpy arrays and
    all lanes take a byte at a time. The last few lanes go on one by one."""
    sizes = np.array([len(f) for f in files], np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(files), np.uint8)
    mask = np.uint64((1 << config.mask_bits) - 1)
    out: list[list[int]] = [[] for _ in files]
    at = np.zeros(len(files), np.int64)  # where each file's chunk begins
    lane = np.flatnonzero(sizes > 0)
    for i in lane[sizes[lane] <= config.min_size].tolist():
        out[i].append(int(sizes[i]))
    lane = lane[sizes[lane] > config.min_size]
    place, h = np.full(len(lane), config.min_size), np.zeros(len(lane), np.uint64)
    one, rest = np.uint64(1), np.uint64(63)
    while len(lane) >= LANES:
        begin = at[lane] + config.min_size
        end = np.minimum(at[lane] + config.max_size, sizes[lane])
        over = place >= end  # also a rest too short for a window: it is one chunk
        where = base[lane] + np.minimum(place, end - 1)
        filled = place - begin >= WINDOW
        h = np.where(filled, h - OUTS[data[where - np.where(filled, WINDOW, 0)]], h)
        h = (h << one | h >> rest) + GEARS[data[where]]
        cut = over | (filled & (h & mask == 0))
        place = place + 1
        if cut.any():
            ends = np.where(over, end, place)[cut]
            for i, e in zip(lane[cut].tolist(), ends.tolist(), strict=True):
                out[i].append(e)
            at[lane[cut]] = ends
            place[cut], h[cut] = ends + config.min_size, 0
            short = cut & (place >= sizes[lane])
            for i in lane[short & (at[lane] < sizes[lane])].tolist():
                out[i].append(int(sizes[i]))
            lane, place, h = lane[~short], place[~short], h[~short]
    for i in lane.tolist():
        out[i] += [int(at[i]) + e for e in boundaries(files[i][int(at[i]) :], config)]
    return out


def all_boundaries(files: list[bytes], config: ChunkerConfig) -> list[list[int]]:
    """boundaries() of each file."""
    if config.mode == "compat" and len(files) >= LANES:
        return compat_boundaries(files, config)
    one = resync_boundaries if config.mode == "resync" else boundaries
    return [one(f, config) for f in files]


def chunks(files: DataFrame, config: ChunkerConfig = ChunkerConfig(), path: str = "path", data: str = "data") -> DataFrame:  # noqa: B008
    """A row for each chunk of each file: path, seq, offset, length, hash. Null and empty data has no chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), [c or b"" for c in batch.column(1).to_pylist()]
            rows = []
            for name, content, ends in zip(names, contents, all_boundaries(contents, config), strict=True):
                at = 0
                for seq, end in enumerate(ends):
                    rows.append((name, seq, at, end - at, hashlib.sha256(content[at:end]).hexdigest()))
                    at = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=CHUNK.names)

    return files.select(F.col(path), F.col(data).cast("binary")).mapInArrow(run, CHUNK)


def fixed_slices(files: DataFrame, size: int = 512, path: str = "path", text: str = "text") -> DataFrame:
    """Slices of ``size`` characters, in built-in functions: path, seq, offset, length, hash (offset and length in bytes)."""
    out = files.where(F.length(text) > 0).select(F.col(path).alias("path"), F.posexplode(slice_texts(F.col(text), size)).alias("seq", "piece"))
    out = out.select("path", "seq", F.octet_length("piece").cast("long").alias("length"), F.sha2(F.col("piece").cast("binary"), 256).alias("hash"))
    return out.withColumn("offset", running_offset("path", "seq", "length")).select(*CHUNK.names)


def slice_texts(text, size: int = 512):
    """The slices of a text as an array; none of an empty text."""
    last = F.call_function("div", F.length(text) - 1, F.lit(size))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


def slice_hashes(text, size: int = 512):
    return F.transform(slice_texts(text, size), lambda p: F.sha2(p.cast("binary"), 256))
