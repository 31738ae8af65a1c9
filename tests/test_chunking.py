"""Properties of the chunker, its stored boundaries, and a plain restatement of its rolling hash."""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.chunking import GEAR, SMALL, ChunkerConfig, boundaries, chunks


def pseudo_random(n, seed=1):
    return random.Random(seed).randbytes(n)


def slow_boundaries(data, c):
    """The documented algorithm, step by step."""
    m64, out, o = (1 << 64) - 1, [], 0
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & m64
    while o < len(data):
        end = o + min(c.min_size, len(data) - o)
        cut = len(data)
        if end < len(data):
            most = min(o + c.max_size, len(data))
            cut = most
            if end < most and end + 48 <= most:
                h = 0
                for b in data[end : end + 48]:
                    h = (turn(h, 1) + GEAR[b]) & m64
                for pos in range(end + 48, most):
                    h = (h - turn(GEAR[data[pos - 48]], 48)) & m64
                    h = (turn(h, 1) + GEAR[data[pos]]) & m64
                    if h & ((1 << c.mask_bits) - 1) == 0:
                        cut = pos + 1
                        break
        out.append(cut)
        o = cut
    return out


def test_gear_table_starts_as_documented():
    assert [hex(g)[2:] for g in GEAR[:3]] == ["1e95462425f6e2fe", "c67fbb62544e7b50", "6f08133ac18d7bc4"]


@pytest.mark.parametrize("size", [0, 1, 256, 511, 512, 513, 560, 8192, 30000])
def test_equals_slow_form(size):
    data = pseudo_random(size, size)
    assert boundaries(data, SMALL) == slow_boundaries(data, SMALL)


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=20000), st.sampled_from(["compat", "resync", "fixed"]))
def test_bounds_cover_the_data(data, mode):
    config = replace(SMALL, mode=mode)
    ends = boundaries(data, config)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and ends == boundaries(data, config)
    assert all(0 < s <= config.max_size for s in sizes) and all(s >= config.min_size for s in sizes[:-1])


def test_mean_size_is_near_the_mask():
    sizes = len(boundaries(pseudo_random(200_000), SMALL))
    assert 0.3 < (200_000 / sizes) / (SMALL.min_size + 2**SMALL.mask_bits) < 3


def pieces(data, config):
    ends = boundaries(data, config)
    return {data[a:b] for a, b in zip([0, *ends], ends)}


def test_only_resync_finds_its_boundaries_again():
    data = pseudo_random(200_000)
    edited = data[:50_000] + b"!" + data[50_000:]
    shared = {}
    for mode in ("compat", "resync"):
        config = replace(SMALL, mode=mode)
        shared[mode] = len(pieces(data, config) & pieces(edited, config)) / len(pieces(data, config))
    assert shared["resync"] > 0.9 > 0.5 > shared["compat"]


@pytest.mark.parametrize("wrong", [{"min_size": 100}, {"avg_size": 512}, {"max_size": 1024}, {"max_size": 1 << 25}, {"mask_bits": 0}, {"mask_bits": 33}, {"mode": "other"}])
def test_config_is_checked(wrong):
    with pytest.raises(ValueError):
        replace(SMALL, **wrong)
    assert ChunkerConfig().max_size == 4 << 20


def test_table_function(spark):
    data = bytearray(pseudo_random(20_000) * 2)
    rows = chunks(spark.createDataFrame([("a", data), ("b", None), ("c", bytearray())], "path string, data binary"), SMALL).orderBy("seq").collect()
    assert {r.path for r in rows} == {"a"} and sum(r.length for r in rows) == 40_000
    assert [r.offset for r in rows] == [0, *[r.offset + r.length for r in rows][:-1]]
