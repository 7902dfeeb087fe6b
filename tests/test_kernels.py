"""The minimizer kernel against a plain one."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions import kernels as k
from strandlake.functions.flat import char_offsets, flat_bytes

BITS = {**dict.fromkeys("AaGg", 1), **dict.fromkeys("TtCc", 0)}


def plain(text, p, strand):
    """(positions with hashes, hashes without equal neighbours) by the definition."""
    hashes = []
    for i in range(len(text) - p.k + 1):
        bits = [BITS.get(c) for c in text[i : i + p.k]]
        if None in bits:
            hashes.append(None)
            continue
        if strand:
            bits = [1 - b for b in reversed(bits)]
        hashes.append(int("".join(map(str, bits)), 2) ^ p.salt)
    at, values, last_at, last = [], [], None, None
    for s in range(len(hashes) - p.w + 1):
        window = hashes[s : s + p.w]
        if None in window:
            last_at = last = None
            continue
        least = min(window)
        place = s + max(i for i, h in enumerate(window) if h == least)
        if place != last_at:
            at.append((place, least))
        if least != last:
            values.append(least)
        last_at, last = place, least
    return at, values


def check(texts, p):
    column = pa.array(texts, pa.string())
    for strand in (0, 1):
        row, hashes, at = k.positions(column, p, strand)
        row2, values = k.ordered(column, p, strand)
        row3, members = k.sketch_sets(column, None, p, strand)
        for i, text in enumerate(texts):
            places, ordered = plain(text or "", p, strand)
            assert list(zip(at[row == i].tolist(), hashes[row == i].tolist(), strict=True)) == places
            assert values[row2 == i].tolist() == ordered
            assert members[row3 == i].tolist() == sorted(set(ordered))


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text(alphabet="ACGTacgtNUé", max_size=120)), max_size=5),
    st.sampled_from([16, 32, 64]),
    st.integers(1, 12),
    st.sampled_from([0, 0x5555555555555555, 0xF00000000000ABCD]),
)
def test_any_text(texts, size, w, salt):
    check(texts, k.SketchParams(size, w, salt))


@pytest.mark.parametrize("chunk", [1, 37, 1000])
def test_chunks(monkeypatch, chunk):
    monkeypatch.setattr(k, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("ACGTN", [25, 25, 25, 25, 1], k=n)) for n in (0, 15, 22, 23, 24, 300, 500)]
    check([*texts, "A" * 200, "AT" * 90, "N" * 50, None, "acgt" * 40], k.SketchParams(16, 8))


def test_lengths():
    p = k.SketchParams(32, 10)
    sizes = [len(k.ordered(pa.array(["ACGTTGCA" * 6][:1] and [("ACGTTGCAAC" * 6)[:n]]), p, 0)[0]) for n in (31, 40, 41)]
    assert sizes[:2] == [0, 0] and sizes[2] == 1


def test_mates_add_the_other_strand():
    p = k.SketchParams(16, 5)
    rng = random.Random(3)
    one, two = ("".join(rng.choices("ACGT", k=90)) for _ in range(2))
    both = k.sketch_sets(pa.array([one]), pa.array([two]), p, 0)[1]
    parts = k.sketch_sets(pa.array([one]), None, p, 0)[1], k.sketch_sets(pa.array([two]), None, p, 1)[1]
    assert both.tolist() == np.union1d(*parts).tolist()
    assert k.sketch_sets(pa.array([one]), pa.array([None], pa.string()), p, 0)[1].tolist() == parts[0].tolist()


@pytest.mark.parametrize("bad", [{"k": 8}, {"w": 0}, {"salt": 2**64}, {"salt": -1}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        k.SketchParams(**bad)


def test_flat_bytes():
    column = pa.array(["ab", None, "é", ""]).slice(1)
    data, starts = flat_bytes(column)
    assert bytes(data) == "é".encode() and starts.tolist() == [0, 0, 2, 2]
    data, starts = flat_bytes(pa.array(["xéy", "é!"], pa.large_string()))
    assert char_offsets(data, starts, np.array([0, 1]), np.array([3, 6])).tolist() == [2, 1]
