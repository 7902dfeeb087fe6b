"""Minimizers of many sequences at once, on the bytes of an Arrow column.

A base is one bit (purine or pyrimidine), a k-mer one unsigned word, and its hash that word XOR the salt.
K-mers are packed and window minima found by doubling: a few passes over the bytes whatever k and w are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strandlake.functions.encoding import PURINES, PYRIMIDINES
from strandlake.functions.flat import char_offsets, flat_bytes

#: Window starts handled at once, which bounds the memory of very long sequences.
CHUNK = 1 << 20
SIZES = (16, 32, 64)
FORWARD, REVERSE = 0, 1

_BIT = np.full(256, 2, np.uint8)
_BIT[[ord(c) for c in PYRIMIDINES]] = 0
_BIT[[ord(c) for c in PURINES]] = 1


@dataclass(frozen=True)
class SketchParams:
    """k in 16, 32, 64; w at least 1; a 64-bit salt, which isn't cut to k bits."""

    k: int = 64
    w: int = 50
    salt: int = 0x5555555555555555

    def __post_init__(self) -> None:
        if self.k not in SIZES:
            raise ValueError(f"k must be 16, 32, or 64; got {self.k}")
        if self.w < 1:
            raise ValueError("w must be at least 1")
        if not 0 <= self.salt < 2**64:
            raise ValueError("salt must have 64 bits")


@dataclass
class Picks:
    """The minimizers chosen, in order: row, byte position of the k-mer, hash; and whether the hash is a new one."""

    row: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    fresh: np.ndarray


def _pack(bits: np.ndarray, k: int, strand: int) -> np.ndarray:
    code, n = bits if strand == FORWARD else bits ^ np.uint64(1), 1
    while n < k:
        shift = np.uint64(n)
        code = (code[:-n] << shift) | code[n:] if strand == FORWARD else code[:-n] | (code[n:] << shift)
        n *= 2
    return code


def _rightmost_min(values: np.ndarray, width: int) -> np.ndarray:
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        shift = min(span, width - span)
        right = best[shift:] <= best[:-shift]
        at = np.where(right, at[shift:], at[:-shift])
        best = np.where(right, best[shift:], best[:-shift])
        span += shift
    return at


def picks(data: np.ndarray, starts: np.ndarray, p: SketchParams, strand: int) -> Iterator[Picks]:
    """Of every full window of w valid k-mers the rightmost least hash, once for each position it is chosen at."""
    span = p.k + p.w - 1
    for c in range(0, len(data), CHUNK):
        first = max(c - 1, 0)  # the window before tells whether the first one is new
        letters = _BIT[data[first : c + CHUNK + span - 1]]
        if len(letters) < span:
            return
        hashes = _pack((letters & 1).astype(np.uint64), p.k, strand) ^ np.uint64(p.salt)
        at = _rightmost_min(hashes, p.w)
        bad = np.concatenate([[0], np.cumsum(letters == 2)])
        place = np.arange(first, first + len(at))
        row = np.searchsorted(starts, place, "right") - 1
        valid = (bad[span : span + len(at)] == bad[: len(at)]) & (place + span <= starts[row + 1])
        value = hashes[at]
        new, fresh = valid.copy(), valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        fresh[1:] &= ~valid[:-1] | (value[1:] != value[:-1])
        if c:
            new[0] = False
        keep = np.flatnonzero(new)
        if len(keep):
            yield Picks(row[keep], first + at[keep], value[keep], fresh[keep])


def all_picks(column: pa.Array, p: SketchParams, strand: int) -> tuple[Picks, np.ndarray, np.ndarray]:
    data, starts = flat_bytes(column)
    found = list(picks(data, starts, p, strand))
    if not found:
        none = np.zeros(0, np.int64)
        return Picks(none, none, none.astype(np.uint64), none.astype(bool)), data, starts
    return Picks(*(np.concatenate([getattr(f, n) for f in found]) for n in ("row", "at", "hash", "fresh"))), data, starts


def ordered(column: pa.Array, p: SketchParams, strand: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes in order of the windows, consecutive equal hashes of a run once."""
    found, _, _ = all_picks(column, p, strand)
    return found.row[found.fresh], found.hash[found.fresh]


def positions(column: pa.Array, p: SketchParams, strand: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and start positions (in letters, of the k-mer on the given strand's text) in order."""
    found, data, starts = all_picks(column, p, strand)
    return found.row, found.hash, char_offsets(data, starts, found.row, found.at)


def distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), in rising unsigned order within the rows."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def sketch_sets(
    column: pa.Array, pair: pa.Array | None, p: SketchParams, strand: int
) -> tuple[np.ndarray, np.ndarray]:
    """The set of each row; a mate adds the sketch of its other strand."""
    row, hashes = ordered(column, p, strand)
    if pair is not None:
        row2, hashes2 = ordered(pair, p, 1 - strand)
        row, hashes = np.concatenate([row, row2]), np.concatenate([hashes, hashes2])
    return distinct(row, hashes)
