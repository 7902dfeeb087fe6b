"""Sizes of the overlaps between many large sets.

Heavy-light split by degree, the number of sets that hold an identifier: identifiers in few
sets are expanded into pairs of sets, those in many go through products of dense 0/1 matrices,
and the counts are added. Identifiers that belong to exactly the same sets count as one with
a weight, so neither side ever works per identifier, and no intersection is materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import cut, small, spread

#: Identifiers in at most so many sets are expanded into pairs.
LIGHT_DEGREE = 16
#: Columns of a matrix block and rows multiplied at once.
BLOCK, ROWS = 1024, 2048
#: Pair counts a task holds before it passes them on.
HELD = 2_000_000
#: Sets whose sizes are broadcast.
BROADCAST_SETS = 1_000_000

_OUT = "set_a int, set_b int, n long"


def signatures(df: DataFrame, set_id: str, member: str) -> DataFrame:
    """How many members belong to exactly the same sets: ``words``, ``bits``, ``n``.

    Sets are bits of 64-bit words (``set_id`` shifted right by 6 names the word), so that
    repeated rows vanish in a map-side ``bit_or`` before anything is shuffled and a hot member
    is never more than a few words per task.
    """
    words = (
        df.select(F.col(member).alias("m"), F.col(set_id).cast("int").alias("s"))
        .where(F.col("m").isNotNull() & F.col("s").isNotNull())
        .groupBy("m", F.shiftright("s", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, s & 63))").alias("bits"))
    )
    return (
        words.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("sig"))
        .groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("sig.word").alias("words"), F.col("sig.bits").alias("bits"), "n")
    )


class _Counts:
    """Sums by (a, b) in bounded memory."""

    def __init__(self) -> None:
        self.keys, self.sums, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        self.keys.append(key)
        self.sums.append(n.astype(np.int64))
        self.held += len(key)

    def merge(self) -> int:
        if len(self.keys) > 1:
            key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(self.sums))
            self.keys, self.sums, self.held = [key], [total], len(key)
        return self.held

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The counts, once there are too many of them even when added up."""
        if self.held > HELD and self.merge() > HELD // 2:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        key = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        n = np.concatenate(self.sums) if self.sums else np.zeros(0, np.int64)
        self.keys, self.sums, self.held = [], [], 0
        columns = [(key >> 32).astype(np.int32), key.astype(np.uint32).view(np.int32), n]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["set_a", "set_b", "n"])


def _expand(sets: np.ndarray, start: np.ndarray, degree: np.ndarray, n: np.ndarray, out: _Counts) -> Iterator[pa.RecordBatch]:
    """Every pair (a <= b) of the sets of each row, rows of equal degree together."""
    for d in np.unique(degree):
        i, j = np.triu_indices(d)
        every = np.flatnonzero(degree == d)
        step = max(1, HELD // len(i))
        for r in range(0, len(every), step):
            rows = every[r : r + step]
            members = sets[start[rows][:, None] + np.arange(d)]
            out.add(members[:, i].ravel(), members[:, j].ravel(), np.repeat(n[rows], len(i)))
            yield from out.flush()


def _multiply(sets: np.ndarray, start: np.ndarray, degree: np.ndarray, n: np.ndarray, out: _Counts) -> Iterator[pa.RecordBatch]:
    """The same counts as weighted products of dense blocks, of which two are held at a time."""
    for r in range(0, len(start), ROWS):
        deg, weight = degree[r : r + ROWS], n[r : r + ROWS].astype(np.float64)
        row = np.repeat(np.arange(len(deg)), deg)
        at = np.repeat(start[r : r + ROWS] - np.concatenate([[0], np.cumsum(deg)[:-1]]), deg) + np.arange(deg.sum())
        names, col = np.unique(sets[at], return_inverse=True)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]

        def block(c: int, row=row, col=col, names=names, size=len(deg)) -> np.ndarray:
            x = np.zeros((size, min(BLOCK, len(names) - c)))
            own = slice(*np.searchsorted(col, [c, c + BLOCK]))
            x[row[own], col[own] - c] = 1
            return x

        for c in range(0, len(names), BLOCK):
            x = block(c)
            scaled = (x * weight[:, None]).T
            for e in range(c, len(names), BLOCK):
                product = scaled @ (x if c == e else block(e))
                i, j = np.nonzero(np.triu(product) if c == e else product)
                out.add(names[c + i], names[e + j], np.rint(product[i, j]))
                yield from out.flush()


def _count_pairs(light_degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Counts()
        for batch in batches:
            if not batch.num_rows:
                continue
            words, bits = batch.column("words"), batch.column("bits")
            n = batch.column("n").to_numpy(zero_copy_only=False)
            word = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bit = bits.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            length = words.value_lengths().to_numpy(zero_copy_only=False)
            at, which = np.nonzero(np.unpackbits(bit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            sets = word[at] * 64 + which
            degree = np.bincount(np.repeat(np.arange(len(n)), length)[at], minlength=len(n))
            start = np.concatenate([[0], np.cumsum(degree)[:-1]])
            light = degree <= light_degree
            yield from _expand(sets, start[light], degree[light], n[light], out)
            yield from _multiply(sets, start[~light], degree[~light], n[~light], out)
        out.merge()
        yield out.batch()

    return run


def overlap_sizes(
    df: DataFrame, set_id: str, member: str, light_degree: int = LIGHT_DEGREE, min_share: float = 0.0
) -> DataFrame:
    """Exact overlap of every two sets that share a member.

    ``set_id`` is an INT, ``member`` of any type that can be grouped. Output, one row per pair:
    ``set_a`` < ``set_b`` INT, ``n_both``, ``n_a``, ``n_b`` LONG, of the pairs whose overlap is at least ``min_share`` of the
    smaller set. Rows with a null set or member
    are left out, repeated rows count once, pairs that share nothing are not listed, other columns
    are ignored, and an empty table gives no rows.
    """
    # The distinct memberships are few and costly: written, they are dealt to all cores rather than merged by their bytes.
    pairs = cut(
        spread(cut(signatures(df, set_id, member)))
        .mapInArrow(_count_pairs(light_degree), _OUT)
        .groupBy("set_a", "set_b")
        .agg(F.sum("n").alias("n_both"))
    )
    # A set's size stands on the diagonal, as its overlap with itself. The sizes are broadcast if the sets are few.
    sizes = small(pairs.where("set_a = set_b").select(F.col("set_a").alias("s"), F.col("n_both").alias("size")), BROADCAST_SETS)
    found = pairs.where("set_a < set_b")
    for side in ("a", "b"):
        own = sizes.select(F.col("s").alias(f"set_{side}"), F.col("size").alias(f"n_{side}"))
        found = found.join(own, f"set_{side}")
    return found.where(F.col("n_both") >= F.lit(min_share) * F.least("n_a", "n_b")).select("set_a", "set_b", "n_both", "n_a", "n_b")
