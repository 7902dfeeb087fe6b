"""Long stretches of letters that stand verbatim in more than one record.

Level-wise doubling. Windows of 32 letters that occur in one record only can't be part of a longer
shared window, so only those in at least two are extended to 64; of these only the repeated ones are
extended to 128, and so on until none is left. On the first level one window of 32 stands for
each run of longer windows around it: the one with the least hash among all the 32-letter windows that
the longer window holds. Equal windows choose equal representatives, so nothing is lost.

Windows up to 64 letters are compared as their letters, two bits each; longer ones as 128-bit hashes. What repeats is found
by an aggregate that is combined before its shuffle, so that no task holds a frequent window's places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.flat import char_offsets, flat_bytes
from strandlake.runtime import cut, discard, require_columns

#: Repeated windows up to which their list is broadcast.
BROADCAST_KEYS = 500_000

#: Letters of the first level; two bits each fill a 64-bit word.
SEED = 32
#: Window starts handled at once, which bounds the memory of very long sequences.
CHUNK = 1 << 20

_CONTEXT = "id long, key long, anchor long, pos long, n int, x0 long, x1 long, x2 long"

# The four letters' two-bit codes, either case; 4 marks any other byte.
_LETTER = np.full(256, 4, np.uint8)
for _code, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _LETTER[[ord(c) for c in _pair]] = _code


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no order of the letters in the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, where its least value first stands."""
    best, at, span = values, np.arange(len(values)), 1

    def join(shift: int) -> None:
        nonlocal best, at
        left = best[:-shift] <= best[shift:]
        at = np.where(left, at[:-shift], at[shift:])
        best = np.where(left, best[:-shift], best[shift:])

    while span * 2 <= width:
        join(span)
        span *= 2
    if span < width:
        join(width - span)
    return at


def _contexts(length: int):
    """Runs of windows of ``length`` letters with the same representative, with all their letters."""
    width = length - SEED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = flat_bytes(batch.column("sequence"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for c in range(0, len(data), CHUNK):
                # A run is part of the chunk it starts in; it is at most ``width`` long, and the window before tells if one goes on.
                first, end = max(c - 1, 0), min(c + CHUNK + width, len(data))
                letters = _LETTER[data[first : end + length - 1]]
                letters = np.concatenate([letters, np.full(3 * SEED, 4, np.uint8)])
                code = (letters & 3).astype(np.uint64)
                for step in (1, 2, 4, 8, 16):
                    code = (code[:-step] << np.uint64(2 * step)) | code[step:]
                last = end - first
                at = _leftmost_min(_mix(code), width)[:last]
                bad = np.concatenate([[0], np.cumsum(letters == 4)])
                place = np.arange(first, end)
                row = np.searchsorted(starts, place, "right") - 1
                valid = (bad[length : length + last] == bad[:last]) & (place + length <= starts[row + 1])
                new = valid.copy()
                new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
                s = np.flatnonzero(new)
                n = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(s))
                own_chunk = (s + first >= c) & (s + first < c + CHUNK)
                s, n = s[own_chunk], n[own_chunk]
                if not len(s):
                    continue
                own = row[s]
                columns = [
                    ids[own], keys[own], code[at[s]].view(np.int64), char_offsets(data, starts, own, s + first),
                    n.astype(np.int32), *(code[s + k * SEED].view(np.int64) for k in range(3)),
                ]
                names = ["id", "key", "anchor", "pos", "n", "x0", "x1", "x2"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return run


def _letters(first: str, second: str, at: Column) -> Column:
    """The 32 letters that begin ``at`` letters (0 to 32) into two words."""
    a, b = F.col(first), F.col(second)
    shifted = F.call_function("shiftleft", a, 2 * at).bitwiseOR(
        F.call_function("shiftrightunsigned", b, 64 - 2 * at)
    )
    return F.when(at == 0, a).when(at == SEED, b).otherwise(shifted)


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """Every window of the contexts, as two words: its first and its last 32 letters."""
    o, e = F.col("o"), F.col("o") + F.lit(length - SEED)
    tail = F.when(e <= SEED, _letters("x0", "x1", e)).otherwise(_letters("x1", "x2", e - SEED))
    return contexts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "id", "key", (F.col("pos") + o).alias("pos"), _letters("x0", "x1", o).alias("a"), tail.alias("b")
    )


def _repeated(rows: DataFrame, keys: Sequence[str], broadcast_keys: float) -> DataFrame:
    """Rows whose ``keys`` occur under at least two ids.

    The list of repeated keys is written, counted, and broadcast if it is short, so that the rows aren't shuffled; else
    the rows are joined with it by shuffled partitions, where the rows of a frequent key are split by adaptive execution.
    """
    ends = rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = cut(ends.where("lo < hi").select(*keys))
    few = shared.count() <= broadcast_keys
    return rows.join(F.broadcast(shared) if few else shared.hint("merge"), list(keys), "left_semi")


def shared_windows(reads: DataFrame, min_length: int, broadcast_keys: float = BROADCAST_KEYS) -> DataFrame:
    """Windows of ``min_length`` letters that stand in the sequences of at least two ids.

    ``reads`` has ``id`` and ``sequence``; ``min_length`` is at least 32. A window holds only A, C, G
    and T in either case. Output: ``id``, ``key`` (names one of the id's different sequences), ``pos`` (from
    0, in letters), ``a``, ``b`` (what the window says). Rows with a null id or sequence are left
    out, rows sent again with the same sequence count once, two rows of one id don't share with each
    other, other columns are ignored, and an empty table gives no rows. Up to ``broadcast_keys`` repeated windows are
    broadcast as a list.
    """
    require_columns(reads, "id", "sequence")
    if min_length < SEED:
        raise ValueError(f"min_length must be at least {SEED}")
    level = min(min_length, 2 * SEED)
    source = reads.where(F.col("id").isNotNull() & (F.length("sequence") >= level)).select(
        F.col("id").cast("long").alias("id"), F.xxhash64(F.upper("sequence")).alias("key"), "sequence"
    )
    contexts = cut(source.mapInArrow(_contexts(level), _CONTEXT))
    seeds = cut(_repeated(contexts, ["anchor"], broadcast_keys).dropDuplicates(["id", "key", "pos"]))  # the same read may be there again
    discard(contexts)
    windows = cut(_repeated(_windows(seeds, level), ["a", "b"], broadcast_keys))
    discard(seeds)
    while level < min_length:
        shorter, length = windows, min(2 * level, min_length)
        windows, level = _extend(shorter, level, length, broadcast_keys), length
        discard(shorter)
    return windows


def _extend(windows: DataFrame, level: int, length: int, broadcast_keys: float) -> DataFrame:
    """The repeated windows of ``length``, at most twice ``level``: two repeated windows that cover it."""
    step = length - level
    # By position modulo the step, the window one step on is the next row, and a long sequence is many groups.
    w = Window.partitionBy("id", "key", F.pmod("pos", F.lit(step))).orderBy("pos")
    pairs = windows.withColumns({c: F.lead(s).over(w) for c, s in (("p2", "pos"), ("a2", "a"), ("b2", "b"))})
    longer = pairs.where(F.col("p2") == F.col("pos") + step).select(
        "id", "key", "pos",
        F.xxhash64("a", "b", "a2", "b2").alias("a"),
        F.xxhash64(F.lit(length), "b2", "a2", "b", "a").alias("b"),
    )
    longer = cut(longer)  # read twice
    found = cut(_repeated(longer, ["a", "b"], broadcast_keys))
    discard(longer)
    return found


def shared_spans(reads: DataFrame, min_length: int, broadcast_keys: float = BROADCAST_KEYS) -> DataFrame:
    """The stretches of each sequence that are covered by shared windows of ``min_length``.

    Output: ``id``, ``key``, ``start`` (from 0), ``length``, and ``longest``: the longest of the lengths
    min_length, 2 min_length, 4 min_length .. at which a window inside the stretch is still
    shared as a whole. Cases as in :func:`shared_windows`.
    """
    windows, level = shared_windows(reads, min_length, broadcast_keys), min_length
    levels = windows.select("id", "key", "pos", F.lit(level).alias("level"))
    while True:
        windows, level = _extend(windows, level, 2 * level, broadcast_keys), 2 * level
        if windows.isEmpty():
            break
        levels = levels.unionByName(windows.select("id", "key", "pos", F.lit(level).alias("level")))
    w = Window.partitionBy("id", "key").orderBy("pos")
    apart = F.coalesce(F.col("pos") > F.lag("pos").over(w) + min_length, F.lit(True)).cast("int")
    return (
        levels.groupBy("id", "key", "pos").agg(F.max("level").alias("level"))
        .withColumn("apart", apart).withColumn("span", F.sum("apart").over(w))
        .groupBy("id", "key", "span")
        .agg(
            F.min("pos").alias("start"),
            (F.max("pos") + min_length - F.min("pos")).alias("length"),
            F.max("level").alias("longest"),
        )
        .drop("span")
    )


def shared_shares(reads: DataFrame, spans: DataFrame) -> DataFrame:
    """For each id of ``reads``, how many of its letters lie in ``spans`` (of :func:`shared_spans`).

    Output: ``id``, ``n_letters`` (all letters of the id's different sequences), ``n_shared``,
    ``longest`` (null if none). Ids without a sequence have 0 letters; null ids are left out.
    """
    lengths = (
        reads.where(F.col("id").isNotNull())
        .groupBy(F.col("id").cast("long").alias("id"), F.xxhash64(F.upper("sequence")).alias("key"))
        .agg(F.coalesce(F.max(F.length("sequence")), F.lit(0)).alias("letters"))
        .groupBy("id").agg(F.sum("letters").alias("n_letters"))
    )
    found = spans.groupBy("id").agg(F.sum("length").alias("n_shared"), F.max("longest").alias("longest"))
    return lengths.join(found, "id", "left").select(
        "id", "n_letters", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), "longest"
    )
