"""Filling containers of fixed capacity with whole items.

Items are dealt into shards of bounded size, in turn, so that a shard looks like the whole. Each shard
starts from a best fit of its items in falling order and is then improved by a local search that
tries to empty its least filled container: an item moves to another container, or changes places with
one or two smaller ones there. Every step makes fuller containers fuller at the cost of emptier ones, which
raises the sum of squared fills, so the search ends: when no move or exchange helps, at the fewest containers
that could hold the shard, or, if asked to, after a number of tries. At most about one container a shard stays partly empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tokens import with_sizes

#: Items of a shard.
SHARD_ITEMS = 10_000
#: Most tasks that pack shards. The rows are few and small but costly, so that their bytes alone would give one task.
TASKS = 10_000

_OUT = "container_id long, doc_id long, piece int, token_start long, n_tokens int, fill int, is_split boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """A container for each size, largest first, each into the fullest one that has room; the fills."""
    where = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit f is set while some container has f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                rooms &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        where[i] = b
        fills[b] += size
        left = free - size
        by_free[left].append(b)
        rooms |= 1 << left
    return where, fills


def _step(
    sizes: np.ndarray, where: np.ndarray, fills: np.ndarray, source: int, capacity: int, among: np.ndarray | bool = True
) -> bool:
    """One improving move of an item out of ``source`` into one of ``among``; False if there is none."""
    free = capacity - fills
    open_bins = np.flatnonzero((free > 0) & (fills > 0) & (fills >= fills[source]) & among)
    open_bins = open_bins[open_bins != source]
    if not len(open_bins):
        return False
    is_open = np.zeros(len(fills), bool)
    is_open[open_bins] = True
    own = np.flatnonzero(where == source)
    own = own[np.argsort(-sizes[own], kind="stable")]
    others = np.flatnonzero(is_open[where])
    others = others[np.lexsort((sizes[others], where[others]))]
    size, bins = sizes[others], where[others]
    room = free[bins]
    # Containers and sizes as one rising number, by which an item's partner is looked up.
    place = bins * (2 * capacity + 1) + size
    for x in own.tolist():
        s = int(sizes[x])
        fitting = open_bins[free[open_bins] >= s]
        if len(fitting):
            to = int(fitting[np.argmin(free[fitting])])
            _move(sizes, where, fills, [x], source, to)
            return True
        gain = s - size
        good = np.flatnonzero((gain > 0) & (gain <= room))
        if len(good):
            y = good[np.argmax(gain[good])]
            to = int(bins[y])
            _move(sizes, where, fills, [x], source, to)
            _move(sizes, where, fills, [int(others[y])], to, source)
            return True
        # For each item the smallest partner further on in its container with which the two leave room enough for x.
        least = np.maximum(s - room - size, 0)
        partner = np.maximum(np.searchsorted(place, bins * (2 * capacity + 1) + least), np.arange(len(others)) + 1)
        there = partner < len(others)
        partner[~there] = 0
        gain = s - size - size[partner]
        good = np.flatnonzero(there & (bins[partner] == bins) & (gain > 0) & (gain <= room))
        if len(good):
            y = good[np.argmax(gain[good])]
            to = int(bins[y])
            _move(sizes, where, fills, [x], source, to)
            _move(sizes, where, fills, [int(others[y]), int(others[partner[y]])], to, source)
            return True
    return False


def _move(sizes: np.ndarray, where: np.ndarray, fills: np.ndarray, items: list[int], source: int, to: int) -> None:
    total = int(sizes[items].sum())
    where[items] = to
    fills[source] -= total
    fills[to] += total


def local_search(sizes: np.ndarray, where: np.ndarray, fills: np.ndarray, capacity: int, effort: int | None = None) -> None:
    """Empties containers by moves and exchanges, in place, until none helps, or after ``effort`` tries a container.

    A container that failed is tried again with only those that changed since; the others still offer it nothing.
    """
    # No fewer can do: the total has to fit, and two items above half the capacity never share a container.
    least = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    # By container: the step that changed it last, and the steps done when it failed, -1 if it has changed since.
    changed, failed = np.zeros(len(fills), np.int64), np.full(len(fills), -1)
    steps = 0
    for _ in count() if effort is None else range(effort * len(fills)):
        if np.count_nonzero(fills) <= least:
            return
        candidates = np.flatnonzero((fills > 0) & (fills < capacity) & (failed < steps))
        if not len(candidates):
            return
        source = int(candidates[np.argmin(fills[candidates])])
        before = fills.copy()
        if _step(sizes, where, fills, source, capacity, changed > failed[source]):
            steps += 1
            moved = fills != before
            changed[moved], failed[moved] = steps, -1
        else:
            failed[source] = steps


def pack(sizes: np.ndarray, capacity: int, effort: int | None = None) -> np.ndarray:
    """A container for each size (1 to ``capacity``), numbered from 0 without gaps."""
    where, start = best_fit(sizes, capacity)
    fills = np.array(start, np.int64)
    local_search(sizes, where, fills, capacity, effort)
    return np.unique(where, return_inverse=True)[1] if len(where) else where


def _pack_shard(capacity: int, effort: int | None):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        docs = table.column("doc_id").combine_chunks()
        sizes = table.column("n_tokens").to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        split = sizes > capacity
        whole = np.where(sizes == capacity, capacity, rest)  # what is put together with others
        full = np.where(sizes == capacity, 0, full)
        items = np.flatnonzero(whole > 0)
        where = pack(whole[items], capacity, effort)
        n_bins = int(where.max()) + 1 if len(where) else 0
        # Full containers of larger items come after the shared ones; items without tokens go to the first one.
        big = np.repeat(np.arange(len(sizes)), full)
        order = np.arange(len(big)) - np.repeat(np.cumsum(full) - full, full)
        empty = np.flatnonzero(sizes == 0)
        item = np.concatenate([items, big, empty])
        container = np.concatenate([where, n_bins + np.arange(len(big)), np.zeros(len(empty), np.int64)])
        piece = np.concatenate([full[items], order, np.zeros(len(empty), np.int64)])
        n = np.concatenate([whole[items], np.full(len(big), capacity), np.zeros(len(empty), np.int64)])
        fill = np.bincount(container, weights=n, minlength=1).astype(np.int32)
        columns = {
            "container_id": container + (shard << 32),
            "doc_id": docs.take(pa.array(item)),
            "piece": (piece + 1).astype(np.int32),
            "token_start": piece * capacity,
            "n_tokens": n.astype(np.int32),
            "fill": fill[container],
            "is_split": split[item],
        }
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return run


def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) * 7919
        for batch in batches:
            shard = pa.array((np.arange(at, at + batch.num_rows) % shards).astype(np.int64))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=["doc_id", "n_tokens", "shard"])

    return run


def fill_containers(
    docs: DataFrame,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_items: int = SHARD_ITEMS,
    effort: int | None = None,
) -> DataFrame:
    """Every document in a container of ``capacity`` tokens, whole unless it is larger than one.

    Output, one row per piece: ``container_id`` LONG, ``doc_id`` LONG, ``piece`` INT from 1, ``token_start``
    LONG, ``n_tokens`` INT, ``fill`` INT (tokens in the container), ``is_split``. A larger document
    fills whole containers of its own; its rest is put together with others like an item. Documents of
    no tokens (null, empty, blank) go, with 0 tokens, to the first container of their shard. Each row is an
    item of its own, also if repeated or with a null id; other columns are ignored; an empty table gives no rows. Shards of
    ``shard_items`` documents are searched until no exchange helps, or, with ``effort``, for so many tries a container.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    shards = max(1, -(-docs.count() // shard_items))
    sizes = with_sizes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    dealt = sizes.mapInArrow(_deal(shards), "doc_id long, n_tokens long, shard long")
    dealt = dealt.repartition(min(shards, TASKS), "shard")
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity, effort), _OUT)
