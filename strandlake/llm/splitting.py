"""Cutting documents larger than a limit at natural boundaries.

Balanced targets: the fewest pieces that can hold what is left of a document give the
length the next piece should have; its end is moved to the strongest boundary within reach (a blank
line before a line end), failing that to the nearest line end at which the piece stays under the limit.
If the pieces planned can't hold the rest any more, a piece is added. Only a line that is itself larger
than the limit is cut inside, between tokens, at a blank if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.flat import flat_bytes
from strandlake.llm.tokens import _CLASS, token_starts

_OUT = (
    "doc_id long, piece int, n_pieces int, token_start long, token_end long, overlap int, "
    "char_start long, char_end long, cut string, cut_line int"
)
_KINDS = ("token", "blank", "line", "block")


def _nearest(places: np.ndarray, low: int, high: int, target: float) -> int | None:
    """Of the sorted ``places`` in low .. high, the one nearest to ``target``; the earlier of two."""
    i, j = np.searchsorted(places, low), np.searchsorted(places, high, "right")
    if i >= j:
        return None
    k = min(max(int(np.searchsorted(places, target)), i), j - 1)
    if k > i and target - places[k - 1] <= places[k] - target:
        k -= 1
    return int(places[k])


def find_cuts(strength: np.ndarray, limit: int, overlap: int, reach: int) -> list[tuple[int, int]]:
    """For each piece, the token at which it ends (exclusive) and the tokens it shares with the one before.

    ``strength[i]`` is that of a cut before token i: 0 none, 1 blank, 2 line end, 3 blank line.
    """
    n = len(strength)
    levels = [np.flatnonzero(strength >= s) for s in (3, 2, 1)]
    lines = levels[1]
    out: list[tuple[int, int]] = []
    begin, planned = 0, 0
    while True:
        shared = min(overlap, begin)
        room, left = limit - shared, n - begin
        fewest = 1 if left <= room else 1 + -(-(left - room) // (limit - overlap))
        planned = max(planned - 1, fewest)
        if left <= room:
            out.append((n, shared))
            return out
        target = begin + (left + (planned - 1) * overlap + shared) / planned - shared
        high = min(begin + room, n - 1)
        target = min(target, high)
        end = None
        for places in levels[:2]:
            end = _nearest(places, max(begin + 1, int(target - reach)), min(high, int(target + reach)), target)
            if end is not None:
                break
        if end is None:
            end = _nearest(lines, begin + 1, high, target)
        if end is None:
            after = int(np.searchsorted(lines, begin, "right"))
            line_end = int(lines[after]) if after < len(lines) else n
            at_line_start = begin == 0 or strength[begin] >= 2
            if at_line_start and line_end - begin <= limit:
                shared = min(shared, limit - (line_end - begin))  # the line fits if less is shared with the piece before
                out.append((line_end, shared))
                if line_end == n:
                    return out
                begin = line_end
                continue
            end = _nearest(levels[2], max(begin + 1, int(target - reach)), min(high, int(target + reach)), target)
            if end is None:
                end = max(begin + 1, int(target))
        out.append((end, shared))
        begin = end


def _cut_batches(limit: int, overlap: int, reach: int):
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = flat_bytes(batch.column("text"))
            tokens = np.concatenate([np.zeros(0, np.int64), *token_starts(data, starts)])
            first = np.searchsorted(tokens, starts)
            counts = np.diff(first)
            small = np.flatnonzero(counts <= limit)
            ends = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)[small]
            ends = ends.astype(np.int64)
            zero, one = np.zeros(len(small), np.int64), np.ones(len(small), np.int32)
            parts = [[small, one, one, zero, counts[small], zero.astype(np.int32), zero, ends]]
            kinds, lines = [np.full(len(small), "end", object)], [np.full(len(small), -1)]
            for row in np.flatnonzero(counts > limit).tolist():
                begins = tokens[first[row] : first[row + 1]]
                text = data[starts[row] : starts[row + 1]]
                newlines = np.flatnonzero(text == 10) + starts[row]
                line = np.searchsorted(newlines, begins)
                strength = np.zeros(len(begins), np.int8)
                strength[1:] = np.minimum(np.diff(line), 2) + 1
                flat = np.flatnonzero(strength[1:] == 1) + 1
                strength[flat] = _CLASS[data[begins[flat] - 1]] == 0  # a blank stands before the token
                found = find_cuts(strength, limit, overlap, reach)
                end = np.array([e for e, _ in found])
                shared = np.array([s for _, s in found], np.int32)
                begin = np.concatenate([[0], end[:-1]]) - shared
                k = len(end)
                edges = np.append(begins, starts[row + 1]) - starts[row]
                edges[0] = 0
                if len(text) and text.max() >= 0x80:
                    inner = np.concatenate([[0], np.cumsum((text & 0xC0) == 0x80)])
                    edges = edges - inner[edges]
                cut = strength[end[:-1]]
                number = np.where(cut < 2, line[end[:-1]] + 1, -1)
                parts.append([
                    np.full(k, row), np.arange(1, k + 1, dtype=np.int32), np.full(k, k, np.int32), begin, end, shared,
                    edges[begin], edges[end],
                ])
                kinds.append(np.array([*(_KINDS[s] for s in cut), "end"], object))
                lines.append(np.append(number, -1))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            number = np.concatenate(lines)
            doc = batch.column("doc_id").take(pa.array(columns[0]))
            arrays = [doc, *(pa.array(c) for c in columns[1:]), pa.array(np.concatenate(kinds), pa.string())]
            arrays.append(pa.array(number.astype(np.int32), mask=number < 0))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def split_documents(
    docs: DataFrame,
    limit: int,
    overlap: int = 0,
    reach: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of at most ``limit`` tokens, each sharing ``overlap`` tokens with the one before.

    ``reach`` (a quarter of the limit if not given) is how far from its balanced place a cut looks for the
    strongest boundary. Output, one row per piece: ``doc_id`` LONG, ``piece`` INT from 1, ``n_pieces``,
    ``token_start``, ``token_end`` (exclusive), ``overlap``, ``char_start``, ``char_end`` (code points; pieces
    without their overlaps, end to end, are the text), ``cut`` (what ends it: block, line, blank, token or end), ``cut_line`` (from
    1, of a cut inside a line, else null). The overlap is shorter only where a line fits no other way.
    A document of no more than ``limit`` tokens, also a null or empty one, is one piece. Each row
    is a document of its own; other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_cut_batches(limit, overlap, limit // 4 if reach is None else reach), _OUT)
