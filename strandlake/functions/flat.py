"""Text columns of an Arrow batch as one run of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the offsets of its rows (one more than rows).

    Null rows are empty. Nothing is copied unless the column has nulls.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else pa.scalar("", column.type))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def char_offsets(data: np.ndarray, starts: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before byte ``at`` in its row ``rows``; both are positions in ``data``."""
    begin = starts[rows]
    if not len(data) or data.max() < 0x80:
        return at - begin
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    return at - begin - (inner[at] - inner[begin])
