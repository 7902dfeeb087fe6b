"""Sizes in tokens: maximal runs of ``A-Z a-z 0-9 _`` or of other characters that are not blank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.functions.flat import flat_bytes

#: Bytes looked at at once, which bounds the memory of very long texts.
CHUNK = 1 << 22

# The classes of bytes. 0 blank, 1 word, 2 other; bytes beyond ASCII are other.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 0
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = 1


def token_starts(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Where in ``data`` a token begins, chunk by chunk; ``starts`` are the offsets of the rows."""
    for c in range(0, len(data), CHUNK):
        kinds = _CLASS[data[max(c - 1, 0) : c + CHUNK]]
        if c == 0:
            kinds = np.concatenate([[np.uint8(0)], kinds])
        begins = (kinds[1:] != kinds[:-1]) & (kinds[1:] != 0)
        heads = starts[np.searchsorted(starts, c) : np.searchsorted(starts, c + len(begins))] - c
        begins[heads] = kinds[1:][heads] != 0
        yield np.flatnonzero(begins) + c


def count_tokens(column: pa.Array) -> np.ndarray:
    data, starts = flat_bytes(column)
    counts = np.zeros(len(column), np.int64)
    for at in token_starts(data, starts):
        counts += np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(counts))
    return counts


def with_sizes(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` LONG, the size of ``text``: 0 if null, empty or blank."""
    if "n_tokens" in keep:
        raise ValueError("n_tokens clashes with a column to keep")
    picked = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(count_tokens(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*keep, "n_tokens"])

    return picked.mapInArrow(run, schema)
