"""Sketches of sequences as DataFrame transforms, computed batch by batch in Arrow memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import kernels
from strandlake.functions.kernels import FORWARD, REVERSE, SketchParams
from strandlake.runtime import spread

BOTH = (FORWARD, REVERSE)
#: Key of the column metadata that tells how minimizers were made.
MADE_WITH = "sketch"


def _made_with(params: SketchParams) -> dict[str, str]:
    return {MADE_WITH: f"k={params.k} w={params.w} salt=0x{params.salt:016x}"}


def marked(df: DataFrame, params: SketchParams) -> DataFrame:
    """``df`` whose column ``minimizer`` tells its parameters, as those of :func:`minimizers` do."""
    return df.withMetadata("minimizer", _made_with(params))


def require_params(df: DataFrame, params: SketchParams) -> None:
    """An error if the minimizers of ``df`` are known to have other parameters."""
    made, wanted = df.schema["minimizer"].metadata.get(MADE_WITH), _made_with(params)[MADE_WITH]
    if made not in (None, wanted):
        raise ValueError(f"minimizers of {made} can't be used with {wanted}")


def _schema(df: DataFrame, keep: Sequence[str], extra: str) -> T.StructType:
    added = T.StructType.fromDDL(extra)
    clash = set(keep) & set(added.names)
    if clash:
        raise ValueError(f"columns clash with the result: {', '.join(sorted(clash))}")
    return T.StructType([*(df.schema[c] for c in keep), *added.fields])


def _pick(df: DataFrame, keep: Sequence[str], sequence: str, pair: str | None) -> DataFrame:
    texts = [df[sequence].cast("string").alias("__sequence")]
    if pair is not None:
        texts.append(df[pair].cast("string").alias("__pair"))
    return spread(df.select(*[df[c] for c in keep], *texts))


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _pair_of(batch: pa.RecordBatch, pair: str | None) -> pa.Array | None:
    return None if pair is None else batch.column("__pair")


def minimizers(
    df: DataFrame,
    params: SketchParams,
    keep: Sequence[str],
    sequence: str = "sequence",
    pair: str | None = None,
    strands: Sequence[int] = BOTH,
    totals: bool = False,
) -> DataFrame:
    """One row per row, strand and distinct minimizer: ``keep`` .., ``strand`` INT, ``minimizer`` LONG.

    ``totals`` adds ``total`` INT, the size of the set that the minimizer belongs to.

    Strand 0 is the sequence as given, 1 its reverse complement; with ``pair``, each strand also has the other
    strand of the mate. Letters that are no A, C, G or T end a run; runs below k+w-1 letters, empty and null
    sequences have no minimizers, a null mate adds none. Each row has its own sketch, also if rows
    repeat. Columns other than ``keep`` are not read. Minimizers carry unsigned 64-bit patterns.
    """
    names = [*keep, "strand", "minimizer", *["total"] * totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strand in strands:
                row, hashes = kernels.sketch_sets(batch.column("__sequence"), _pair_of(batch, pair), params, strand)
                if not len(row):
                    continue
                at = pa.array(row)
                kept = [batch.column(c).take(at) for c in keep]
                kept += [pa.array(np.full(len(row), strand, np.int32)), pa.array(hashes.view(np.int64))]
                if totals:
                    kept.append(pa.array(np.bincount(row)[row].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(kept, names=names)

    picked = _pick(df, keep, sequence, pair)
    made = picked.mapInArrow(run, _schema(df, keep, "strand int, minimizer long" + ", total int" * totals))
    return marked(made, params)


def minimizer_sets(
    df: DataFrame, params: SketchParams, keep: Sequence[str], sequence: str = "sequence", pair: str | None = None
) -> DataFrame:
    """One row per row: ``keep`` .., ``fwd_set``, ``rc_set`` (distinct, in rising unsigned order, perhaps empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                _lists(*kernels.sketch_sets(batch.column("__sequence"), _pair_of(batch, pair), params, s), batch.num_rows)
                for s in BOTH
            ]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *sets], names=[*keep, "fwd_set", "rc_set"])

    picked = _pick(df, keep, sequence, pair)
    return picked.mapInArrow(run, _schema(df, keep, "fwd_set array<long>, rc_set array<long>"))


def strand_minimizers(
    df: DataFrame, params: SketchParams, keep: Sequence[str], sequence: str = "sequence"
) -> DataFrame:
    """One row per row: hashes and start positions of each strand, in order of the windows.

    A minimizer is listed once for each position it is chosen at; of equal hashes in a window the rightmost one is.
    Positions count letters of the sequence as given, from 0, for both strands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(c) for c in keep]
            for strand in BOTH:
                row, hashes, at = kernels.positions(batch.column("__sequence"), params, strand)
                out += [_lists(row, hashes, batch.num_rows), _lists(row, at.astype(np.int64), batch.num_rows)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *_STRAND_COLUMNS])

    extra = ", ".join(f"{c} array<long>" for c in _STRAND_COLUMNS)
    return _pick(df, keep, sequence, None).mapInArrow(run, _schema(df, keep, extra))


_STRAND_COLUMNS = ("fwd_hashes", "fwd_positions", "rc_hashes", "rc_positions")


def ordered_minimizers(
    df: DataFrame, params: SketchParams, keep: Sequence[str], sequence: str = "sequence", strands: Sequence[int] = BOTH
) -> DataFrame:
    """Minimizers in order of the windows, equal neighbours of a run once: ``keep`` .., ``strand``, ``ord`` from 0, ``minimizer``."""
    names = [*keep, "strand", "ord", "minimizer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strand in strands:
                row, hashes = kernels.ordered(batch.column("__sequence"), params, strand)
                if not len(row):
                    continue
                at = pa.array(row)
                order = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
                columns = [np.full(len(row), strand, np.int32), order, hashes.view(np.int64)]
                kept = [batch.column(c).take(at) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in columns)], names=names)

    made = _pick(df, keep, sequence, None).mapInArrow(run, _schema(df, keep, "strand int, ord int, minimizer long"))
    return marked(made, params)


class _Minimizers:
    """``minimizers(sequence, k, w, salt)`` for SQL. Row by row: Arrow table functions can't stand in a lateral join."""

    def eval(self, sequence: str, k: int, w: int, salt: int):
        if sequence is None:
            return
        params, column = SketchParams(k, w, salt % 2**64), pa.array([sequence])
        for strand in BOTH:
            for h in kernels.sketch_sets(column, None, params, strand)[1].view(np.int64).tolist():
                yield strand, h


def register(spark: SparkSession) -> None:
    """Makes the table function ``minimizers(sequence, k, w, salt)`` known to SQL: ``strand``, ``minimizer``."""
    spark.udtf.register("minimizers", F.udtf(_Minimizers, returnType="strand int, minimizer long"))
