"""Classification of a stream of reads against a static index.

A read is one row, so every result is complete within its micro-batch: no state, no watermark. The best hit of an
id is that of its batch; ids must be unique over the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.kernels import SketchParams
from strandlake.operators.classify import THRESHOLD, classify
from strandlake.operators.logratio import log_ratio
from strandlake.runtime import settled


def for_each_batch(
    stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """``apply`` to every micro-batch, each written once to ``path/batch=<n>`` even if it is run again."""

    def run(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def classify_stream(
    stream: DataFrame, index: DataFrame, params: SketchParams, path: str, checkpoint: str, threshold: float = THRESHOLD,
    trigger: dict | None = None, negative: DataFrame | None = None, **options,
) -> StreamingQuery:
    """Hits of every micro-batch of reads, as by :func:`strandlake.operators.classify.classify`.

    The indices are computed once, before the stream begins.
    """
    index, negative = settled(index), None if negative is None else settled(negative)
    return for_each_batch(stream, lambda b: classify(b, index, params, threshold, negative=negative, **options), path, checkpoint, trigger)


def log_ratio_stream(
    stream: DataFrame, numerator: DataFrame, denominator: DataFrame, params: SketchParams, path: str, checkpoint: str,
    skip: float | None = None, trigger: dict | None = None, **options,
) -> StreamingQuery:
    numerator, denominator = settled(numerator), settled(denominator)
    return for_each_batch(stream, lambda b: log_ratio(b, numerator, denominator, params, skip, **options), path, checkpoint, trigger)
