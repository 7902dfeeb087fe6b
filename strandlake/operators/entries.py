"""Index entries (minimizer, bucket) as they arrive, before consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import require_columns, small


def valid_entries(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows whose minimizer is not null and whose bucket is listed; repeats are kept.

    ``buckets`` is broadcast only up to the row bound of :func:`strandlake.runtime.small`.
    """
    require_columns(entries, "minimizer", "bucket_id")
    listed = buckets.select("bucket_id").where(F.col("bucket_id").isNotNull()).distinct()
    return entries.where(F.col("minimizer").isNotNull()).join(small(listed), "bucket_id", "left_semi")
