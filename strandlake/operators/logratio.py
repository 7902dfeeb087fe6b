"""Comparing reads with two references of one bucket each."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.encoding import log_ratio as ratio
from strandlake.functions.kernels import SketchParams
from strandlake.operators.classify import query_sketch, scores
from strandlake.operators.sketch import require_params
from strandlake.runtime import cut, settled

NO_PATH, HIGH_NUMERATOR = "none", "num_high"


def check_single_bucket(index: DataFrame, empty: bool = False) -> None:
    """An error unless the index has one bucket, or, with ``empty``, no entry at all."""
    row = index.agg(F.min("bucket_id").alias("a"), F.max("bucket_id").alias("b")).first()
    if row["a"] != row["b"] or (row["a"] is None and not empty):
        raise ValueError("an index for log-ratios must have exactly one bucket")


def check_skip(skip: float | None) -> None:
    if skip is not None and not (isfinite(skip) and skip <= 1):
        raise ValueError(f"skip threshold must be at most 1; got {skip}")


def log_ratio(
    reads: DataFrame,
    numerator: DataFrame,
    denominator: DataFrame,
    params: SketchParams,
    skip: float | None = None,
    pair: str | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """``query_id``, ``numerator``, ``denominator`` (null if not looked at), ``log_ratio``, ``fast_path`` of every read.

    Scores are 0 without a hit. A read whose numerator reaches ``skip`` (none or <= 0: no read does) isn't joined
    with the denominator; its ratio is Infinity and its path ``num_high``. One row per distinct non-null id. Indices with more than
    one bucket, or known to have other parameters, are refused; an empty one has no hits.
    """
    check_skip(skip)
    for i in (numerator, denominator):
        require_params(i, params)
    numerator, denominator = (settled(i.select("minimizer", "bucket_id")) for i in (numerator, denominator))
    for i in (numerator, denominator):
        check_single_bucket(i, empty=True)
    sketch = query_sketch(reads, params, pair, unique_ids=unique_ids)
    every = reads.where(F.col("id").isNotNull()).select(F.col("id").alias("query_id")).distinct()
    if skip is None or skip <= 0:
        # Both references in one pass over the reads, as two buckets.
        sides = [i.select("minimizer", F.lit(k).alias("bucket_id")) for k, i in enumerate((numerator, denominator))]
        both = scores(sketch, sides[0].unionByName(sides[1]).distinct(), 0.0)
        found = both.groupBy("query_id").agg(
            *[F.max(F.when(F.col("bucket_id") == k, F.col("score"))).alias(n) for k, n in enumerate(("numerator", "denominator"))]
        )
        high = F.lit(False)
        joined = every.join(found, "query_id", "left").fillna(0.0, ["numerator"])
    else:
        num = cut(scores(sketch, numerator, 0.0).select("query_id", F.col("score").alias("numerator")))  # read twice
        high = F.col("numerator") >= skip
        rest = sketch.join(num.where(high).select("query_id"), "query_id", "left_anti")
        den = scores(rest, denominator, 0.0).select("query_id", F.col("score").alias("denominator"))
        joined = every.join(num, "query_id", "left").fillna(0.0, ["numerator"]).join(den, "query_id", "left")
    shown = F.coalesce("denominator", F.lit(0.0))
    return joined.select(
        "query_id",
        "numerator",
        F.when(~high, shown).alias("denominator"),
        F.when(high, F.lit(float("inf"))).otherwise(ratio("numerator", shown)).alias("log_ratio"),
        F.when(high, HIGH_NUMERATOR).otherwise(NO_PATH).alias("fast_path"),
    )


def fast_path_code(column: str = "fast_path"):
    """The path as INT: 0 none, 1 num_high."""
    return F.when(F.col(column) == HIGH_NUMERATOR, 1).otherwise(0).cast("int")


def passing(ratios: DataFrame, positive: bool = False) -> DataFrame:
    """Ids of the reads whose log-ratio is below 0 (above 0 with ``positive``) or NaN; 0 doesn't pass."""
    r = F.col("log_ratio")
    sign = (r > 0) & ~F.isnan(r) if positive else r < 0
    return ratios.where(sign | F.isnan(r)).select("query_id")


def passing_reads(reads: DataFrame, ratios: DataFrame, positive: bool = False) -> DataFrame:
    """The rows of ``reads`` that pass, all their columns."""
    return reads.join(passing(ratios, positive).withColumnRenamed("query_id", "id"), "id", "left_semi").select(*reads.columns)
