"""Scoring reads against an index: one equi-join of distinct minimizers, counted.

The sketch of a read is joined on the minimizer. A small index is broadcast, so that hits are counted where the reads were
sketched and only the counts are shuffled; a large one is joined by shuffled partitions, where minimizers that very many reads
share are split by adaptive execution. Totals are counted before the join, after the negative filter. Indices that are known to
have other parameters than the reads' sketch are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.encoding import score
from strandlake.functions.kernels import FORWARD, REVERSE, SketchParams
from strandlake.operators.sketch import minimizers, require_params
from strandlake.runtime import cut, partitions, settled, small

#: Entries of an index up to which it is broadcast, and those of a partition up to which it is hashed.
BROADCAST_ENTRIES, HASHED_ENTRIES = 2_000_000, 2_000_000
#: Lowest score reported; the wide form knows only this one.
THRESHOLD, POOLED_THRESHOLD = 0.1, 0.05
_TOTALS = ((FORWARD, "fwd_total"), (REVERSE, "rc_total"))


def check_threshold(threshold: float) -> None:
    if not (isfinite(threshold) and 0 <= threshold <= 1):
        raise ValueError(f"threshold must be in [0, 1]; got {threshold}")


def query_sketch(
    reads: DataFrame,
    params: SketchParams,
    pair: str | None = None,
    negative: DataFrame | None = None,
    query: str = "id",
    unique_ids: bool = False,
) -> DataFrame:
    """``query_id``, ``strand``, ``minimizer``, distinct within each read; without the minimizers of ``negative``.

    If ids are known to be unique and nothing is filtered, each row has the ``total`` of its read and strand, and
    :func:`scores` needs no second pass over the reads for it.
    """
    renamed = reads.withColumnRenamed(query, "query_id")
    sketch = minimizers(renamed, params, ["query_id"], pair=pair, totals=unique_ids and negative is None)
    if negative is None:
        return sketch
    require_params(negative, params)
    return sketch.join(negative.select("minimizer").distinct(), "minimizer", "left_anti").select(*sketch.columns)


def query_totals(sketch: DataFrame) -> DataFrame:
    """``query_id``, ``fwd_total``, ``rc_total``."""
    return sketch.groupBy("query_id").agg(
        F.count(F.when(F.col("strand") == FORWARD, 1)).alias("fwd_total"),
        F.count(F.when(F.col("strand") == REVERSE, 1)).alias("rc_total"),
    )


def _meet(sketch: DataFrame, index: DataFrame) -> DataFrame:
    """The join of minimizers with the buckets that hold them, its way chosen by the counted size of the index.

    Up to BROADCAST_ENTRIES the index is broadcast. Up to HASHED_ENTRIES for each shuffle partition its partitions are hashed, as
    the planner, left to itself, broadcasts whichever side is small in bytes and then runs the join, whose result is far
    larger than its inputs, in as few tasks as the other side had. A larger index is sorted, which may spill.
    """
    entries = settled(index.select("minimizer", "bucket_id"))
    n = entries.count()
    fits = n <= HASHED_ENTRIES * partitions(index.sparkSession)
    how = "broadcast" if n <= BROADCAST_ENTRIES else "shuffle_hash" if fits else "merge"
    return sketch.join(entries.hint(how), "minimizer")


def _hit_counts(sketch: DataFrame, index: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    return _meet(sketch, index).groupBy("query_id", "bucket_id").agg(
        F.count(F.when(F.col("strand") == FORWARD, 1)).alias("fwd_hits"),
        F.count(F.when(F.col("strand") == REVERSE, 1)).alias("rc_hits"),
        *more,
    )


def hit_counts(sketch: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id``, ``bucket_id``, ``fwd_hits``, ``rc_hits`` of every pair with at least one hit."""
    return _hit_counts(sketch, index)


def scores(sketch: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id``, ``bucket_id``, ``score`` of the pairs with a hit and at least ``threshold``."""
    check_threshold(threshold)
    value = score(F.col("fwd_hits"), F.col("fwd_total"), F.col("rc_hits"), F.col("rc_total"))
    if "total" in sketch.columns:  # of a strand without hits it isn't known, nor needed
        counted = _hit_counts(sketch, index, [F.max(F.when(F.col("strand") == s, F.col("total"))).alias(n) for s, n in _TOTALS])
        counted = counted.fillna(0, [n for _, n in _TOTALS])
    else:
        counted = hit_counts(sketch, index).join(query_totals(sketch), "query_id")
    return counted.select("query_id", "bucket_id", value.alias("score")).where(F.col("score") >= threshold)


def best_hits(hits: DataFrame) -> DataFrame:
    """The hit with the highest score of each query; of equal ones that with the lowest bucket.

    Null and NaN scores are no hits, nor are rows with a null query or bucket. Repeated rows give one.
    """
    valid = hits.where("query_id IS NOT NULL AND bucket_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    # An aggregate, unlike a window, is combined before the shuffle, so that a hot query is one row per task.
    best = F.max(F.struct(F.col("score"), (-F.col("bucket_id").cast("long")).alias("b"))).alias("best")
    return valid.groupBy("query_id").agg(best).select(
        "query_id", (-F.col("best.b")).cast("int").alias("bucket_id"), F.col("best.score").alias("score")
    )


def classify(
    reads: DataFrame,
    index: DataFrame,
    params: SketchParams,
    threshold: float = THRESHOLD,
    pair: str | None = None,
    negative: DataFrame | None = None,
    best_hit: bool = False,
    unique_ids: bool = False,
) -> DataFrame:
    """Hits of ``reads`` (``id``, ``sequence`` [, mate]): ``query_id``, ``bucket_id``, ``score``.

    ``id`` names a read; rows of the same id are pooled, each counting with all its minimizers. ``unique_ids`` tells that there
    is one row per id, which saves a pass. Reads without minimizers, or whose minimizers are all in ``negative``, have no
    hits. ``best_hit`` is taken among the hits that reach the threshold.
    """
    require_params(index, params)
    hits = scores(query_sketch(reads, params, pair, negative, unique_ids=unique_ids), index, threshold)
    return best_hits(hits) if best_hit else hits


def named(hits: DataFrame, buckets: DataFrame) -> DataFrame:
    """``query_id``, ``bucket_name``, ``score``; a bucket that isn't listed is ``unknown``."""
    names = small(buckets.select("bucket_id", "bucket_name"))
    return hits.join(names, "bucket_id", "left").select(
        "query_id", F.coalesce("bucket_name", F.lit("unknown")).alias("bucket_name"), "score"
    )


def wide(hits: DataFrame, bucket_ids: Sequence[int]) -> DataFrame:
    """One row per query with a hit, one column ``bucket_<id>`` per bucket in rising order, 0.0 without a hit.

    The scores of a query are gathered in a map (it has at most one of each bucket; of repeated ones the highest stays), from
    which the columns are read, so that the aggregate doesn't grow with the number of buckets. Rows with a null bucket add nothing.
    """
    ids = sorted(set(bucket_ids))
    if not ids:
        return hits.select("query_id").distinct()
    cells = hits.groupBy("query_id", "bucket_id").agg(F.max("score").alias("score"))
    known = F.when(F.col("bucket_id").isNotNull() & F.col("score").isNotNull(), F.struct("bucket_id", "score"))
    rows = cells.groupBy("query_id").agg(F.map_from_entries(F.collect_list(known)).alias("scores"))
    return rows.select("query_id", *[F.coalesce(F.try_element_at("scores", F.lit(b)), F.lit(0.0)).alias(f"bucket_{b}") for b in ids])


def aggregate(
    reads: DataFrame,
    index: DataFrame,
    params: SketchParams,
    threshold: float = POOLED_THRESHOLD,
    pair: str | None = None,
    negative: DataFrame | None = None,
) -> DataFrame:
    """All reads pooled into one query: ``query_name`` ('global'), ``bucket_id``, ``score``.

    Minimizers are distinct over all reads on each strand. Counting is spread by minimizer, then merged.
    """
    check_threshold(threshold)
    require_params(index, params)
    sketch = cut(query_sketch(reads, params, pair, negative).select("strand", "minimizer").distinct())  # read twice
    totals = sketch.groupBy("strand").agg(F.count(F.lit(1)).alias("total"))  # two rows at most
    counts = _meet(sketch, index).groupBy("bucket_id", "strand").count()
    return (
        counts.join(F.broadcast(totals), "strand")
        .groupBy("bucket_id").agg(F.max(F.col("count") / F.col("total")).alias("score"))
        .where(F.col("score") >= threshold)
        .select(F.lit("global").alias("query_name"), "bucket_id", "score")
    )


def hitting_minimizers(sketch: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``sketch`` whose minimizer is in the index."""
    known = index.select("minimizer").distinct()
    return sketch.join(known, "minimizer", "left_semi").select(*sketch.columns)


def bucket_hits(minimizer_list: DataFrame, index: DataFrame) -> DataFrame:
    """``bucket_id``, ``n``: how many of the minimizers, repeats counted, each bucket has."""
    joined = _meet(minimizer_list.select("minimizer"), index)
    return joined.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))


def top_ranked(hits: DataFrame, n: int) -> DataFrame:
    """The ``n`` first hits of each query with their rank, by score, then bucket; cut before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("bucket_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
