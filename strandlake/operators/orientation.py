"""Choosing the strand on which a reference goes into its bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.encoding import unsigned_key
from strandlake.functions.kernels import FORWARD, REVERSE, SketchParams
from strandlake.operators.index import PAIR, consolidate
from strandlake.operators.sketch import minimizer_sets, minimizers
from strandlake.runtime import cut

#: The smallest minimizers of each strand that are compared with the baseline.
SAMPLE = 10_000


def baselines(features: DataFrame) -> DataFrame:
    """The first feature of each bucket, by ``feature_idx``: ``bucket_id``, ``feature_idx``."""
    return features.groupBy("bucket_id").agg(F.min("feature_idx").alias("feature_idx"))


def choose_strands(sketches: DataFrame, first: DataFrame, sample: int = SAMPLE, several: bool = False) -> DataFrame:
    """The strand of every feature against the fixed baseline of its bucket.

    ``sketches`` has ``bucket_id``, ``feature_idx``, ``strand``, ``minimizer`` (distinct); ``first`` names each bucket's
    baseline feature, or with ``several`` the features that make up its baseline. Of both strands the n smallest minimizers (unsigned) are compared, n being the least of
    ``sample`` and the sizes of the two; the reverse is chosen only if it shares more. Output: ``bucket_id``,
    ``feature_idx``, ``n_compared``, ``fwd_matches``, ``rc_matches``, ``strand``; baselines are forward.
    """
    own = ["bucket_id", "feature_idx"]
    totals = sketches.groupBy(*own).agg(
        F.count(F.when(F.col("strand") == FORWARD, 1)).alias("nf"), F.count(F.when(F.col("strand") == REVERSE, 1)).alias("nr")
    )
    rank = F.row_number().over(Window.partitionBy(*own, "strand").orderBy(unsigned_key("minimizer")))
    smallest = sketches.withColumn("rank", rank).where(F.col("rank") <= sample)
    base = sketches.where(F.col("strand") == FORWARD).join(first, own, "left_semi").select(*PAIR).withColumn("known", F.lit(1))
    if several:
        base = base.distinct()
    compared = smallest.join(totals, own).where(F.col("rank") <= F.least("nf", "nr")).join(base, [*PAIR], "left")
    matches = compared.groupBy(*own).agg(
        F.count(F.when(F.col("strand") == FORWARD, F.col("known"))).alias("fwd_matches"),
        F.count(F.when(F.col("strand") == REVERSE, F.col("known"))).alias("rc_matches"),
    )
    baseline = first.select(*own, F.lit(True).alias("is_baseline"))
    zero = F.lit(0).cast("long")
    return (
        totals.join(matches, own, "left").join(baseline, own, "left")
        .select(
            *own, F.least(F.lit(sample), "nf", "nr").cast("long").alias("n_compared"),
            F.coalesce("fwd_matches", zero).alias("fwd_matches"), F.coalesce("rc_matches", zero).alias("rc_matches"),
            F.when(F.col("is_baseline").isNull() & (F.col("rc_matches") > F.col("fwd_matches")), REVERSE)
            .otherwise(FORWARD).alias("strand"),
        )
    )


def build_oriented(
    features: DataFrame, params: SketchParams, sample: int = SAMPLE, first: DataFrame | None = None
) -> DataFrame:
    """The index of ``features`` (``bucket_id``, ``feature_idx``, ``sequence``), each on its chosen strand.

    ``first`` names the features of the baselines, else each bucket's first feature is its baseline. A feature may come in
    several rows, as its overlapping pieces. The sketches are written once, as they are read several times.
    """
    place = ["bucket_id", "feature_idx", "strand"]
    sketches = cut(minimizers(features, params, place[:2]).distinct())
    baseline = baselines(features) if first is None else first
    chosen = choose_strands(sketches, baseline, sample, first is not None).select(*place)
    return consolidate(sketches.join(chosen, place, "left_semi"))


def build_growing(features: DataFrame, params: SketchParams, order: str = "feature_idx", sample: int = SAMPLE) -> DataFrame:
    """The index with each feature compared to all that its bucket holds so far, in the order of ``order``.

    Each choice depends on those before it, so a bucket is worked off by one task, one feature at a time; only
    its set of minimizers is held. Buckets too large for that take :func:`build_oriented`.
    """
    sets = minimizer_sets(features, params, ["bucket_id", order])
    ranged = sets.repartition("bucket_id").sortWithinPartitions("bucket_id", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, np.zeros(0, np.uint64)

        def out() -> pd.DataFrame:
            return pd.DataFrame({"minimizer": held.view(np.int64), "bucket_id": np.full(len(held), bucket, np.int32)})

        for batch in batches:
            for b, fwd, rc in zip(batch["bucket_id"], batch["fwd_set"], batch["rc_set"], strict=True):
                fwd, rc = (np.asarray(x, np.int64).view(np.uint64) for x in (fwd, rc))
                if b != bucket:
                    if bucket is not None:
                        yield out()
                    bucket, held = b, fwd
                    continue
                n = min(sample, len(fwd), len(rc))
                matched = [np.isin(x[:n], held, assume_unique=True).sum() for x in (fwd, rc)]
                held = np.union1d(held, rc if matched[1] > matched[0] else fwd)
        if bucket is not None:
            yield out()

    return ranged.mapInPandas(run, "minimizer long, bucket_id int").where("bucket_id IS NOT NULL")
