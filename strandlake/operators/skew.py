"""Per-key results when a few keys own most rows.

A heavy key is one that owns at least a given share of all rows, by default a quarter of a mean
shuffle partition, so that no light key is more than a small part of a task, whatever the data size. There are at
most 1/share such keys, so their list is bounded and may be held by the driver. Candidates come from mergeable frequent-item sketches (one scan, no shuffle
of keys); a sketch only ever over-counts, so no heavy key is missed, and a light key taken
for a heavy one costs nothing but a needless salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.runtime import partitions

#: A key with at least this part of a mean partition is salted.
HEAVY_PART = 1 / 4
#: A sketch's error is below ERROR / (items it tracks) of the rows; Spark's sketches track at most so many.
ERROR, MOST_TRACKED = 3.5, 1_000_000
#: Sketches are merged in a tree with this many inner nodes.
FAN_IN = 64


def heavy_share(spark: SparkSession) -> float:
    """The share of all rows that makes a quarter of a mean shuffle partition of the session."""
    return min(1.0, max(HEAVY_PART / partitions(spark), 2 * ERROR / MOST_TRACKED))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float | None = None) -> tuple[int, dict[str, list]]:
    """Rows of ``df`` and, for each column in ``keys``, its non-null heavy values.

    One scan. The lists hold every value with at least ``share`` (else :func:`heavy_share`) of the rows, perhaps a few
    that have slightly less, at most ``2 / share`` in all. An empty table gives 0 and empty
    lists. The sketch tracks so many items that its error is at most half of ``share``.
    """
    share = heavy_share(df.sparkSession) if share is None else share
    if not 2 * ERROR / MOST_TRACKED <= share <= 1:
        raise ValueError(f"share must be in [{2 * ERROR / MOST_TRACKED:g}, 1]")
    limit = int(2 / share)
    tracked = min(MOST_TRACKED, max(1 << ceil(2 * ERROR / share).bit_length(), limit))
    partial = (
        df.select(*keys)
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("__node"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.expr(f"approx_top_k_accumulate(`{k}`, {tracked})").alias(f"k{i}") for i, k in enumerate(keys)],
        )
    )
    row = partial.groupBy(F.lit(0).alias("__root")).agg(  # unlike a bare agg, no row at all for an empty table
        F.sum("n").alias("n"),
        *[
            F.expr(f"approx_top_k_estimate(approx_top_k_combine(k{i}, {tracked}), {limit})").alias(f"k{i}")
            for i in range(len(keys))
        ],
    ).first()
    if row is None:
        return 0, {k: [] for k in keys}
    total = row["n"]
    return total, {
        k: [x["item"] for x in row[f"k{i}"] or [] if x["item"] is not None and x["count"] >= share * total]
        for i, k in enumerate(keys)
    }


def is_heavy(key: str, heavy: Sequence) -> Column:
    """True where ``key`` is one of the heavy values; never null."""
    if not heavy:
        return F.lit(False)
    return F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))


def salt(columns: Sequence[str], salts: int) -> Column:
    """A salt from the row's own values.

    It is as even as a random one, but the same whenever a task is run again, so that a
    lost executor can't lead to rows counted twice or not at all.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def key_counts(
    df: DataFrame, key: str, partner: str, heavy: Sequence, salts: int | None = None, distinct: bool = True
) -> DataFrame:
    """For every non-null ``key``: ``n_rows`` and, if ``distinct``, ``n_partners``.

    ``n_partners`` counts the distinct non-null values of ``partner``. Two stages for heavy
    keys: partial results by (key, salt of the partner), combined before they are shuffled,
    then merged by key; equal partners share a salt, so that the distinct counts add up. There are as many ``salts`` as
    shuffle partitions if not told otherwise.
    Light keys, each below the heavy share, take one shuffle on the key. Output: ``key``,
    ``n_rows`` LONG [, ``n_partners`` LONG], one row per key. Null keys are left out; an empty
    table gives no rows.
    """
    salts = salts or partitions(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(partner).alias("partner")).where(F.col("key").isNotNull())
    hot = is_heavy("key", heavy)
    light, dense = rows.where(~hot), rows.where(hot).withColumn("salt", salt(["partner"], salts))
    if distinct:
        light = (
            light.repartition("key")
            .groupBy("key", "partner").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("partner").alias("n_partners"))
        )
        parts = (
            dense.groupBy("key", "salt", "partner").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key", "salt").agg(F.sum("n").alias("n_rows"), F.count("partner").alias("n_partners"))
        )
        merge = [F.sum("n_rows").alias("n_rows"), F.sum("n_partners").alias("n_partners")]
    else:
        light = light.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
        parts = dense.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n_rows"))
        merge = [F.sum("n_rows").alias("n_rows")]
    if not heavy:
        return light.withColumnRenamed("key", key)
    return light.unionByName(parts.groupBy("key").agg(*merge)).withColumnRenamed("key", key)


#: How an aggregate of the rows is merged from the partial results of the salts.
MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bit_and": F.bit_and}


def salted_aggregate(
    df: DataFrame,
    key: str,
    aggregates: dict[str, tuple[str, str]],
    salt_on: Sequence[str],
    share: float | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Mergeable aggregates for every ``key``, whatever share of the rows a key has.

    ``aggregates``: output name to (function of MERGES, column). The rows of a heavy key are
    spread by ``salt_on``, aggregated by (key, salt), then merged. A null key is a group of its
    own, as in ``groupBy``, and is always salted; null values are ignored, as by Spark's
    aggregates (a count of nulls is 0, the others null). Output names that clash with the key
    are refused. An empty table gives no rows.
    """
    unknown = {f for f, _ in aggregates.values()} - MERGES.keys()
    if unknown:
        raise ValueError(f"not mergeable: {', '.join(sorted(unknown))}")
    if key in aggregates:
        raise ValueError(f"output name clashes with the key: {key}")
    _, found = heavy_keys(df, [key], share)
    hot = is_heavy(key, found[key]) | F.col(key).isNull()
    rows = df.select(
        F.col(key).alias("__key"),
        F.when(hot, salt(list(salt_on), salts or partitions(df.sparkSession))).otherwise(F.lit(0)).alias("__salt"),
        *[F.col(c).alias(f"__{i}") for i, (_, c) in enumerate(aggregates.values())],
    )
    parts = rows.groupBy("__key", "__salt").agg(
        *[getattr(F, f)(f"__{i}").alias(n) for i, (n, (f, _)) in enumerate(aggregates.items())]
    )
    out = parts.groupBy("__key").agg(*[MERGES[f](n).alias(n) for n, (f, _) in aggregates.items()])
    return out.withColumnRenamed("__key", key)
