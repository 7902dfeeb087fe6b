"""The best few items of every group, whatever the sizes of the groups.

Hot-cold split: groups whose exact number of items is at least a given share of all are hot, by default a quarter of
a mean shuffle partition. Cold groups take one shuffle on the group and an ordinary window, before which each task keeps only
the best few of its own. Hot groups are cut into
ranges of the score, which are the salts: their counts tell which ranges can hold a top item and
how many items stand before each, so every range is sorted by itself and no task ever sees
a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.skew import heavy_share, is_heavy
from strandlake.runtime import cut, require_columns

#: Ranges of the score in which a hot group is cut.
RANGES = 32


def _hot_groups(best: DataFrame, share: float) -> list:
    """Groups with at least ``share`` of the rows, by exact counts; there are at most 1 / share."""
    total = best.count()
    counts = best.groupBy("g").count()
    return [r["g"] for r in counts.where(F.col("count") >= share * total).collect()] if total else []


def top_per_group(
    df: DataFrame, group: str, item: str, score: str, n: int, share: float | None = None, ranges: int = RANGES
) -> DataFrame:
    """The ``n`` items with the highest score in every group, with their rank from 1.

    An item counts once per group, with its highest score; equal scores go to the lower item, so
    the order is total and the same on every run. Output: the three columns and ``rank`` INT. Rows
    with a null group, item or score or a NaN score are left out; infinite scores take part,
    -0.0 equals 0.0; other columns are ignored; an empty table gives no rows.
    """
    require_columns(df, group, item, score)
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s")
    ).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    # One row per item, combined before the shuffle and written once: all that follows reads this.
    best = cut(rows.groupBy("g", "i").agg(F.max("s").alias("s")))
    hot = _hot_groups(best, heavy_share(df.sparkSession) if share is None else share)
    order = [F.desc("s"), F.asc("i")]

    cold = best.where(~is_heavy("g", hot))
    top = cold.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(f"rank <= {n}")

    if hot:
        dense = best.where(is_heavy("g", hot))
        steps = [k / ranges for k in range(1, ranges)]
        # At most 1 / share hot groups, so that both tables below have a proven bound.
        bounds = dense.groupBy("g").agg(F.percentile_approx("s", steps).alias("bounds"))
        ranged = dense.join(F.broadcast(bounds), "g").select(
            "g", "i", "s", F.size(F.filter("bounds", lambda b: b > F.col("s"))).alias("r")
        )
        before = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            ranged.groupBy("g", "r").count()
            .select("g", "r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
            .where(f"offset < {n}")
        )
        sorted_ranges = (
            ranged.join(F.broadcast(offsets), ["g", "r"])
            .withColumn("rn", F.row_number().over(Window.partitionBy("g", "r").orderBy(*order)))
            .where(f"rn <= {n}")
            .withColumn("rank", (F.col("offset") + F.col("rn")).cast("int"))
            .where(f"rank <= {n}")
        )
        top = top.unionByName(sorted_ranges.select("g", "i", "s", "rank"))
    return top.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
