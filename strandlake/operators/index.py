"""The inverted index: distinct (minimizer, bucket) pairs, and the dimension of its buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.encoding import source_label, source_path, unsigned_key
from strandlake.functions.kernels import FORWARD, SketchParams
from strandlake.operators.chunks import MAX_BUCKETS
from strandlake.operators.entries import valid_entries  # noqa: F401
from strandlake.operators.sketch import minimizers, require_params
from strandlake.runtime import require_columns, small

PAIR = ["minimizer", "bucket_id"]


def consolidate(entries: DataFrame) -> DataFrame:
    """Distinct ``minimizer``, ``bucket_id``; rows with a null in either are left out. Combined before the shuffle."""
    return entries.select(*PAIR).where("minimizer IS NOT NULL AND bucket_id IS NOT NULL").dropDuplicates(PAIR)


def build_index(references: DataFrame, params: SketchParams, exclude: DataFrame | None = None) -> DataFrame:
    """The index of ``references`` (``sequence``, ``bucket_id``), forward strands only.

    ``exclude`` is an index, with the same parameters, whose minimizers are left out. Sequences without minimizers give no rows.
    """
    require_columns(references, "sequence", "bucket_id")
    if exclude is not None:
        require_params(exclude, params)
    pairs = minimizers(references, params, ["bucket_id"], strands=[FORWARD])
    index = consolidate(pairs)
    return index if exclude is None else subtract(index, exclude)


def subtract(index: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``index`` whose minimizer isn't in ``other``; a null minimizer there matches nothing."""
    return index.join(other.select("minimizer").distinct(), "minimizer", "left_anti")


def sorted_for_pruning(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """The index in ranges of the unsigned minimizer, sorted, with ``minimizer_key``.

    ``minimizer_key`` orders by signed comparison as the minimizer does by unsigned, so that min/max statistics of a
    file prune by it. Without ``partitions`` the session's number of shuffle partitions holds.
    """
    keyed = index.withColumn("minimizer_key", unsigned_key("minimizer"))
    order = ["minimizer_key", "bucket_id"]
    ranged = keyed.repartitionByRange(*([partitions] if partitions else []), *order)
    return ranged.sortWithinPartitions(*order)


def index_stats(index: DataFrame) -> DataFrame:
    """One row: ``n_entries``, ``n_minimizers``, ``n_buckets``, ``avg_buckets``, least and greatest minimizer, unsigned.

    An empty index gives zeros and nulls.
    """
    per_minimizer = index.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"))
    least, most = (f(unsigned_key("minimizer")) for f in (F.min, F.max))
    counts = per_minimizer.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"),
        F.count(F.lit(1)).alias("n_minimizers"),
        unsigned_key(least).alias("min_minimizer"),
        unsigned_key(most).alias("max_minimizer"),
    )
    buckets = index.select("bucket_id").distinct().agg(F.count(F.lit(1)).alias("n_buckets"))
    both = counts.withColumn("one", F.lit(1)).join(buckets.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("avg_buckets", F.try_divide(F.col("n_entries").cast("double"), F.col("n_minimizers")))


def bucket_stats(index: DataFrame) -> DataFrame:
    """``bucket_id``, ``n_minimizers`` of every bucket in the index."""
    return index.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n_minimizers"))


def file_stats(lengths: DataFrame, group: str, file: str, length: str) -> DataFrame:
    """By ``group``, over the total ``length`` of each ``file``: mean, median, population stdev, min, max as DOUBLE.

    The median of an even number is the mean of the middle two. Null lengths count as 0, a null file is a file
    and a null group a group of its own.
    """
    totals = lengths.groupBy(group, file).agg(F.sum(F.coalesce(F.col(length), F.lit(0))).cast("double").alias("__n"))
    return totals.groupBy(group).agg(
        F.avg("__n").alias("mean"), F.median("__n").alias("median"), F.stddev_pop("__n").alias("stdev"),
        F.min("__n").alias("min"), F.max("__n").alias("max"),
    )


def bucket_dimension(features: DataFrame) -> DataFrame:
    """The bucket table of features (``bucket_id``, ``bucket_name``, ``feature_idx``, ``sequence``).

    ``sources`` are labels ``feature_idx::<id>`` in their order, the statistics are over the features' lengths.
    """
    stats = file_stats(features.withColumn("n", F.length("sequence")), "bucket_id", "feature_idx", "n")
    for c in ("mean", "median", "stdev", "min", "max"):
        stats = stats.withColumnRenamed(c, f"file_stats_{c}")
    label = source_label(F.lit("feature_idx"), F.col("feature_idx").cast("string"))
    named = features.groupBy("bucket_id").agg(
        F.min("bucket_name").alias("bucket_name"), F.sort_array(F.collect_list(label)).alias("sources")
    )
    return named.join(stats, "bucket_id")


def bucket_sources(buckets: DataFrame) -> DataFrame:
    """``bucket_id``, ``bucket_name``, ``path``, ``n_sequences``: the files behind each bucket's source labels."""
    labels = buckets.select("bucket_id", "bucket_name", F.explode("sources").alias("label"))
    return labels.groupBy("bucket_id", "bucket_name", source_path("label").alias("path")).agg(
        F.count(F.lit(1)).alias("n_sequences")
    )


def resolve_bucket(buckets: DataFrame, identifier: str) -> int:
    """The id meant by a number, which isn't looked up, or by a bucket's exact name."""
    identifier = identifier.strip()
    if not identifier:
        raise ValueError("a bucket is named by its id or its name; neither is given")
    if identifier.isascii() and identifier.isdigit():
        return int(identifier)
    found = buckets.where(F.col("bucket_name") == identifier).select("bucket_id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no bucket is' if not found else 'several buckets are'} named {identifier}")
    return found[0][0]


def merged_ids(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """New ids for two bucket tables: ``side`` (0, 1), ``old_id``, ``bucket_name``, ``bucket_id``.

    The primary's buckets come first, each side in the order of its ids, numbered from 1 without gaps. A side has at
    most 100,000 buckets, more are an error.
    """
    sides = [b.select(F.lit(i).alias("side"), F.col("bucket_id").alias("old_id"), "bucket_name")
             for i, b in enumerate((primary, secondary))]
    rows = sides[0].unionByName(sides[1]).limit(2 * MAX_BUCKETS + 1).collect()
    if len(rows) > 2 * MAX_BUCKETS:
        raise ValueError(f"there are more than {MAX_BUCKETS} buckets in an index")
    numbered = [(*r, i) for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)), 1)]
    return primary.sparkSession.createDataFrame(numbered, "side int, old_id int, bucket_name string, bucket_id int")


def merge_indices(
    primary: DataFrame, secondary: DataFrame, ids: DataFrame, subtract_primary: bool = False
) -> DataFrame:
    """The entries of both indices under their new ``ids`` (of :func:`merged_ids`).

    With ``subtract_primary`` the secondary loses every minimizer that the primary has. Entries of buckets without a
    new id are left out. :func:`check_merge` refuses what can't be merged.
    """
    if subtract_primary:
        secondary = subtract(secondary, primary)
    ids = small(ids.select("side", "old_id", "bucket_id"))
    sides = [i.select("minimizer", F.col("bucket_id").alias("old_id"), F.lit(k).alias("side"))
             for k, i in enumerate((primary, secondary))]
    return sides[0].unionByName(sides[1]).join(ids, ["side", "old_id"]).select(*PAIR)


def check_merge(primary: DataFrame, secondary: DataFrame, kept: DataFrame | None = None) -> None:
    """Errors for bucket tables that are empty or share a name, or for a bucket of which nothing is ``kept``."""
    if primary.isEmpty() or secondary.isEmpty():
        raise ValueError("both indices must have buckets")
    shared = primary.select("bucket_name").join(secondary.select("bucket_name"), "bucket_name").limit(5).collect()
    if shared:
        raise ValueError(f"bucket names occur in both: {', '.join(r[0] for r in shared)}")
    if kept is not None:
        lost = secondary.join(kept.select("bucket_id").distinct(), "bucket_id", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"no minimizers left in: {', '.join(r['bucket_name'] for r in lost)}")


def merge_counts(secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """``bucket_id``, ``original``, ``kept``, ``removed`` of each secondary bucket when the primary is subtracted."""
    known = primary.select("minimizer").distinct().withColumn("known", F.lit(1))
    joined = secondary.join(known, "minimizer", "left")
    return joined.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("original"),
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("kept"),
        F.count("known").alias("removed"),
    )
