"""Queries on indices, classification, orientation and log-ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.encoding import fixed4, log_ratio_label, orientation, overlap
from strandlake.functions.kernels import FORWARD, REVERSE
from strandlake.operators import classify as c
from strandlake.operators import index as ix
from strandlake.operators import logratio as lr
from strandlake.operators import orientation as ori
from strandlake.operators.sketch import minimizers
from strandlake.plans.sketch_queries import SMALL, bucket_ids, features_of, pieces_of, reads_of
from strandlake.runtime import cut, small, table

#: Buckets whose name ends so are the negative reference and one side of merges and log-ratios.
PLASMID = "%plasmid"
#: A score that reads attain, for the boundary case; and the numerator score from which the denominator is skipped.
EDGE, SKIP = 0.25, 0.1
#: The pooled index of a log-ratio has one bucket.
POOLED = 1
#: Bucket columns that the wide form has at least, as its SQL lists them; more buckets have more columns.
WIDE_LEAST = 64


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_index(pieces_of(spark, sf_dir), SMALL)


def _plasmids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(bucket_ids(spark, sf_dir).where(F.col("bucket_name").like(PLASMID)).select("bucket_id"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index of plasmid buckets and that of the others, from one built once."""
    index, plasmids = cut(_index(spark, sf_dir)), _plasmids(spark, sf_dir)
    return index.join(plasmids, "bucket_id", "left_semi"), index.join(plasmids, "bucket_id", "left_anti")


def _buckets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The buckets of the two sides that have whole features."""
    buckets = features_of(spark, sf_dir).select("bucket_id", "bucket_name").distinct()
    plasmid = F.col("bucket_name").like(PLASMID)
    return [buckets.where(plasmid), buckets.where(~plasmid)]


def _pooled(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two sides as indices of one bucket each, from one built once."""
    side = F.when(F.col("bucket_name").like(PLASMID), 0).otherwise(1)
    both = cut(ix.build_index(pieces_of(spark, sf_dir).withColumn("bucket_id", side), SMALL))
    return [both.where(F.col("bucket_id") == k).withColumn("bucket_id", F.lit(POOLED)) for k in (0, 1)]


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


def index_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.sorted_for_pruning(_index(spark, sf_dir))


def index_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.consolidate(ix.valid_entries(table(spark, sf_dir, "index_shard"), table(spark, sf_dir, "bucket_dim")))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_stats(index_consolidate(spark, sf_dir))


def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and the unsigned range of the minimizers of each raw shard."""
    entries = table(spark, sf_dir, "index_shard").where("minimizer IS NOT NULL AND bucket_id IS NOT NULL")
    least, most = (ix.unsigned_key(f(ix.unsigned_key("minimizer"))) for f in (F.min, F.max))
    return entries.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_entries"), least.alias("min_minimizer"), most.alias("max_minimizer")
    )


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.bucket_stats(index_consolidate(spark, sf_dir))


def bucket_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ix.bucket_dimension(features_of(spark, sf_dir))
    return built.withColumn("sources", F.array_join("sources", ","))


def bucket_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.bucket_sources(table(spark, sf_dir, "bucket_dim"))


def file_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over plain numbers: quantities of the orders by return flag."""
    return ix.file_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity")


def build_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    plasmids, others = _sides(spark, sf_dir)
    return ix.subtract(others, plasmids).select(*ix.PAIR)


def _merge(spark: SparkSession, sf_dir: str, subtract: bool) -> DataFrame:
    return ix.merge_indices(*_sides(spark, sf_dir), ix.merged_ids(*_buckets(spark, sf_dir)), subtract)


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, False)


def merge_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, True)


def merge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.merged_ids(*_buckets(spark, sf_dir))


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plasmids, others = _sides(spark, sf_dir)
    return ix.merge_counts(others, plasmids)


def _sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.query_sketch(reads_of(spark, sf_dir), SMALL)


def query_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.query_totals(_sketch(spark, sf_dir))


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.hit_counts(_sketch(spark, sf_dir), _index(spark, sf_dir))


def _classify(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return c.classify(reads_of(spark, sf_dir), _index(spark, sf_dir), SMALL, unique_ids=True, **options)


def classify_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.named(_classify(spark, sf_dir), bucket_ids(spark, sf_dir))


def classify_threshold_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classify(spark, sf_dir, threshold=EDGE)


def classify_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold 0: every pair with a hit, none without."""
    return _classify(spark, sf_dir, threshold=0.0)


def classify_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classify(spark, sf_dir, best_hit=True)


def classify_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classify(spark, sf_dir, pair="pair_sequence")


def classify_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(_index(spark, sf_dir))
    plasmids = index.join(_plasmids(spark, sf_dir), "bucket_id", "left_semi")
    return c.classify(reads_of(spark, sf_dir), index, SMALL, unique_ids=True, negative=plasmids)


def classify_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for every bucket of the data, whose ids go from 1 without gaps."""
    highest = bucket_ids(spark, sf_dir).agg(F.max("bucket_id")).first()[0] or 0
    return c.wide(_classify(spark, sf_dir, threshold=0.0), range(1, max(WIDE_LEAST, highest) + 1))


def classify_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text form: the score with four decimals."""
    return classify_long(spark, sf_dir).select("query_id", "bucket_name", fixed4("score").alias("score"))


def aggregate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.aggregate(reads_of(spark, sf_dir), _index(spark, sf_dir), SMALL)


def semi_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.hitting_minimizers(_sketch(spark, sf_dir), _index(spark, sf_dir))


def anti_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.query_sketch(reads_of(spark, sf_dir), SMALL, negative=_index(spark, sf_dir))


def bucket_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward minimizers of all reads, repeats counted, in each bucket of the raw index."""
    return c.bucket_hits(_sketch(spark, sf_dir).where(f"strand = {FORWARD}"), _index(spark, sf_dir))


def best_hits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits of results that were scored elsewhere, with all their dirt."""
    listed = table(spark, sf_dir, "bucket_dim").select("bucket_id").distinct()
    hits = table(spark, sf_dir, "hits").where("score >= 0 AND score <= 1 AND NOT isnan(score)")
    return c.best_hits(hits.join(small(listed), "bucket_id", "left_semi"))


def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of both strands of each feature with the forward sketch of its bucket's first feature."""
    features = pieces_of(spark, sf_dir)
    sketches = cut(minimizers(features, SMALL, ["bucket_id", "feature_idx"]).distinct())  # read twice
    base = sketches.where(f"strand = {FORWARD}").join(ori.baselines(features), ["bucket_id", "feature_idx"], "left_semi")
    marked = sketches.join(base.select("bucket_id", "minimizer", F.lit(1).alias("known")), ["bucket_id", "minimizer"], "left")

    def share(strand: int):
        own = F.col("strand") == strand
        return overlap(F.count(F.when(own, F.col("known"))), F.count(F.when(own, 1)))

    shares = marked.groupBy("bucket_id", "feature_idx").agg(share(FORWARD).alias("fwd_overlap"), share(REVERSE).alias("rc_overlap"))
    return shares.withColumn("orientation", orientation("fwd_overlap", "rc_overlap"))


def orientation_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a sample of 20 minimizers, so that the samples matter at this size."""
    features = pieces_of(spark, sf_dir)
    sketches = cut(minimizers(features, SMALL, ["bucket_id", "feature_idx"]).distinct())
    return ori.choose_strands(sketches, ori.baselines(features), 20)


def orient_fixed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ori.build_oriented(pieces_of(spark, sf_dir), SMALL)


def orient_growing_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ori.build_growing(features_of(spark, sf_dir), SMALL)


def _log_ratio(spark: SparkSession, sf_dir: str, skip: float | None) -> DataFrame:
    return lr.log_ratio(reads_of(spark, sf_dir), *_pooled(spark, sf_dir), SMALL, skip, unique_ids=True)


def _shown(ratios: DataFrame) -> DataFrame:
    """Special values as text, finite ones as numbers."""
    special = F.isnan("log_ratio") | F.col("log_ratio").isin(float("inf"), float("-inf"))
    return ratios.select(
        "query_id", F.when(special, fixed4("log_ratio")).otherwise("finite").alias("kind"),
        F.when(~special, F.col("log_ratio")).alias("log_ratio"), "fast_path", lr.fast_path_code().alias("fast_path_code"),
        log_ratio_label(F.lit("plasmids"), F.lit("others")).alias("bucket_name"),
    )


def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_log_ratio(spark, sf_dir, None))


def log_ratio_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_log_ratio(spark, sf_dir, SKIP))


def log_ratio_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_of(spark, sf_dir)
    return lr.passing_reads(reads, _log_ratio(spark, sf_dir, None)).select("id", "sequence")


def log_ratio_passing_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_of(spark, sf_dir)
    return lr.passing_reads(reads, _log_ratio(spark, sf_dir, SKIP), positive=True).select("id", "sequence")


_ALL = (
    index_build, index_sorted, index_consolidate, index_stats, shard_stats, bucket_stats, bucket_dimension, bucket_sources,
    file_stats_orders, build_subtract, merge_union, merge_subtract, merge_remap, merge_counts, query_totals, hit_counts,
    classify_long, classify_threshold_edge, classify_all_hits, classify_best_hit, classify_paired, classify_negative,
    classify_wide, classify_formatted, aggregate_global, semi_hits, anti_hits, bucket_hits, best_hits_table, overlap_ratio,
    orientation_sampled, orient_fixed_build, orient_growing_build, log_ratio, log_ratio_skip, log_ratio_passing,
    log_ratio_passing_positive,
)
QUERIES = {f.__name__: f for f in _ALL}
