"""Queries on encoding, sketching and preparing sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.encoding import (
    base_read_id,
    complement_bits,
    count_hits,
    intersection_size,
    pack_bits,
    reverse_complement,
    ry_bits,
    sanitize_bucket_name,
    signed,
    trim_reads,
)
from strandlake.functions.kernels import SketchParams
from strandlake.operators import chunks
from strandlake.operators.reads import latest_reads, zip_mates
from strandlake.operators.sketch import minimizer_sets, minimizers, ordered_minimizers, register, strand_minimizers
from strandlake.runtime import table

SMALL = SketchParams(16, 8)
K32, K64 = SketchParams(32, 10), SketchParams(64, 50)
HIGH_SALT = SketchParams(64, 20, 0xF00000000000ABCD)


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_reads(table(spark, sf_dir, "read_records")).select("id", "read_id", "sequence", "pair_sequence")


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.features_in_buckets(table(spark, sf_dir, "genome_chunks"), table(spark, sf_dir, "feature_map"))


def pieces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features in overlapping pieces, for sketches with the parameters SMALL."""
    return chunks.features_in_buckets(table(spark, sf_dir, "genome_chunks"), table(spark, sf_dir, "feature_map"), pieces_for=SMALL)


def ry_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = ry_bits("sequence")
    return reads_of(spark, sf_dir).where("sequence IS NOT NULL").select(
        "id",
        F.length(F.regexp_replace(bits, "[^01]", "")).alias("n_valid"),
        F.length(F.regexp_replace(bits, "[^1]", "")).alias("n_purine"),
        complement_bits(bits).alias("rc_bits"),
    )


def _kmers(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every valid k-mer by expressions alone."""
    reads = reads_of(spark, sf_dir).select("id", ry_bits("sequence").alias("bits")).where(F.length("bits") >= k)
    at = reads.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("bits") - k)))
    return at.select("id", "pos", F.substring("bits", F.col("pos") + 1, k).alias("s")).where(~F.col("s").rlike("[^01]"))


def kmer_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.lit(signed(SMALL.salt))
    return _kmers(spark, sf_dir, 16).select(
        "id", "pos", pack_bits("s").bitwiseXOR(salt).alias("h_fwd"),
        pack_bits(complement_bits("s")).bitwiseXOR(salt).alias("h_rc"),
    )


def kmer_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _kmers(spark, sf_dir, 64).select("id", "pos", pack_bits("s").alias("kmer"))
    return packed.withColumn("rc", reverse_complement("kmer", 64))


def _sets(spark: SparkSession, sf_dir: str, params: SketchParams, pair: str | None = None) -> DataFrame:
    return minimizers(reads_of(spark, sf_dir), params, ["id"], pair=pair)


def minimizer_set_k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, SMALL)


def minimizer_set_k32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, K32)


def minimizer_set_k64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, K64)


def minimizer_high_salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, HIGH_SALT)


def paired_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, SMALL, "pair_sequence")


def minimizer_sets_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and the least and greatest minimizers (unsigned) of the two array columns."""
    sets = minimizer_sets(reads_of(spark, sf_dir), HIGH_SALT, ["id"])
    return sets.select(
        "id", F.size("fwd_set").alias("n_fwd"), F.size("rc_set").alias("n_rc"),
        F.get("fwd_set", F.lit(0)).alias("fwd_least"), F.get("rc_set", F.size("rc_set") - 1).alias("rc_greatest"),
    )


def minimizer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = strand_minimizers(reads_of(spark, sf_dir), SMALL, ["id"])

    def one(strand: int, name: str) -> DataFrame:
        zipped = F.inline(F.arrays_zip(F.col(f"{name}_hashes").alias("minimizer"), F.col(f"{name}_positions").alias("pos")))
        return both.select("id", F.lit(strand).alias("strand"), zipped)

    return one(0, "fwd").unionByName(one(1, "rc"))


def minimizer_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_minimizers(reads_of(spark, sf_dir), SMALL, ["id"])


def minimizer_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set through the SQL table function."""
    register(spark)
    reads_of(spark, sf_dir).createOrReplaceTempView("reads_for_udtf")
    return spark.sql(
        "SELECT id, m.strand, m.minimizer FROM reads_for_udtf, "
        f"LATERAL minimizers(sequence, 32, 10, {signed(K32.salt)}L) m"
    )


def trim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trim_reads(reads_of(spark, sf_dir), pair="pair_sequence", trim_to=100, min_length=120)
    return kept.select("id", "sequence", F.length("pair_sequence").alias("pair_length"))


def read_id_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spark, sf_dir).select("id", base_read_id("read_id").alias("base_id"))


def mates_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and mates as two files in the order of their ids, zipped again."""
    reads = reads_of(spark, sf_dir).withColumn("quality", F.lit(None).cast("string"))
    first = reads.select(F.col("id").alias("ordinal"), F.col("read_id").alias("header"), "sequence", "quality")
    second = reads.where("pair_sequence IS NOT NULL").select(
        F.col("id").alias("ordinal"), F.col("read_id").alias("header"), F.col("pair_sequence").alias("sequence"), "quality"
    )
    return zip_mates(first, second, strict=False).select("ordinal", "read_id", "seq1", "seq2")


def reads_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spark, sf_dir)


def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature_map").select("bucket_name").distinct().select(
        "bucket_name", sanitize_bucket_name("bucket_name").alias("clean")
    )


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_report(table(spark, sf_dir, "genome_chunks"))


def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.reassemble(table(spark, sf_dir, "genome_chunks"))


def feature_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.feature_buckets(table(spark, sf_dir, "feature_map"))


def bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.bucket_ids(chunks.feature_buckets(table(spark, sf_dir, "feature_map")))


def grouped_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of the bucket table, dealt to seven buckets by the bucket's name as label."""
    files = table(spark, sf_dir, "bucket_dim").select(F.explode("sources").alias("file_path"), F.col("bucket_name").alias("group_label"))
    return chunks.split_into_buckets(files, 7).select("file_path", "group_label", "bucket_name")


def set_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of both strands of every feature in the sketch of the feature 1; none if it isn't whole or mapped."""
    return _pairs_with_first(spark, sf_dir).select(
        "feature_idx",
        count_hits("fwd_set", "base").cast("long").alias("hits"),
        intersection_size("fwd_set", "base").cast("long").alias("shared"),
        intersection_size("rc_set", "base").cast("long").alias("rc_shared"),
    )


def _pairs_with_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = minimizer_sets(features_of(spark, sf_dir), SMALL, ["feature_idx"]).withColumn("of", F.lit(1))
    base = sets.where("feature_idx = 1").select(F.col("of"), F.col("fwd_set").alias("base"))
    joined = sets.join(F.broadcast(base), "of", "left")  # one row at most
    return joined.withColumn("base", F.coalesce("base", F.array().cast("array<long>")))


QUERIES = {
    f.__name__: f
    for f in (
        ry_encode, kmer_hashes, kmer_reverse_complement, minimizer_set_k16, minimizer_set_k32, minimizer_set_k64,
        minimizer_high_salt, paired_set, minimizer_sets_arrays, minimizer_positions, minimizer_ordered,
        minimizer_table_function, trim_filter, read_id_normalise, mates_zip, reads_latest, sanitize_names, chunk_report,
        chunk_reassembly, feature_buckets, bucket_ids, grouped_buckets, set_intersections,
    )
}
