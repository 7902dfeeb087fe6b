"""The pN queries of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.kernels import SketchParams
from strandlake.llm.mixing import clean, mix
from strandlake.llm.ngrams import ngram_counts, suffixes
from strandlake.llm.overlap import overlap_sizes
from strandlake.llm.packing import fill_containers
from strandlake.llm.spans import shared_shares, shared_spans, shared_windows
from strandlake.llm.splitting import split_documents
from strandlake.llm.sql import ORACLE  # noqa: F401
from strandlake.llm.tokens import with_sizes
from strandlake.llm.topn import top_per_group
from strandlake.operators.entries import valid_entries
from strandlake.operators.reads import latest_reads
from strandlake.operators.sketch import strand_minimizers
from strandlake.runtime import small, table

#: p1: overlap as a share of the smaller set. p2: items per group. p4: buckets from which on a minimizer is common.
MIN_SHARE, TOP, COMMON = 0.25, 3, 16
#: p5: letters of a span. p6: tokens of a container. p8: tokens of a piece, and those shared with the one before.
SPAN, CAPACITY, LIMIT, OVERLAP = 64, 2048, 512, 32

#: p4: how the minimizers of reads are made, and the most that follow each other in a run.
READ_TERMS, RUN = SketchParams(32, 50), 3


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_entries(table(spark, sf_dir, "index_shard"), table(spark, sf_dir, "bucket_dim"))


def _overlaps(spark: SparkSession, sf_dir: str, min_share: float = 0.0) -> DataFrame:
    return overlap_sizes(_entries(spark, sf_dir), "bucket_id", "minimizer", min_share=min_share).select(
        F.col("set_a").alias("bucket_id_a"), F.col("set_b").alias("bucket_id_b"), "n_both", "n_a", "n_b"
    )


def p1_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two buckets that share a minimizer, with the overlap and both sizes."""
    return _overlaps(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir, MIN_SHARE).select("bucket_id_a", "bucket_id_b")


def _top(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    listed = table(spark, sf_dir, "bucket_dim").select("bucket_id").where("bucket_id IS NOT NULL").distinct()
    hits = table(spark, sf_dir, "hits").where("query_id IS NOT NULL AND score >= 0 AND score <= 1 AND NOT isnan(score)")
    return top_per_group(hits.join(small(listed), "bucket_id", "left_semi"), "query_id", "bucket_id", "score", n)


def p2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best buckets of every query, ranked."""
    return _top(spark, sf_dir, 10)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, TOP).select("query_id", "bucket_id")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, buckets and (bucket, shard) pairs of every minimizer, and whether it tells buckets apart."""
    # A null shard is a place of its own.
    place = F.coalesce(F.col("shard_id").cast("long"), F.lit(-(2**63)))
    runs = _entries(spark, sf_dir).select(F.col("minimizer").alias("t1"), "bucket_id", place.alias("shard_id"))
    return ngram_counts(runs, ["bucket_id", "shard_id"]).select(
        F.col("t1").alias("minimizer"),
        "occurrences",
        F.col("records_1").alias("n_buckets"),
        F.col("records_2").alias("n_places"),
        F.when(F.col("records_1") >= COMMON, "common").when(F.col("records_2") == 1, "rare").otherwise("useful")
        .alias("freq_class"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_counts(spark, sf_dir).where("freq_class <> 'useful'").select("minimizer", "freq_class")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three minimizers that follow each other in the reads: their occurrences and reads."""
    reads = latest_reads(table(spark, sf_dir, "read_records"))
    terms = strand_minimizers(reads, READ_TERMS, ["id"]).select("id", "fwd_hashes")
    return ngram_counts(suffixes(terms, ["id"], "fwd_hashes", RUN), ["id"], RUN).select(
        "n", *[f"t{i + 1}" for i in range(RUN)], "occurrences", F.col("records_1").alias("n_reads"),
        F.when(F.col("records_1") >= COMMON, "common").when(F.col("records_1") == 1, "rare").otherwise("useful").alias("freq_class"),
    )


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each read that stand elsewhere, and the longest window in each that is shared whole."""
    return shared_spans(table(spark, sf_dir, "read_records"), SPAN).drop("key")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the sequences of each id also stands elsewhere."""
    reads = table(spark, sf_dir, "read_records")
    return shared_shares(reads, shared_spans(reads, SPAN)).select("id", "n_letters", "n_shared")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_windows(table(spark, sf_dir, "read_records"), SPAN).select("id").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers, with their fill."""
    return fill_containers(table(spark, sf_dir, "documents"), CAPACITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_containers(spark, sf_dir).where("is_split").select("doc_id").distinct()


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every document whatever the containers are: tokens and pieces placed, in containers that aren't overfull."""
    fill = F.sum("n_tokens").over(Window.partitionBy("container_id"))
    placed = p6_containers(spark, sf_dir).withColumn("sound", (fill == F.col("fill")) & (fill <= CAPACITY))
    return placed.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.bool_and("is_split").alias("is_split"),
        F.bool_and("sound").alias("sound"),
    )


def p7_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).draw


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every target whatever is drawn: no document used too often, the share missed by no more than the source's largest."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, table(spark, sf_dir, "mix_targets"))
    sizes = with_sizes(docs.select(clean(F.col("source")).alias("source"), "text"), "text", ["source"])
    used = mixed.draw.groupBy("source").agg(F.max("uses").alias("uses"))
    used = used.join(sizes.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source")
    most = F.col("tokens") * F.col("max_repeats")
    near = F.abs(F.col("drawn_tokens") - F.col("wanted_tokens")) <= F.coalesce("largest", F.lit(0))
    return mixed.report.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens", "reachable",
        (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"),
        F.when(F.col("reachable"), near).otherwise(F.col("drawn_tokens") == most).alias("on_target"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.col("drawn_tokens") < F.col("wanted_tokens")
    return p7_report(spark, sf_dir).where(~F.col("reachable") & short).select("source")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their positions."""
    return split_documents(table(spark, sf_dir, "documents"), LIMIT, OVERLAP)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = p8_pieces(spark, sf_dir).where("cut_line IS NOT NULL")
    return cuts.select("doc_id", F.col("cut_line").alias("line_no")).distinct()


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every document wherever it is cut: its pieces are under the limit, overlap as told, and make up the text."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    follows = F.coalesce(F.lag("token_end").over(w) == F.col("token_start") + F.col("overlap"), F.col("token_start") == 0)
    size = F.col("token_end") - F.col("token_start")
    sound = follows & (size <= LIMIT) & (F.col("overlap") <= OVERLAP) & (F.col("char_end") >= F.col("char_start"))
    return p8_pieces(spark, sf_dir).withColumn("sound", sound).groupBy("doc_id").agg(
        F.max("token_end").alias("n_tokens"), F.max("char_end").alias("n_chars"),
        (F.count(F.lit(1)) == 1).alias("is_whole"), F.bool_and("sound").alias("sound"),
    )


_ALL = [
    p1_found, p1_overlaps, p2_found, p2_top, p4_found, p4_counts, p4_runs, p5_found, p5_spans, p5_shares,
    p6_found, p6_containers, p6_documents, p7_found, p7_draw, p7_report, p7_shares, p8_found, p8_pieces, p8_limits,
]
QUERIES = {f.__name__: f for f in _ALL}
