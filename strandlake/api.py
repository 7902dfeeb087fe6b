"""From files to files: reading, classifying and writing in one call each, with the options checked together.

An index is the path of one written by :mod:`strandlake.operators.pipeline`. Reads are FASTA, FASTQ or Parquet; results go where
:func:`strandlake.sinks.results.write_results` puts them. Sequences are cut and sieved before anything else looks at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.encoding import base_read_id, log_ratio_label, trim_reads
from strandlake.operators import classify as c
from strandlake.operators import index as ix
from strandlake.operators import logratio as lr
from strandlake.operators.reads import fastx_pairs
from strandlake.runtime import cut, small
from strandlake.sinks.results import output_format, sequence_format, write_results, write_sequences
from strandlake.sources.fastx import numbered, read_fastx
from strandlake.sources.store import StoredIndex, check_compatible, entries_for, open_index
from strandlake.sources.tables import number_rows

_READS = ("id", "read_id", "sequence", "quality", "pair_sequence", "pair_quality")


def read_reads(
    spark: SparkSession, path: str, mates: str | None = None, trim_to: int | None = None, min_length: int | None = None
) -> DataFrame:
    """Reads of any kind of file: ``id`` (numbers the rows), ``read_id``, ``sequence``, ``quality``, ``pair_sequence``, ``pair_quality``.

    Parquet holds its mates itself, so a file of mates beside it is an error. Mates are paired by their places, and their
    names have to agree.
    """
    nothing = F.lit(None).cast("string")
    if path.rstrip("/").endswith(".parquet"):
        if mates is not None:
            raise ValueError("reads in Parquet have their mates in the same file")
        rows = number_rows(spark, path)
        reads = rows.select(
            F.col("id"), F.col("read_id"), F.col("sequence1").alias("sequence"), nothing.alias("quality"),
            F.col("sequence2").alias("pair_sequence"), nothing.alias("pair_quality"),
        )
    elif mates is None:
        rows = numbered(read_fastx(spark, path))
        sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
        begins = small(sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
        reads = rows.join(begins, "file").select(
            (F.col("begin") + F.col("ordinal")).alias("id"), base_read_id("header").alias("read_id"), "sequence", "quality",
            nothing.alias("pair_sequence"), nothing.alias("pair_quality"),
        )
    else:
        reads = fastx_pairs(spark, path, mates).select(
            F.col("ordinal").alias("id"), "read_id", F.col("seq1").alias("sequence"), F.col("qual1").alias("quality"),
            F.col("seq2").alias("pair_sequence"), F.col("qual2").alias("pair_quality"),
        )
    return trim_reads(reads, pair="pair_sequence", trim_to=trim_to, min_length=min_length).select(*_READS)


def _named(rows: DataFrame, reads: DataFrame) -> DataFrame:
    return rows.join(reads.select(F.col("id").alias("query_id"), "read_id"), "query_id")


def classify(
    spark: SparkSession,
    index: str,
    reads: str,
    output: str | None = None,
    mates: str | None = None,
    threshold: float | None = None,
    negative: str | None = None,
    best_hit: bool = False,
    wide: bool = False,
    trim_to: int | None = None,
    min_length: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Hits of the reads in the index, written to ``output``: ``read_id``, ``bucket_name``, ``score``.

    The best hit and the wide form look at all hits, whatever their score: they take a threshold of 0, and the wide form is an
    error with any other but the usual one. The wide form has a column for each bucket, named as it is, in the order of the ids, and a row for
    each read with a hit. The indices must agree in their parameters. Returns what was written.
    """
    if wide and threshold is not None and abs(threshold - c.THRESHOLD) > 1e-9:
        raise ValueError("the wide form shows every score; it takes no threshold")
    c.check_threshold(c.THRESHOLD if threshold is None else threshold)
    output_format(output, kind)
    least = 0.0 if wide or best_hit else c.THRESHOLD if threshold is None else threshold
    stored = open_index(spark, index)
    filtered = None
    if negative is not None:
        filtered = open_index(spark, negative)
        check_compatible(stored, filtered)
    rows = read_reads(spark, reads, mates, trim_to, min_length)
    sketch = cut(c.query_sketch(rows, stored.params, "pair_sequence", filtered and filtered.entries, unique_ids=True))
    hits = c.scores(sketch, entries_for(stored, sketch), least)
    if best_hit:
        hits = c.best_hits(hits)
    if wide:
        names = {r["bucket_id"]: r["bucket_name"] for r in stored.buckets.select("bucket_id", "bucket_name").collect()}
        table = c.wide(hits, list(names))
        shown = _named(table, rows).select("read_id", *[F.col(f"bucket_{b}").alias(names[b]) for b in sorted(names)])
        scores = [names[b] for b in sorted(names)]
    else:
        shown = _named(c.named(hits, stored.buckets), rows).select("read_id", "bucket_name", "score")
        scores = ["score"]
    shown = cut(shown)
    write_results(shown, output, scores, kind=kind)
    return shown


def aggregate(spark: SparkSession, index: str, reads: str, output: str | None = None, mates: str | None = None,
              threshold: float = c.POOLED_THRESHOLD, negative: str | None = None, kind: str | None = None) -> DataFrame:
    """All reads as one query: ``query_name``, ``bucket_name``, ``score``."""
    output_format(output, kind)
    stored = open_index(spark, index)
    filtered = None if negative is None else open_index(spark, negative)
    check_compatible(stored, *[filtered] if filtered else [])
    pooled = c.aggregate(
        read_reads(spark, reads, mates), stored.entries, stored.params, threshold, "pair_sequence", filtered and filtered.entries
    )
    named = c.named(pooled.withColumnRenamed("query_name", "query_id"), stored.buckets)
    shown = cut(named.withColumnRenamed("query_id", "query_name"))
    write_results(shown, output, kind=kind)
    return shown


def _single(index: StoredIndex) -> str:
    """The name of the only bucket."""
    names = index.buckets.select("bucket_name").limit(2).collect()
    if len(names) != 1:
        raise ValueError(f"{index.path}: an index for log-ratios must have exactly one bucket")
    return names[0]["bucket_name"]


def log_ratio(
    spark: SparkSession,
    numerator: str,
    denominator: str,
    reads: str,
    output: str | None = None,
    mates: str | None = None,
    skip: float | None = None,
    output_sequences: str | None = None,
    passing_is_positive: bool = False,
    trim_to: int | None = None,
    min_length: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """The log-ratio of every read, written to ``output``: ``read_id``, ``bucket_name``, ``score``, ``fast_path``.

    Each index has one bucket, and they agree in their parameters. ``skip`` lies above 0 and is at most 1. The reads that pass
    go to ``output_sequences``, whole, so that reads can't be cut at the same time.
    """
    if skip is not None and not 0 < skip <= 1:
        raise ValueError(f"a numerator is high from a score above 0 and up to 1, not from {skip}")
    output_format(output, kind)
    if output_sequences is not None:
        sequence_format(output_sequences)
        if trim_to is not None:
            raise ValueError("reads that are cut can't be written as sequences")
    over, under = open_index(spark, numerator), open_index(spark, denominator)
    names = _single(over), _single(under)
    check_compatible(over, under)
    rows = read_reads(spark, reads, mates, trim_to, min_length)
    ratios = cut(lr.log_ratio(rows, over.entries, under.entries, over.params, skip, "pair_sequence", unique_ids=True))
    label = log_ratio_label(F.lit(names[0]), F.lit(names[1])).alias("bucket_name")
    shown = cut(_named(ratios, rows).select("read_id", label, F.col("log_ratio").alias("score"), "fast_path"))
    write_results(shown, output, kind=kind)
    if output_sequences is not None:
        paired = ["pair_sequence"] if mates is not None or reads.rstrip("/").endswith(".parquet") else []
        kept = lr.passing_reads(rows, ratios, passing_is_positive)
        write_sequences(kept, output_sequences, sequences=["sequence", *paired], qualities=["quality", "pair_quality"][: 1 + len(paired)])
    return shown


def index_stats(spark: SparkSession, index: str) -> DataFrame:
    """One row of figures on the index, as by :func:`strandlake.operators.index.index_stats`."""
    return ix.index_stats(open_index(spark, index).entries)


def bucket_source_detail(spark: SparkSession, index: str, bucket: str, paths: bool = False, ids: bool = False) -> DataFrame:
    """The ``source`` labels of a bucket (by id or name); with ``paths`` their files, ``path``; with ``ids`` all ``bucket_id``s in order."""
    if paths and ids:
        raise ValueError("either paths or ids are shown")
    buckets = open_index(spark, index).buckets
    number = ix.resolve_bucket(buckets, bucket)
    own = buckets.where(F.col("bucket_id") == number)
    if own.isEmpty():
        raise ValueError(f"{index} has no bucket {number}")
    if ids:
        return buckets.select("bucket_id").orderBy("bucket_id")
    if paths:
        return ix.bucket_sources(own).select("path")
    return own.select(F.explode("sources").alias("source"))
