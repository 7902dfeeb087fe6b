"""Preparing reads: one row per id, mates, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.encoding import base_read_id, trim_reads  # noqa: F401
from strandlake.runtime import require_columns
from strandlake.sources.fastx import numbered, read_fastx


def latest_reads(reads: DataFrame) -> DataFrame:
    """One row per non-null ``id``: the one received last.

    Of rows received at the same time the one with the least sequence, then least mate, stays (nulls first); rows
    without a time come after all others. Other columns stay as they are; an empty table gives no rows.
    """
    require_columns(reads, "id", "sequence", "received_at")
    mate = [F.asc("pair_sequence")] if "pair_sequence" in reads.columns else []
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("received_at"), F.asc("sequence"), *mate)
    ranked = reads.where(F.col("id").isNotNull()).withColumn("__rank", F.row_number().over(w))
    return ranked.where("__rank = 1").drop("__rank")


def zip_mates(first: DataFrame, second: DataFrame, strict: bool = True) -> DataFrame:
    """Two files of reads joined by ``ordinal``: ``ordinal``, ``read_id``, ``seq1``, ``qual1``, ``seq2``, ``qual2``.

    Both have ``ordinal``, ``header``, ``sequence``, ``quality``. With ``strict`` a first read without a
    mate, or one whose normalised header differs from its mate's, is an error; else such a read stays without
    a mate. Further second reads are ignored.
    """
    second = second.select(
        "ordinal", F.col("header").alias("h2"), F.col("sequence").alias("seq2"), F.col("quality").alias("qual2")
    )
    pairs = first.join(second, "ordinal", "left")
    same = base_read_id("header").eqNullSafe(base_read_id("h2"))
    if strict:
        problem = F.when(F.col("h2").isNull(), F.concat(F.lit("no mate at record "), "ordinal")).when(
            ~same, F.concat(F.lit("mates differ at record "), "ordinal")
        )
        # The check stays in the plan as part of a column that is used.
        first_sequence = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("sequence"))
    else:
        first_sequence = F.col("sequence")
        pairs = pairs.withColumns({c: F.when(same, F.col(c)) for c in ("seq2", "qual2")})
    return pairs.select(
        "ordinal", base_read_id("header").alias("read_id"), first_sequence.alias("seq1"),
        F.col("quality").alias("qual1"), "seq2", "qual2",
    )


def fastx_pairs(spark: SparkSession, first: str, second: str, strict: bool = True) -> DataFrame:
    """Two files of mates as one table of reads: ``ordinal`` and the columns of :func:`zip_mates`."""
    return zip_mates(numbered(read_fastx(spark, first)), numbered(read_fastx(spark, second)), strict)
