"""Reads and index entries from Parquet, with their schemas checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.runtime import require_columns, small

_TEXTS = (T.StringType, T.BinaryType)


def check_reads(df: DataFrame) -> DataFrame:
    """``id`` LONG, ``sequence`` and, if there, ``pair_sequence`` as text; other types are refused, nulls kept."""
    require_columns(df, "id", "sequence")
    kinds = {f.name: f.dataType for f in df.schema}
    if not isinstance(kinds["id"], T.LongType):
        raise TypeError(f"id must be LONG, not {kinds['id'].simpleString()}")
    texts = [c for c in ("sequence", "pair_sequence") if c in kinds]
    for c in texts:
        if not isinstance(kinds[c], _TEXTS):
            raise TypeError(f"{c} must be STRING or BINARY, not {kinds[c].simpleString()}")
    return df.select("id", *[F.col(c).cast("string") for c in texts])


def refuse_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` whose rows raise an error where one of the columns is null."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"null {c}")).cast(df.schema[c].dataType)))
    return df


def read_parquet_reads(spark: SparkSession, path: str) -> DataFrame:
    """``read_id``, ``sequence1``, ``sequence2`` (null where the file has none), only these columns read."""
    df = spark.read.parquet(path)
    require_columns(df, "read_id", "sequence1")
    for c in ("read_id", "sequence1", "sequence2"):
        if c in df.columns and not isinstance(df.schema[c].dataType, T.StringType):
            raise TypeError(f"{c} must be STRING, not {df.schema[c].dataType.simpleString()}")
    mate = F.col("sequence2") if "sequence2" in df.columns else F.lit(None).cast("string")
    return df.select("read_id", "sequence1", mate.alias("sequence2"))


def number_rows(spark: SparkSession, path: str) -> DataFrame:
    """``id`` LONG from 0 for every row of Parquet files, in the order of the files, beside the columns of :func:`read_parquet_reads`."""
    rows = read_parquet_reads(spark, path).withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    begins = small(sizes.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
    return rows.join(begins, "__file").select((F.col("begin") + F.col("__at")).alias("id"), "read_id", "sequence1", "sequence2")


def from_unsigned(value: Column | str) -> Column:
    """A column read from unsigned 64-bit Parquet (a decimal) as the LONG of the same pattern."""
    v = (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)")
    wrapped = v - F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(v >= F.lit("9223372036854775808").cast("decimal(20,0)"), wrapped).otherwise(v).cast("long")


def read_foreign_entries(spark: SparkSession, path: str) -> DataFrame:
    """``minimizer`` LONG, ``bucket_id`` INT from files that hold them unsigned."""
    df = spark.read.parquet(path)
    require_columns(df, "minimizer", "bucket_id")
    decimal = isinstance(df.schema["minimizer"].dataType, T.DecimalType)
    return df.select(
        (from_unsigned("minimizer") if decimal else F.col("minimizer")).alias("minimizer"), F.col("bucket_id").cast("int")
    )
