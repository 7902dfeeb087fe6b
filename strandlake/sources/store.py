"""An index on disk: sorted entries, the bucket table and a manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.encoding import unsigned_key
from strandlake.functions.kernels import SketchParams
from strandlake.operators.index import sorted_for_pruning
from strandlake.operators.sketch import marked

MAGIC, VERSION = "STRANDLAKE_INDEX", 1
BUCKET_COLUMNS = ("bucket_id", "bucket_name", "sources", *(f"file_stats_{s}" for s in ("mean", "median", "stdev", "min", "max")))


@dataclass(frozen=True)
class StoredIndex:
    params: SketchParams
    entries: DataFrame
    buckets: DataFrame
    manifest: dict
    path: str = ""


def source_hash(entries: DataFrame) -> int:
    """A value that tells indices apart by the sizes of their buckets; the same for the same sizes."""
    sizes = entries.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.bit_xor(F.xxhash64("bucket_id", "n")).alias("h")).first()
    return row["h"] or 0


def write_index(
    entries: DataFrame,
    buckets: DataFrame,
    path: str,
    params: SketchParams,
    partitions: int | None = None,
    compression: str = "snappy",
    bloom_fpp: float | None = None,
    max_records_per_file: int = 0,
) -> None:
    """Writes ``entries.parquet`` (in ranges of the unsigned minimizer), ``buckets.parquet``, ``files.parquet`` (what range each
    file of entries holds) and ``manifest``.

    Statistics of the column ``minimizer_key`` prune files and row groups; ``bloom_fpp`` adds bloom filters on it. An
    empty index is written and opened like any other.
    """
    if bloom_fpp is not None and not 0 < bloom_fpp < 1:
        raise ValueError(f"bloom_fpp must be in (0, 1), got {bloom_fpp}")
    spark = entries.sparkSession
    writer = (
        sorted_for_pruning(entries, partitions).write.mode("overwrite").option("compression", compression)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
        .option("maxRecordsPerFile", max_records_per_file)
    )
    if bloom_fpp is not None:
        writer = writer.option("parquet.bloom.filter.enabled#minimizer_key", "true").option(
            "parquet.bloom.filter.fpp#minimizer_key", bloom_fpp
        )
    writer.parquet(f"{path}/entries.parquet")
    buckets.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/buckets.parquet")
    written = spark.read.parquet(f"{path}/entries.parquet")
    place = F.regexp_extract("_metadata.file_path", "[^/]*$", 0)
    ranges = written.groupBy(place.alias("name")).agg(
        F.min("minimizer_key").alias("least"), F.max("minimizer_key").alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    ranges.coalesce(1).sortWithinPartitions("least").write.mode("overwrite").parquet(f"{path}/files.parquet")
    manifest = {
        "magic": MAGIC, "format_version": VERSION, "k": params.k, "w": params.w, "salt": f"0x{params.salt:016x}",
        "n_entries": written.count(), "n_minimizers": written.select("minimizer").distinct().count(),
        "n_buckets": buckets.count(), "source_hash": source_hash(written),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index at ``path``. Absent statistics of buckets are null, also where a file has none or NaN."""
    lines = spark.read.text(f"{path}/manifest").collect()
    try:
        manifest = json.loads(lines[0]["value"]) if len(lines) == 1 else {}
    except json.JSONDecodeError:
        manifest = {}
    if manifest.get("magic") != MAGIC:
        raise ValueError(f"{path} is no index")
    if manifest["format_version"] > VERSION:
        raise ValueError(f"{path} has format {manifest['format_version']}; known are those up to {VERSION}")
    params = SketchParams(manifest["k"], manifest["w"], int(manifest["salt"], 16))
    entries = marked(spark.read.parquet(f"{path}/entries.parquet"), params)
    return StoredIndex(params, entries, read_buckets(spark, f"{path}/buckets.parquet"), manifest, path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    for c in BUCKET_COLUMNS[3:]:
        value = F.when(~F.isnan(c), F.col(c)) if c in df.columns else F.lit(None).cast("double")
        df = df.withColumn(c, value)
    return df.select(*BUCKET_COLUMNS)


def check_compatible(*indices: StoredIndex) -> None:
    """Indices used together must have the same k, w and salt."""
    kinds = {i.params for i in indices}
    if len(kinds) > 1:
        raise ValueError(f"indices differ in their parameters: {', '.join(sorted(map(str, kinds)))}")


def entries_for(index: StoredIndex, sketch: DataFrame, max_files: int = 100_000) -> DataFrame:
    """The entries in those files of ``index`` whose ranges hold a minimizer of ``sketch``; the other files aren't read.

    Each minimizer is looked up among the beginnings of the files, of which a list is sent along if there are at most ``max_files``;
    with more, or if the sketch needs all of them, all are read. ``sketch`` is read once more, so it should be a written table.
    """
    spark = sketch.sparkSession
    files = spark.read.parquet(f"{index.path}/files.parquet").orderBy("least").limit(max_files + 1).collect()
    if not files or len(files) > max_files:
        return index.entries
    least, greatest = (np.array([f[c] for f in files], np.int64) for c in ("least", "greatest"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        touched = np.zeros(len(least), bool)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            # A minimizer of many buckets may end one file and begin the next.
            last, first = np.searchsorted(least, keys, "right"), np.searchsorted(greatest, keys, "left")
            steps = np.zeros(len(least) + 1, np.int64)
            within = first < last
            np.add.at(steps, first[within], 1)
            np.add.at(steps, last[within], -1)
            touched |= np.cumsum(steps)[:-1] > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(touched).astype(np.int64))], names=["file"])

    found = sketch.select(unsigned_key("minimizer").alias("key")).mapInArrow(look_up, "file long").distinct().collect()
    if len(found) == len(files):
        return index.entries
    names = [f"{index.path}/entries.parquet/{files[r['file']]['name']}" for r in found]
    if not names:
        return index.entries.limit(0)
    return marked(spark.read.schema(index.entries.schema).parquet(*names), index.params)


def in_range_of(entries: DataFrame, sketch: DataFrame) -> DataFrame:
    """``entries`` between the least and greatest minimizer of ``sketch`` (unsigned), so that files outside aren't read."""
    key = unsigned_key("minimizer")
    row = sketch.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if row["a"] is None:
        return entries.limit(0)
    return entries.where(F.col("minimizer_key").between(row["a"], row["b"]))
