"""From files and configurations to stored indices: create, build from a configuration, add, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import AddConfig, IndexConfig
from strandlake.functions.encoding import sanitize_bucket_name, source_label
from strandlake.functions.kernels import SketchParams
from strandlake.operators import index as ix
from strandlake.operators.chunks import bucket_ids
from strandlake.operators.classify import aggregate
from strandlake.operators.orientation import build_growing, build_oriented
from strandlake.runtime import cut, small
from strandlake.sources.fastx import numbered, read_fastx
from strandlake.sources.store import StoredIndex, check_compatible, open_index, write_index

#: Bytes of an index entry, by which a largest size of shards is counted in entries.
ENTRY_BYTES = 12


def references(spark: SparkSession, buckets: dict[str, list[str]]) -> DataFrame:
    """The sequences of all files with their bucket: ``bucket_name``, ``file``, ``ordinal``, ``header``, ``sequence``.

    Names that become equal when cleaned are an error.
    """
    listed = [(name, file) for name, files in buckets.items() for file in files]
    names = spark.createDataFrame(listed, "bucket_name string, file string")
    _check_names(names.select("bucket_name"))
    records = numbered(read_fastx(spark, *dict.fromkeys(f for _, f in listed)))
    named = records.join(small(names), "file")
    return named.select(sanitize_bucket_name("bucket_name").alias("bucket_name"), "file", "ordinal", "header", "sequence")


def _check_names(names: DataFrame) -> None:
    clean = names.select("bucket_name", sanitize_bucket_name("bucket_name").alias("clean"))
    shared = clean.groupBy("clean").agg(F.countDistinct("bucket_name").alias("n")).where("n > 1").limit(3).collect()
    if shared:
        raise ValueError(f"different buckets would be named {', '.join(r['clean'] for r in shared)}")


def bucket_table(refs: DataFrame) -> DataFrame:
    """The bucket dimension of references that have ``bucket_id``, with statistics over the files' lengths."""
    stats = ix.file_stats(refs.withColumn("n", F.length("sequence")), "bucket_id", "file", "n")
    for c in ("mean", "median", "stdev", "min", "max"):
        stats = stats.withColumnRenamed(c, f"file_stats_{c}")
    labels = F.sort_array(F.collect_list(source_label("file", "header"))).alias("sources")
    named = refs.groupBy("bucket_id").agg(F.min("bucket_name").alias("bucket_name"), labels)
    return named.join(stats, "bucket_id")


def _with_ids(refs: DataFrame) -> DataFrame:
    return refs.join(small(bucket_ids(refs)), "bucket_name")


def create(spark: SparkSession, files: list[str], path: str, params: SketchParams, separate: bool = False, **store) -> None:
    """An index with a bucket for each file, or for each sequence with ``separate``; forward strands."""
    refs = references(spark, {f: [f] for f in files})
    if separate:
        # Headers name the buckets: equal ones, or ones that become equal, would be pooled.
        twice = refs.groupBy(sanitize_bucket_name("header").alias("name")).count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"several sequences would be bucket {', '.join(r['name'] for r in twice)}")
        refs = refs.withColumns({"bucket_name": sanitize_bucket_name("header"), "file": F.concat_ws("#", "file", "ordinal")})
    refs = _with_ids(refs)
    write_index(ix.build_index(refs, params), bucket_table(refs), path, params, **store)


def from_config(spark: SparkSession, config: IndexConfig, exclude: StoredIndex | None = None, orient: bool | None = None, **store) -> None:
    """The index of a configuration; ids go by the names of the buckets. A largest size of shards holds for the files written.

    With orientation, a bucket grows sequence by sequence; if it is the only one, its first file goes in as it is and is
    the baseline of the others.
    """
    refs = _with_ids(references(spark, config.buckets))
    if config.orient if orient is None else orient:
        order = F.struct("file", "ordinal")
        if len(config.buckets) == 1:
            ((begin, *_),) = config.buckets.values()
            placed = refs.withColumn("feature_idx", order)
            first = placed.where(F.col("file") == begin).select("bucket_id", "feature_idx")
            entries = build_oriented(placed, config.params, first=first)
        else:
            entries = build_growing(refs.withColumn("place", order), config.params, "place")
    else:
        entries = ix.build_index(refs, config.params)
    if exclude is not None:
        if exclude.params != config.params:
            raise ValueError("the index to subtract has other parameters")
        entries = ix.subtract(entries, exclude.entries)
    if config.max_shard_size:
        store.setdefault("max_records_per_file", max(1, config.max_shard_size // ENTRY_BYTES))
    write_index(entries, bucket_table(refs), config.output, config.params, **store)


def merge(spark: SparkSession, primary: str, secondary: str, path: str, subtract: bool = False, **store) -> None:
    """Two stored indices as one; the secondary's buckets get the ids after the primary's."""
    a, b = open_index(spark, primary), open_index(spark, secondary)
    check_compatible(a, b)
    kept = cut(ix.subtract(b.entries.select(*ix.PAIR), a.entries)) if subtract else None
    ix.check_merge(a.buckets, b.buckets, kept)
    ids = ix.merged_ids(a.buckets, b.buckets)
    entries = ix.merge_indices(a.entries, b.entries if kept is None else kept, ids)
    sides = [s.buckets.withColumn("side", F.lit(i)).withColumnRenamed("bucket_id", "old_id") for i, s in enumerate((a, b))]
    renamed = ids.select("side", "old_id", "bucket_id")
    buckets = sides[0].unionByName(sides[1]).join(renamed, ["side", "old_id"]).drop("side", "old_id")
    write_index(entries, buckets, path, a.params, **store)


def add(spark: SparkSession, config: AddConfig, path: str, **store) -> None:
    """The index with further files, written to ``path``: as a new bucket, into one, or into the best-scoring one.

    Beyond a best-bin score below the threshold the fallback holds: a new bucket, no change, or an error.
    """
    old = open_index(spark, config.index)
    refs = references(spark, {config.bucket_name or config.files[0]: config.files})
    mode, name = config.mode, config.bucket_name
    target = None
    if mode == "existing_bucket":
        target = ix.resolve_bucket(old.buckets, name)
    elif mode == "best_bin":
        pooled = aggregate(refs.withColumn("id", F.col("ordinal")), old.entries, old.params, 0.0)
        best = pooled.orderBy(F.desc("score"), "bucket_id").limit(1).collect()
        if best and best[0]["score"] >= config.threshold:
            target = best[0]["bucket_id"]
        elif config.fallback == "error":
            raise ValueError("no bucket reaches the threshold")
        elif config.fallback == "skip":
            write_index(old.entries.select(*ix.PAIR), old.buckets, path, old.params, **store)
            return
    if target is None:
        if name is not None and not old.buckets.where(F.col("bucket_name") == name).isEmpty():
            raise ValueError(f"bucket exists: {name}")
        highest = old.buckets.agg(F.max("bucket_id")).first()[0] or 0
        refs = refs.withColumn("bucket_id", F.lit(highest + 1))
        buckets = old.buckets.unionByName(bucket_table(refs))
    else:
        refs = refs.withColumn("bucket_id", F.lit(target))
        added = refs.agg(F.sort_array(F.collect_list(source_label("file", "header"))).alias("more"))
        more = added.select(F.lit(target).alias("bucket_id"), "more")
        # The lengths of the bucket's earlier files aren't kept, so its statistics end here.
        changed = F.col("bucket_id") == target
        buckets = old.buckets.join(F.broadcast(more), "bucket_id", "left").withColumn(
            "sources", F.when(changed, F.concat("sources", "more")).otherwise(F.col("sources"))
        ).drop("more")
        for c in buckets.columns:
            if c.startswith("file_stats_"):
                buckets = buckets.withColumn(c, F.when(~changed, F.col(c)))
    entries = ix.consolidate(old.entries.select(*ix.PAIR).unionByName(ix.build_index(refs, old.params)))
    write_index(entries, buckets, path, old.params, **store)
