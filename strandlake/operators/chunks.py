"""References that arrive in pieces, and the mapping of references to buckets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.encoding import sanitize_bucket_name
from strandlake.functions.kernels import SketchParams
from strandlake.runtime import cut, discard, require_columns, small

#: Most buckets of an index.
MAX_BUCKETS = 100_000


def chunk_report(chunks: DataFrame) -> DataFrame:
    """The state of every feature: ``feature_idx``, ``n_chunks``, ``n_letters`` and ``status``.

    ``status`` is the first that holds of ``null`` (a null index or piece), ``duplicate`` (an index occurs again),
    ``start`` (the first index is not 0), ``gap`` (an index is missing), else ``ok``. A null feature is a feature of
    its own with status ``null``. An empty table gives no rows.
    """
    require_columns(chunks, "feature_idx", "chunk_index", "chunk_data")
    # Equal pairs of feature and index meet in a combined aggregate, so a hot feature is spread by its indexes.
    pieces = chunks.groupBy("feature_idx", "chunk_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("chunk_data")).alias("letters"),
        F.count("chunk_data").alias("given"),
    )
    nulls = F.max((F.col("chunk_index").isNull() | (F.col("given") < F.col("n"))).cast("int"))
    status = (
        F.when(F.col("feature_idx").isNull() | (F.col("nulls") > 0), "null")
        .when(F.col("most") > 1, "duplicate")
        .when(F.col("first") != 0, "start")
        .when(F.col("last") + 1 != F.col("n_chunks"), "gap")
        .otherwise("ok")
    )
    return (
        pieces.groupBy("feature_idx")
        .agg(
            F.sum("n").alias("n_chunks"), F.coalesce(F.sum("letters"), F.lit(0)).alias("n_letters"), nulls.alias("nulls"),
            F.max("n").alias("most"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"),
        )
        .select("feature_idx", "n_chunks", "n_letters", status.alias("status"))
    )


def _good(chunks: DataFrame, strict: bool) -> DataFrame:
    report = chunk_report(chunks)
    if strict:
        bad = F.concat(F.lit("feature "), F.coalesce("feature_idx", F.lit("null")), F.lit(": "), F.col("status"))
        report = report.where(F.when(F.col("status") == "ok", True).otherwise(F.raise_error(bad).cast("boolean")))
    return report.where("status = 'ok'")


def reassemble(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Whole features: ``feature_idx``, ``sequence``.

    Pieces may come in any order. A feature whose state by :func:`chunk_report` isn't ``ok`` is left out, or,
    with ``strict``, is an error when it is reached. A feature is one value, so it is put together in one task.
    """
    good = _good(chunks, strict).select("feature_idx")
    return (
        chunks.join(good, "feature_idx", "left_semi")
        .groupBy("feature_idx")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_data"))).alias("pieces"))
        .select("feature_idx", F.concat_ws("", F.col("pieces.chunk_data")).alias("sequence"))
    )


def feature_buckets(mapping: DataFrame, strict: bool = False) -> DataFrame:
    """``feature_idx``, ``bucket_name`` with cleaned names, one row per feature.

    Rows with a null are left out. Repeated rows and names that become equal when cleaned count as one; a feature
    with several different cleaned names gets none of them. With ``strict``, a repeated feature, or two
    raw names that become equal, is an error, as are nulls.
    """
    require_columns(mapping, "feature_idx", "bucket_name")
    rows = mapping.select("feature_idx", "bucket_name", sanitize_bucket_name("bucket_name").alias("clean"))
    if strict:
        if not rows.where("feature_idx IS NULL OR bucket_name IS NULL").isEmpty():
            raise ValueError("null feature or bucket name")
        if not rows.groupBy("feature_idx").count().where("count > 1").isEmpty():
            raise ValueError("a feature is mapped more than once")
        if not rows.groupBy("clean").agg(F.countDistinct("bucket_name").alias("n")).where("n > 1").isEmpty():
            raise ValueError("different bucket names become equal when cleaned")
    rows = rows.where("feature_idx IS NOT NULL AND clean IS NOT NULL")
    return (
        rows.groupBy("feature_idx").agg(F.min("clean").alias("bucket_name"), F.max("clean").alias("last"))
        .where("bucket_name = last").drop("last")
    )


def bucket_ids(names: DataFrame) -> DataFrame:
    """``bucket_name``, ``bucket_id`` from 1 in the order of the names (by bytes). More than 100,000 buckets are an error."""
    distinct = names.select("bucket_name").where("bucket_name IS NOT NULL").distinct()
    listed = distinct.limit(MAX_BUCKETS + 1).toArrow()["bucket_name"].to_pylist()
    if len(listed) > MAX_BUCKETS:
        raise ValueError(f"there are more than {MAX_BUCKETS} buckets")
    ids = {"bucket_name": pa.array(sorted(listed), pa.string()), "bucket_id": pa.array(range(1, len(listed) + 1), pa.int32())}
    return names.sparkSession.createDataFrame(pa.table(ids))


def overlapping_pieces(chunks: DataFrame, params: SketchParams, strict: bool = False) -> DataFrame:
    """The pieces of whole features, each with the letters that follow it: ``feature_idx``, ``chunk_index``, ``sequence``.

    With k + w - 2 letters of what follows, every window of a feature is in the piece it starts in, so that the sketches of
    the pieces make up that of the feature, and a feature is never put together. Pieces may be short or empty: the heads
    that follow are joined by doubling, until they are long enough or end with the feature. Features as in :func:`reassemble`.
    """
    need, place = params.k + params.w - 2, ["feature_idx", "chunk_index"]
    good = small(_good(chunks, strict).select("feature_idx", (F.col("n_chunks") - 1).alias("last")))
    pieces = chunks.join(good, "feature_idx").select(*place, "last", "chunk_data")
    heads = cut(pieces.select(*place, "last", F.substring("chunk_data", 1, need).alias("head")))
    step = 1
    while not heads.where((F.length("head") < need) & (F.col("chunk_index") + step <= F.col("last"))).isEmpty():
        after = heads.select("feature_idx", (F.col("chunk_index") - step).alias("chunk_index"), F.col("head").alias("more"))
        joined = F.substring(F.concat("head", F.coalesce("more", F.lit(""))), 1, need)
        longer = cut(heads.join(after, place, "left").select(*place, "last", joined.alias("head")))
        discard(heads)
        heads, step = longer, 2 * step
    tails = heads.select("feature_idx", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("head").alias("tail"))
    whole = F.concat("chunk_data", F.coalesce("tail", F.lit("")))
    return pieces.join(tails, place, "left").select(*place, whole.alias("sequence"))


def features_in_buckets(
    chunks: DataFrame, mapping: DataFrame, strict: bool = False, pieces_for: SketchParams | None = None
) -> DataFrame:
    """Whole features with their bucket: ``feature_idx``, ``sequence``, ``bucket_name``, ``bucket_id``.

    Features without a bucket are left out or, with ``strict``, are an error. With ``pieces_for``, a feature comes as its
    :func:`overlapping_pieces`, enough for sketches with these parameters.
    """
    mapped = feature_buckets(mapping, strict)
    near = small(mapped)
    named = near.join(small(bucket_ids(near)), "bucket_name")
    named = named if near is mapped else F.broadcast(named)
    features = reassemble(chunks, strict) if pieces_for is None else overlapping_pieces(chunks, pieces_for, strict).drop("chunk_index")
    if not strict:
        return features.join(named, "feature_idx")
    unmapped = F.raise_error(F.concat(F.lit("feature without a bucket: "), "feature_idx")).cast("int")
    return features.join(named, "feature_idx", "left").withColumn("bucket_id", F.coalesce("bucket_id", unmapped))


def split_into_buckets(files: DataFrame, n: int, path: str = "file_path", label: str = "group_label") -> DataFrame:
    """Files in the order of their labels, cut into ``n`` even runs named ``bucket_0`` ..; the first ones are longer.

    Files of the same label go by path. ``n`` greater than the number of files is an error. It is a list of files:
    its order is made in one task.
    """
    if n < 1:
        raise ValueError("files can be dealt to one bucket or more")
    total = files.count()
    if n > total:
        raise ValueError(f"{total} files don't fill {n} buckets")
    part = F.ntile(n).over(Window.partitionBy(F.lit(0)).orderBy(label, path))
    return files.withColumn("bucket_name", F.concat(F.lit("bucket_"), part - 1))
