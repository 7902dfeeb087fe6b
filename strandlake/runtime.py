"""Session-level helpers shared by all operators: tables, scratch space, bounded broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a dimension may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bytes of a split, below which data is dealt out again before costly functions.
SPLIT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``, made up only for a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "strandlake-checkpoints")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one that is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/strandlake-{spark.sparkContext.applicationId}"
    _at(spark, folder, lambda fs, place: fs.mkdirs(place) and fs.deleteOnExit(place))
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str, act) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark._jsc.hadoopConfiguration()), place)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, its lineage dropped.

    The folder is :func:`shared_folder`; the table outlives lost executors, and readers take only the columns they need.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`cut` that nothing reads any more."""
    for t in tables:
        _at(t.sparkSession, t._cut_path, lambda fs, place: fs.delete(place, True))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session starts with."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as there are cores, if what it reads is less than a split for each.

    Adaptive execution merges partitions by bytes, and a small file is one split; costly functions would run in a
    task or two. Larger data has splits enough and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if cores > 1 and known < cores * SPLIT_BYTES else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it is no more than a scan, else :func:`cut`: what is read several times is computed once."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.children().isEmpty() else cut(df)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is.

    The rows are fetched up to the bound, so nothing that grows with the data is ever broadcast, and what was fetched
    takes the place of the plan it came from. Rows that the driver has already are only counted.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.nodeName() == "LocalRelation":
        return F.broadcast(df) if plan.data().length() <= max_rows else df
    rows = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= max_rows else df


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
