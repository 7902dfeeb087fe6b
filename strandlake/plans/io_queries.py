"""Round trips through sources, sinks and streams. Their results equal those of the queries without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import index as ix
from strandlake.operators.classify import classify, query_sketch, scores
from strandlake.plans.classify_queries import _index, _pooled, _shown
from strandlake.plans.classify_sql import ORACLE as _CLASSIFY
from strandlake.plans.sketch_queries import SMALL, features_of, pieces_of, reads_of
from strandlake.plans.sketch_sql import ORACLE as _SKETCH
from strandlake.runtime import cut, scratch, table
from strandlake.sinks.results import write_results, write_sequences
from strandlake.sources.fastx import numbered, read_fasta_text, read_fastx
from strandlake.sources.store import entries_for, open_index, write_index
from strandlake.sources.tables import check_reads
from strandlake.streaming.classify import classify_stream, log_ratio_stream


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written, opened, and used as far as the reads' minimizers touch its files."""
    features = features_of(spark, sf_dir)
    path = scratch(spark, "index")
    write_index(ix.build_index(pieces_of(spark, sf_dir), SMALL), ix.bucket_dimension(features), path, SMALL, bloom_fpp=0.05)
    stored = open_index(spark, path)
    sketch = cut(query_sketch(reads_of(spark, sf_dir), stored.params, unique_ids=True))
    return scores(sketch, entries_for(stored, sketch), 0.0)


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as gzip FASTQ and read again: the header carries the id."""
    path = scratch(spark, "reads") + ".fastq.gz"
    reads = check_reads(reads_of(spark, sf_dir)).withColumn("header", F.col("id").cast("string"))
    write_sequences(reads, path, header="header")
    return read_fastx(spark, path).select(F.col("header").cast("long").alias("id"), "sequence", F.length("quality").alias("n_quality"))


def fasta_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as plain FASTA, read in splits of 10 kB and as text: the two must agree."""
    path = scratch(spark, "features.fa")
    rows = features_of(spark, sf_dir).select(F.concat(F.lit(">"), "feature_idx", F.lit("\n"), "sequence").alias("value"))
    rows.write.text(path)
    split = numbered(read_fastx(spark, path, split_bytes=10_000)).select("header", "sequence")
    text = read_fasta_text(spark, path)
    return split.join(text, ["header", "sequence"]).select(F.col("header").cast("long").alias("feature_idx"), "sequence")


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as compressed text and read again."""
    path = scratch(spark, "hits") + ".tsv.gz"
    write_results(classify(reads_of(spark, sf_dir), _index(spark, sf_dir), SMALL, 0.0), path)
    return spark.read.option("sep", "\t").option("header", "true").schema("query_id long, bucket_id int, score double").csv(path)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reads as a stream of files."""
    path = scratch(spark, "stream")
    reads_of(spark, sf_dir).repartition(3).write.parquet(path)
    return spark.readStream.schema("id long, read_id string, sequence string, pair_sequence string").parquet(path)


def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = scratch(spark, "stream-hits"), scratch(spark, "stream-state")
    classify_stream(_stream(spark, sf_dir), _index(spark, sf_dir), SMALL, out, state, unique_ids=True).awaitTermination()
    return spark.read.parquet(out).select("query_id", "bucket_id", "score")


def stream_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = scratch(spark, "stream-ratios"), scratch(spark, "stream-state")
    log_ratio_stream(_stream(spark, sf_dir), *_pooled(spark, sf_dir), SMALL, out, state, unique_ids=True).awaitTermination()
    return _shown(spark.read.parquet(out).drop("batch"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics over the event values of each user by type: the same aggregate on another table."""
    return ix.file_stats(table(spark, sf_dir, "events"), "event_type", "user_id", "value")


_ALL = (index_roundtrip, fastq_roundtrip, fasta_splits, results_roundtrip, stream_classify, stream_log_ratio, events_by_type)
QUERIES = {f.__name__: f for f in _ALL}

_READS = _SKETCH["reads_latest"].partition("SELECT * FROM reads")[0]
ORACLE = {
    "index_roundtrip": _CLASSIFY["classify_all_hits"],
    "fastq_roundtrip": f"{_READS} SELECT id, sequence, length(sequence) AS n_quality FROM reads WHERE sequence IS NOT NULL",
    "fasta_splits": f"""WITH f AS ({_SKETCH['chunk_reassembly']}), m AS ({_SKETCH['feature_buckets']})
SELECT f.feature_idx, f.sequence FROM f JOIN m ON m.feature_idx = f.feature_idx""",
    "results_roundtrip": _CLASSIFY["classify_all_hits"].replace("bucket_id, score FROM x", "bucket_id, CAST(printf('%.4f', score) AS DOUBLE) AS score FROM x"),
    "stream_classify": _CLASSIFY["classify_long"].replace("bucket_name, score FROM x", "x.bucket_id, score FROM x"),
    "stream_log_ratio": _CLASSIFY["log_ratio"],
    "events_by_type": """WITH t AS (SELECT event_type, user_id, CAST(sum(coalesce(value, 0)) AS DOUBLE) AS n FROM events GROUP BY 1, 2)
SELECT event_type, avg(n) AS mean, median(n) AS median, stddev_pop(n) AS stdev, min(n) AS min, max(n) AS max FROM t GROUP BY 1""",
}
