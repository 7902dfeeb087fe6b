"""Files, stored indices, configurations and streams."""

import gzip
import math
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake import config
from strandlake.functions.kernels import SketchParams
from strandlake.operators import classify, index, pipeline
from strandlake.sinks import results
from strandlake.sources import store, tables
from strandlake.sources.fastx import numbered, read_fasta_text, read_fastx
from strandlake.streaming.classify import classify_stream
from test_index import P, dna, reads, reverse


def fastq(n):
    # Qualities that begin with '@' and '+', the hard case of splitting.
    return "".join(f"@r{i} c\n{dna(i, 20 + i % 7)}\n+\n{'@+I>'[i % 4] * (20 + i % 7)}\n" for i in range(n))


@pytest.mark.parametrize("split", [1, 50, 333, 1 << 20])
def test_fastq_splits(spark, tmp_path, split):
    (tmp_path / "a.fq").write_text(fastq(60))
    if split == 1:
        (tmp_path / "a.fq").write_text(fastq(3))
    got = numbered(read_fastx(spark, str(tmp_path / "a.fq"), split_bytes=split)).orderBy("ordinal").collect()
    n = 3 if split == 1 else 60
    assert [(r["ordinal"], r["header"], r["sequence"]) for r in got] == [(i, f"r{i} c", dna(i, 20 + i % 7)) for i in range(n)]
    assert got[1]["quality"][0] == "+" and got[0]["quality"][0] == "@"


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_fasta(spark, tmp_path, split):
    text = ">a x\r\nACGT\r\nAC\r\n\r\n>b\n>c\nGG\nTT\n"
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(text.encode()))
    want = [("a x", "ACGTAC"), ("b", ""), ("c", "GGTT")]
    for name in ("x.fa", "x.fa.gz"):
        got = numbered(read_fastx(spark, str(tmp_path / name), split_bytes=split)).orderBy("ordinal")
        assert [(r["header"], r["sequence"]) for r in got.collect()] == want
    assert sorted((r["header"], r["sequence"]) for r in read_fasta_text(spark, str(tmp_path / "x.fa")).collect()) == want
    assert read_fastx(spark, str(tmp_path)).count() == 6 and read_fastx(spark, str(tmp_path / "*.fa")).count() == 3


def test_zstd(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "x.fq.zst").write_bytes(zstandard.ZstdCompressor().compress(fastq(5).encode()))
    assert read_fastx(spark, str(tmp_path / "x.fq.zst")).count() == 5


@pytest.mark.parametrize("text", ["hello\n", "@r\nACGT\n+\nII\n", "@r\nACGT\nII\n"])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "x").write_text(text)
    with pytest.raises(PySparkException):
        read_fastx(spark, str(tmp_path / "x")).collect()


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "x").write_text("")
    assert read_fastx(spark, str(tmp_path / "x")).count() == 0
    with pytest.raises(PySparkException):
        read_fastx(spark, str(tmp_path / "y")).collect()


def test_sequences_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", None, "GG"), ("b", "TT", "JJ", None), ("c", None, None, "A")], "read_id string, s string, q string, t string")
    path = str(tmp_path / "x.fastq.gz")
    assert results.write_sequences(df, path, sequences=["s"], qualities=["q"], single_file=True) == [path]
    assert {(r["header"], r["sequence"], r["quality"]) for r in read_fastx(spark, path).collect()} == {("a", "ACGT", "IIII"), ("b", "TT", "JJ")}
    one, two = results.write_sequences(df, str(tmp_path / "y.fa.gz"), sequences=["s", "t"], qualities=[None, None])
    assert one.endswith("y.R1.fa.gz") and [read_fastx(spark, p).first()["sequence"] for p in (one, two)] == ["ACGT", "GG"]
    with pytest.raises(ValueError):
        results.sequence_format("x.fasta")


def test_results(spark, tmp_path):
    assert [results.output_format(p) for p in (None, "-", "x.parquet", "x.tsv.gz", "x.txt", "gz")] == ["tsv", "tsv", "parquet", "tsv.gz", "tsv", "tsv"]
    hits = spark.createDataFrame([(1, 0.123456), (2, math.nan)], "id long, score double")
    results.write_results(hits, str(tmp_path / "x.tsv.gz"))
    got = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "x.tsv.gz"))
    assert {tuple(r) for r in got.collect()} == {("1", "0.1235"), ("2", "NaN")}
    results.write_results(hits, str(tmp_path / "x.parquet"), rounded=True)
    assert spark.read.parquet(str(tmp_path / "x.parquet")).where("id = 1").first()["score"] == 0.1235


def test_schemas(spark, tmp_path):
    good = reads(spark, (1, "A", None))
    assert tables.check_reads(good.withColumn("x", F.lit(1))).columns == good.columns
    for bad in (good.withColumn("id", F.lit(1)), good.withColumn("sequence", F.lit(1.0))):
        with pytest.raises(TypeError):
            tables.check_reads(bad)
    with pytest.raises(ValueError):
        tables.check_reads(good.drop("sequence"))
    with pytest.raises(PySparkException):
        tables.refuse_nulls(good, "pair_sequence").collect()
    good.select(F.lit("r").alias("read_id"), F.col("sequence").alias("sequence1")).write.parquet(str(tmp_path / "r"))
    assert tuple(tables.read_parquet_reads(spark, str(tmp_path / "r")).first()) == ("r", "A", None)


def test_unsigned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    values = [0, 1, 2**63, 2**64 - 1]
    pq.write_table(pa.table({"minimizer": pa.array(values, pa.uint64()), "bucket_id": pa.array([1] * 4, pa.uint32())}), tmp_path / "u.parquet")
    got = tables.read_foreign_entries(spark, str(tmp_path / "u.parquet"))
    assert dict(got.dtypes) == {"minimizer": "bigint", "bucket_id": "int"}
    assert [r[0] % 2**64 for r in got.collect()] == values


def test_config(tmp_path):
    (tmp_path / "a.fa").write_text(">a\nA\n")
    path = str(tmp_path / "c.toml")
    config.write_index_config(path, SketchParams(32, 10), "out", {"b": ["a.fa"], "a": [str(tmp_path / "a.fa")]}, orient=False)
    got = config.read_index_config(path)
    assert list(got.buckets) == ["a", "b"] and got.params == SketchParams(32, 10) and got.output == str(tmp_path / "out")
    for text in ("", "[index]\nwindow=1\nsalt=1\noutput='x'\n", "[index]\nwindow=1\nsalt=1\noutput='x'\nk=20\n[buckets.a]\nfiles=['a.fa']",
                 "[index]\nwindow=1\nsalt=1\noutput='x'\n[buckets.a]\nfiles=[]", "not toml"):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(ValueError):
            config.read_index_config(path)
    (tmp_path / "c.toml").write_text("[index]\nwindow=1\nsalt=1\noutput='x'\n[buckets.a]\nfiles=['none']")
    with pytest.raises(FileNotFoundError):
        config.read_index_config(path)
    with pytest.raises(ValueError):
        config.write_index_config(path, P, "o", {"a b": []})
    assert config.buckets_per_file(str(tmp_path), (".fa", ".fasta")) == {"a": [str(tmp_path / "a.fa")]}


def test_options():
    sizes = {"4G": 4 << 30, "512 mb": 512 << 20, "1.5K": 1536, "7": 7, "auto": None, "0.5b": 1}
    assert {t: config.parse_bytes(t) for t in sizes} == sizes
    for bad in ("", "x", "-1", "1X", "1.2.3", "99999999T"):
        with pytest.raises(ValueError):
            config.parse_bytes(bad)
    assert [config.format_bytes(n) for n in (0, 1023, 1024, 3 << 19, 5 << 40, 1 << 52)] == ["0 B", "1023 B", "1.00 KB", "1.50 MB", "5.00 TB", "4096.00 TB"]
    assert [config.format_duration(s) for s in (3, 62.4, 3725, -1, math.inf)] == ["3s", "1m02s", "1h02m05s", "?", "?"]
    assert config.parse_bloom_fpp("0.05") == 0.05
    with pytest.raises(ValueError):
        config.parse_bloom_fpp("1")
    with pytest.warns(UserWarning):
        assert config.parse_length("5", "trim") == 5
    with pytest.raises(ValueError):
        config.parse_length("0", "trim")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("refs")
    for name, seeds in (("x", (1, 2)), ("y", (3,)), ("z", (4,))):
        (folder / f"{name}.fa").write_text("".join(f">{name}{s}\n{dna(s, 300)}\n" for s in seeds))
    (folder / "r.fa").write_text(f">r\n{reverse(dna(3, 300))}\n")
    return folder


def test_pipeline(spark, files, tmp_path):
    first, second, both, more = (str(tmp_path / n) for n in ("a", "b", "c", "d"))
    pipeline.create(spark, [str(files / "x.fa"), str(files / "y.fa")], first, P, bloom_fpp=0.05, partitions=3)
    stored = store.open_index(spark, first)
    assert stored.manifest["n_buckets"] == 2 and stored.params == P
    stats = stored.buckets.orderBy("bucket_id").first()
    assert (stats["file_stats_mean"], len(stats["sources"])) == (600.0, 2)
    pipeline.create(spark, [str(files / "x.fa")], second, P, separate=True)
    assert {r["bucket_name"] for r in store.open_index(spark, second).buckets.collect()} == {"x1", "x2"}
    with pytest.raises(ValueError, match="no minimizers left"):
        pipeline.merge(spark, first, second, both, subtract=True)
    pipeline.merge(spark, first, second, both)
    merged = store.open_index(spark, both)
    assert [r["bucket_id"] for r in merged.buckets.orderBy("bucket_id").collect()] == [1, 2, 3, 4]
    add = lambda mode, **k: config.AddConfig(first, mode, [str(files / "y.fa")], **k)
    pipeline.add(spark, add("best_bin", threshold=0.5), more)
    grown = store.open_index(spark, more)
    assert grown.buckets.count() == 2 and grown.manifest["n_entries"] == stored.manifest["n_entries"]
    pipeline.add(spark, add("new_bucket", bucket_name="new"), more)
    assert store.open_index(spark, more).buckets.count() == 3
    pipeline.add(spark, add("existing_bucket", bucket_name="1"), more)
    into = store.open_index(spark, more).buckets.where("bucket_id = 1").first()
    assert len(into["sources"]) == 3 and into["file_stats_mean"] is None


def test_from_config(spark, files, tmp_path):
    path = str(tmp_path / "c.toml")
    buckets = {"b": [str(files / "y.fa"), str(files / "r.fa")], "a": [str(files / "z.fa")]}
    config.write_index_config(path, P, str(tmp_path / "idx"), buckets, orient=True)
    pipeline.from_config(spark, config.read_index_config(path))
    stored = store.open_index(spark, str(tmp_path / "idx"))
    assert [r["bucket_name"] for r in stored.buckets.orderBy("bucket_id").collect()] == ["a", "b"]
    # The file r holds y's reverse complement; it goes in as read and y, after it, is turned.
    sizes = {r["bucket_id"]: r["n_minimizers"] for r in index.bucket_stats(stored.entries).collect()}
    one_strand = index.build_index(pipeline.references(spark, {"b": [str(files / "r.fa")]}).withColumn("bucket_id", F.lit(1)), P).count()
    assert sizes[2] <= one_strand + 2
    other = store.StoredIndex(SketchParams(32, 5), stored.entries, stored.buckets, {})
    with pytest.raises(ValueError):
        pipeline.from_config(spark, config.read_index_config(path), exclude=other)
    with pytest.raises(ValueError):
        store.check_compatible(stored, other)


def test_from_config_of_one_bucket(spark, tmp_path):
    """The first file goes in as read, also what would be turned; the second, first by name, is held against all of it."""
    first, second, path = (str(tmp_path / n) for n in ("p.fa", "a.fa", "c.toml"))
    for file, texts in ((first, (dna(3, 300), reverse(dna(3, 300)), dna(4, 300))), (second, (reverse(dna(4, 300)),))):
        with open(file, "w") as f:
            f.write("".join(f">s{i}\n{t}\n" for i, t in enumerate(texts)))
    config.write_index_config(path, P, str(tmp_path / "idx"), {"b": [first, second]}, orient=True)
    pipeline.from_config(spark, config.read_index_config(path))
    got = store.open_index(spark, str(tmp_path / "idx")).entries.select("minimizer", "bucket_id")
    forward = index.build_index(pipeline.references(spark, {"b": [first]}).withColumn("bucket_id", F.lit(1)), P)
    assert forward.exceptAll(got).count() == 0 and got.count() <= forward.count() + 2


def test_empty_and_foreign_index(spark, tmp_path):
    entries = spark.createDataFrame([], "minimizer long, bucket_id int")
    buckets = spark.createDataFrame([], "bucket_id int, bucket_name string, sources array<string>, file_stats_mean double")
    path = str(tmp_path / "e")
    store.write_index(entries, buckets, path, P)
    stored = store.open_index(spark, path)
    assert classify.classify(reads(spark, (1, dna(1, 100), None)), stored.entries, P, 0.0).count() == 0
    assert store.in_range_of(stored.entries, classify.query_sketch(reads(spark, (1, None, None)), P)).count() == 0
    spark.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError):
        store.open_index(spark, path)
    with pytest.raises(ValueError):
        store.write_index(entries, buckets, path, P, bloom_fpp=1.0)


def test_pushed_filter(spark, tmp_path):
    rows = [(i * 7919 - 2**62, 1) for i in range(2000)]
    entries = spark.createDataFrame(rows, "minimizer long, bucket_id int")
    buckets = spark.createDataFrame([(1, "b", ["s"])], "bucket_id int, bucket_name string, sources array<string>")
    store.write_index(entries, buckets, str(tmp_path / "i"), P, partitions=4)
    pruned = store.in_range_of(store.open_index(spark, str(tmp_path / "i")).entries, entries.limit(3))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(minimizer_key" in plan
    assert pruned.count() == 3


def test_stream(spark, tmp_path):
    refs = spark.createDataFrame([(1, dna(1, 300))], "bucket_id int, sequence string")
    built = index.build_index(refs, P).cache()
    source = str(tmp_path / "in")
    for i in range(3):
        reads(spark, (i, dna(1, 300)[i * 20 : i * 20 + 150], None)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, sequence string, pair_sequence string").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        classify_stream(stream, built, P, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "score").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("batch=")]) == 3
