"""Files in, files out, and the combinations of options that are refused."""

import gzip
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import strandlake
from strandlake.functions.kernels import SketchParams
from strandlake.operators import index
from strandlake.sources import store
from test_index import dna, reverse

P = SketchParams(32, 5)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("api")
    for name, seed in (("x", 1), ("y", 2)):
        (folder / f"{name}.fa").write_text(f">{name}\n{dna(seed, 400)}\n")
        strandlake.create(spark, [str(folder / f"{name}.fa")], str(folder / f"{name}.idx"), P)
    strandlake.create(spark, [str(folder / "x.fa"), str(folder / "y.fa")], str(folder / "both.idx"), P, partitions=3)
    strandlake.create(spark, [str(folder / "x.fa")], str(folder / "other.idx"), SketchParams(32, 5, 0))
    reads = {"a": dna(1, 200), "b": dna(2, 200), "c": dna(9, 200), "d": dna(1, 100) + dna(2, 100)}
    (folder / "r.fq").write_text("".join(f"@{n}/1 x\n{t}\n+\n{'J' * len(t)}\n" for n, t in reads.items()))
    (folder / "r2.fq").write_text("".join(f"@{n}/2 x\n{reverse(t)[:150]}\n+\n{'K' * 150}\n" for n, t in reads.items()))
    rows = spark.createDataFrame([(n, t) for n, t in reads.items()], "read_id string, sequence1 string")
    rows.write.parquet(str(folder / "r.parquet"))
    return folder


def test_classify(spark, data, capsys):
    p = {n: str(data / n) for n in ("both.idx", "r.fq", "r2.fq", "r.parquet")}
    got = strandlake.classify(spark, p["both.idx"], p["r.fq"], str(data / "out.tsv.gz"))
    names = {r["bucket_name"] for r in store.open_index(spark, p["both.idx"]).buckets.collect()}
    found = {(r["read_id"], r["bucket_name"][-4:]): r["score"] for r in got.collect()}
    assert {k for k, v in found.items() if v == 1} == {("a", "x.fa"), ("b", "y.fa")} and ("d", "x.fa") in found
    text = spark.read.option("sep", "\t").option("header", "true").csv(str(data / "out.tsv.gz"))
    assert text.columns == ["read_id", "bucket_name", "score"] and text.count() == len(found)
    for reads, mates in ((p["r.parquet"], None), (p["r.fq"], p["r2.fq"])):
        again = strandlake.classify(spark, p["both.idx"], reads, str(data / "out.parquet"), mates).collect()
        assert {(r["read_id"], r["bucket_name"][-4:]) for r in again} == set(found)
    best = strandlake.classify(spark, p["both.idx"], p["r.fq"], "-", best_hit=True, threshold=0.9)
    assert {r["read_id"] for r in best.collect()} == {"a", "b", "d"}  # whatever the score
    assert capsys.readouterr().out.splitlines()[0] == "read_id\tbucket_name\tscore"
    wide = strandlake.classify(spark, p["both.idx"], p["r.fq"], str(data / "wide.tsv"), wide=True)
    assert set(wide.columns) == {"read_id", *names} and wide.count() == 3
    none = strandlake.classify(spark, p["both.idx"], p["r.fq"], str(data / "n.tsv"), negative=str(data / "x.idx"))
    assert {r["bucket_name"][-4:] for r in none.collect()} == {"y.fa"}
    pooled = strandlake.aggregate(spark, p["both.idx"], p["r.fq"], str(data / "g.tsv"))
    assert {r["query_name"] for r in pooled.collect()} == {"global"} and pooled.count() == 2


def test_log_ratio(spark, data):
    x, y, r = (str(data / n) for n in ("x.idx", "y.idx", "r.fq"))
    got = {row["read_id"]: row for row in strandlake.log_ratio(
        spark, x, y, r, str(data / "lr.tsv"), output_sequences=str(data / "pass.fq.gz"), passing_is_positive=True).collect()}
    assert got["a"]["score"] == math.inf and got["b"]["score"] == -math.inf and math.isnan(got["c"]["score"])
    assert got["a"]["bucket_name"].startswith("log10([") and got["a"]["fast_path"] == "none"
    kept = strandlake.read_reads(spark, str(data / "pass.fq.gz")).collect()
    assert {"a", "c"} <= {k["read_id"] for k in kept} and "b" not in {k["read_id"] for k in kept}
    assert {k["quality"] for k in kept} == {"J" * 200}


def test_refused(spark, data):
    both, x, y, other, r, q = (str(data / n) for n in ("both.idx", "x.idx", "y.idx", "other.idx", "r.fq", "r.parquet"))
    bad = [
        lambda: strandlake.classify(spark, both, r, wide=True, threshold=0.2),
        lambda: strandlake.classify(spark, both, r, threshold=1.5),
        lambda: strandlake.classify(spark, both, r, negative=other),
        lambda: strandlake.classify(spark, both, r, "-", kind="parquet"),
        lambda: strandlake.classify(spark, both, q, mates=r),
        lambda: strandlake.log_ratio(spark, both, y, r),
        lambda: strandlake.log_ratio(spark, x, other, r),
        lambda: strandlake.log_ratio(spark, x, y, r, skip=0.0),
        lambda: strandlake.log_ratio(spark, x, y, r, trim_to=50, output_sequences="p.fa.gz"),
        lambda: strandlake.log_ratio(spark, x, y, r, output_sequences="p.fa"),
        lambda: strandlake.bucket_source_detail(spark, x, "1", paths=True, ids=True),
        lambda: strandlake.bucket_source_detail(spark, x, "7"),
    ]
    for call in bad:
        with pytest.raises(ValueError):
            call()
    with pytest.raises(PySparkException):  # mates that don't belong together
        strandlake.read_reads(spark, r, str(data / "x.fa")).collect()
    with pytest.raises(AttributeError):
        strandlake.nothing  # noqa: B018


def test_details(spark, data):
    both = str(data / "both.idx")
    assert strandlake.index_stats(spark, both).first()["n_buckets"] == 2
    assert [r[0] for r in strandlake.bucket_source_detail(spark, both, "1", ids=True).collect()] == [1, 2]
    assert [r[0].split("/")[-1] for r in strandlake.bucket_source_detail(spark, both, "1", paths=True).collect()] == ["x.fa"]
    assert [r[0].split("::")[-1] for r in strandlake.bucket_source_detail(spark, both, "2").collect()] == ["y"]


def test_only_touched_files_are_read(spark, data):
    stored = store.open_index(spark, str(data / "both.idx"))
    one = stored.entries.limit(1).select("minimizer")
    files = store.entries_for(stored, one)
    assert len(files.inputFiles()) == 1 < len(stored.entries.inputFiles())
    assert files.join(one, "minimizer", "left_semi").count() == stored.entries.join(one, "minimizer", "left_semi").count()
    assert store.entries_for(stored, one.limit(0)).count() == 0
    assert store.entries_for(stored, stored.entries, max_files=1).count() == stored.entries.count()


def test_unequal_parameters_are_known(spark, data):
    """Also of plain tables, as the column tells."""
    from strandlake.operators.classify import classify
    from strandlake.operators.logratio import log_ratio

    other = store.open_index(spark, str(data / "other.idx")).entries
    good = store.open_index(spark, str(data / "x.idx")).entries
    reads = strandlake.read_reads(spark, str(data / "r.fq"))
    for call in (
        lambda: classify(reads, good, P, negative=other.where("bucket_id = 1")), lambda: classify(reads, other, P),
        lambda: log_ratio(reads, good, other, P), lambda: index.build_index(reads.withColumn("bucket_id", F.lit(1)), P, exclude=other),
        lambda: log_ratio(reads, store.open_index(spark, str(data / "both.idx")).entries, good, P),
    ):
        with pytest.raises(ValueError):
            call()


def test_colliding_names(spark, tmp_path):
    (tmp_path / "a.fa").write_text(f">s\n{dna(1, 90)}\n>s\n{dna(2, 90)}\n")
    with pytest.raises(ValueError, match="several sequences"):
        strandlake.create(spark, [str(tmp_path / "a.fa")], str(tmp_path / "i"), P, separate=True)
    from strandlake.operators.pipeline import references

    with pytest.raises(ValueError, match="different buckets"):
        references(spark, {"x\t": [str(tmp_path / "a.fa")], "x_": [str(tmp_path / "a.fa")]})


def test_mates_stay_without_each_other(spark, tmp_path):
    from strandlake.sinks.results import write_sequences

    df = spark.createDataFrame([("a", "AC", "G"), ("b", "TT", None)], "read_id string, s string, t string")
    one, two = write_sequences(df, str(tmp_path / "y.fa.gz"), sequences=["s", "t"], qualities=[None, None], single_file=True)
    ids = lambda p: [r["read_id"] for r in strandlake.read_reads(spark, p).collect()]
    assert ids(one) == ["a", "b"] and ids(two) == ["a"]


def test_generated_configurations(tmp_path):
    from strandlake import config

    for n in "abc":
        (tmp_path / f"{n}.fa").write_bytes(gzip.compress(b""))
    (tmp_path / "l.tsv").write_text("file_path\tgroup_label\n" + "".join(f"{n}.fa\t{g}\n" for n, g in zip("abcde", "ZYZXX", strict=True)))
    assert [len(f) for f in config.one_bucket("u", str(tmp_path), (".fa",)).values()] == [3]
    assert config.one_bucket("u", str(tmp_path / "l.tsv"), (".fa",)) == {"u": [f"{n}.fa" for n in "abcde"]}
    assert config.grouped_buckets(str(tmp_path / "l.tsv"), 2) == {"bucket_0": ["d.fa", "e.fa", "b.fa"], "bucket_1": ["a.fa", "c.fa"]}
    for n in (0, 6):
        with pytest.raises(ValueError):
            config.grouped_buckets(str(tmp_path / "l.tsv"), n)
