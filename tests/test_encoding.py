"""Scalar expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import encoding as e


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("k", [1, 16, 32, 63, 64])
def test_reverse_complement(spark, k):
    rng = random.Random(k)
    words = [0, 2**k - 1, *(rng.randrange(2**k) for _ in range(30))]
    want = [int(f"{w:0{k}b}".translate({48: "1", 49: "0"})[::-1], 2) for w in words]
    got = column(spark, [e.signed(w) for w in words], "long", e.reverse_complement("v", k))
    assert [g % 2**64 for g in got] == want


def test_unsigned_order(spark):
    words = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    keys = column(spark, [e.signed(w) for w in words], "long", e.unsigned_key("v"))
    assert keys == sorted(keys)


def test_bases(spark):
    assert column(spark, list("AaGgTtCcNU-") + [None], "string", e.base_to_bit("v")) == [1] * 4 + [0] * 4 + [None] * 4
    assert column(spark, ["0011", "1"], "string", e.complement_bits("v")) == ["0011", "0"]
    assert column(spark, ["1" * 64, "0" * 63 + "1"], "string", e.pack_bits("v")) == [-1, 1]


def test_headers(spark):
    headers = ["r1/1", "r1/2 comment", "r1\tx/1", "r1/3", "/1", "", "a/1/2", None]
    assert column(spark, headers, "string", e.base_read_id("v")) == ["r1", "r1", "r1", "r1/3", "", "", "a/1", None]


def test_names(spark):
    names = ["plain", "tab\there", "nul\x00", "nbsp x", "next\u0085line", "é", "a b", "　", ""]
    want = ["plain", "tab_here", "nul_", "nbsp x", "next_line", "_", "a b", "　", ""]
    assert column(spark, names, "string", e.sanitize_bucket_name("v")) == want


def test_scores(spark):
    rows = [(3, 4, 1, 2), (0, 0, 0, 0), (0, 0, 2, 2), (1, 5, 0, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = [r[0] for r in df.select(e.score(*map(F.col, "abcd"))).collect()]
    assert sorted(got) == [0.0, 0.2, 0.75, 1.0]


def test_log_ratio(spark):
    rows = [(0.0, 0.0), (0.0, 0.5), (0.5, 0.0), (0.5, 0.5), (0.01, 0.1), (0.1, 0.01)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = {(r["n"], r["d"]): r["x"] for r in df.withColumn("x", e.log_ratio("n", "d")).collect()}
    assert math.isnan(got[0.0, 0.0]) and got[0.0, 0.5] == -math.inf and got[0.5, 0.0] == math.inf
    assert got[0.5, 0.5] == 0 and got[0.01, 0.1] == pytest.approx(-1) and got[0.1, 0.01] == pytest.approx(1)


def test_fixed4(spark):
    values = [0.12344, math.nan, math.inf, -math.inf, 1.0]
    assert column(spark, values, "double", e.fixed4("v")) == ["0.1234", "NaN", "inf", "-inf", "1.0000"]


def test_sets(spark):
    df = spark.createDataFrame([([1, 1, 2, 3], [1, 3, 9]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(e.count_hits("a", "b")).collect()] == [3, 0]
    assert [r[0] for r in df.select(e.intersection_size("a", "b")).collect()] == [2, 0]
    assert [r[0] for r in spark.range(1).select(e.orientation(F.lit(0.5), F.lit(0.5))).collect()] == ["fwd"]
    assert spark.range(1).select(e.source_path(e.source_label(F.lit("p"), F.lit("s::t")))).first()[0] == "p"


def test_trim(spark):
    rows = [(1, "ACGTACGT", "AC"), (2, "ACG", "ACGTAC"), (3, None, "A"), (4, "ACGTA", None)]
    df = spark.createDataFrame(rows, "id int, sequence string, pair string")
    got = {tuple(r) for r in e.trim_reads(df, pair="pair", trim_to=4).collect()}
    assert got == {(1, "ACGT", "AC"), (4, "ACGT", None)}
    assert [r["id"] for r in e.trim_reads(df, min_length=6, trim_to=4).collect()] == [1]
    assert e.trim_reads(df).count() == 4
    with pytest.raises(ValueError):
        e.trim_reads(df, trim_to=0)
