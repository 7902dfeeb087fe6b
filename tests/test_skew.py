"""Per-key results with heavy keys, against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.operators.entries import valid_entries
from strandlake.operators.skew import heavy_keys, is_heavy, key_counts, salted_aggregate

SCHEMA = "k long, v int, salt string, n int, key string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(7, rng.randrange(50)) for _ in range(400)]  # a third of all rows
    out += [(None, 1)] * 20 + [(8, None)] * 30 + [(9, 3)] * 200  # repeated rows
    out += [(1000 + i, rng.randrange(5)) for i in range(550)]
    rng.shuffle(out)
    return [(k, v, "x", 1, "y") for k, v in out]


def test_heavy_keys(spark, rows):
    total, heavy = heavy_keys(spark.createDataFrame(rows, SCHEMA), ["k", "v"], 0.02)
    assert total == len(rows)
    assert {7, 8, 9} <= set(heavy["k"]) and not any(k > 1000 for k in heavy["k"])
    counts = Counter(r[1] for r in rows)
    assert {v for v, n in counts.items() if v is not None and n >= 0.02 * total} <= set(heavy["v"])


@pytest.mark.parametrize("heavy", [[], [7, 9]])
@pytest.mark.parametrize("distinct", [True, False])
def test_key_counts(spark, rows, heavy, distinct):
    got = key_counts(spark.createDataFrame(rows, SCHEMA), "k", "v", heavy, salts=4, distinct=distinct).collect()
    n = Counter(r[0] for r in rows if r[0] is not None)
    assert {r["k"]: r["n_rows"] for r in got} == n and len(got) == len(n)
    if distinct:
        partners = {k: len({r[1] for r in rows if r[0] == k and r[1] is not None}) for k in n}
        assert {r["k"]: r["n_partners"] for r in got} == partners


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(empty, ["k"]) == (0, {"k": []})
    assert key_counts(empty, "k", "v", []).count() == 0
    assert salted_aggregate(empty, "k", {"a": ("max", "v")}, ["v"]).count() == 0


def test_salted_aggregate(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    aggs = {"c": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "salt": ("max", "salt")}
    got = {r["k"]: tuple(r)[1:] for r in salted_aggregate(df, "k", aggs, ["v"], share=0.02, salts=8).collect()}
    for key in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == key and r[1] is not None]
        assert got[key] == (len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), "x")


def test_salted_aggregate_refuses(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="mergeable"):
        salted_aggregate(df, "k", {"m": ("median", "v")}, ["v"])
    with pytest.raises(ValueError, match="clashes"):
        salted_aggregate(df, "k", {"k": ("max", "v")}, ["v"])
    with pytest.raises(ValueError, match="share"):
        heavy_keys(df, ["k"], 1e-6)


def test_valid_entries(spark):
    entries = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (3, 9)], "minimizer long, bucket_id int")
    buckets = spark.createDataFrame([(1,), (1,), (None,)], "bucket_id int")
    assert sorted((r["minimizer"], r["bucket_id"]) for r in valid_entries(entries, buckets).collect()) == [(1, 1), (1, 1)]


@pytest.mark.parametrize("partitions", [4, 64])
def test_no_light_key_fills_a_task(spark, partitions):
    """A key just under the share is light, and is a quarter of a mean partition; one just above it is salted."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = 64_000
        under = int(n / partitions / 4 * 0.98)
        rows = [(-1,)] * under + [(-2,)] * (n // 3) + [(i,) for i in range(n - under - n // 3)]
        df = spark.createDataFrame(rows, "k long")
        total, heavy = heavy_keys(df, ["k"])
        assert total == n and -2 in heavy["k"] and len(heavy["k"]) <= 8 * partitions
        light = df.where(~is_heavy("k", heavy["k"])).repartition(partitions, "k").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in light) <= 2 * n / partitions
        got = {r["k"]: r["n_rows"] for r in key_counts(df.withColumn("v", F.lit(1)), "k", "v", heavy["k"]).where("k < 0").collect()}
        assert got == {-1: under, -2: n // 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
