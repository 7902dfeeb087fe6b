"""Shared spans against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import spans


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def plain(rows, length):
    """(id, text, position) of every shared window."""
    where, found = defaultdict(set), set()
    texts = {(i, s.upper()) for i, s in rows if i is not None and s is not None}
    for i, s in texts:
        for p in range(len(s) - length + 1):
            if set(s[p : p + length]) <= set("ACGT"):
                where[s[p : p + length]].add((i, s, p))
    for places in where.values():
        if len({i for i, _, _ in places}) > 1:
            found |= places
    return found


@pytest.fixture(scope="module")
def rows():
    shared, long = dna(1, 90), dna(2, 700)
    hot = dna(3, 70)
    out = [
        (1, dna(10, 40) + shared + dna(11, 20)), (2, shared.lower()), (2, shared.lower()), (3, "GG" + shared[:50] + "N" + shared[50:]),
        (4, long), (5, dna(12, 100) + long[150:560] + dna(13, 30)), (6, long[140:300]), (6, long[500:600]),
        (7, "A" * 150), (8, "T" + "A" * 80 + "C"), (9, "AT" * 60), (10, "TA" * 50 + "G"), (11, "é" * 3 + long[600:]), (12, "U" + long[600:]),
        (13, dna(14, 64)), (14, dna(14, 64)[:63]), (15, dna(15, 64)), (16, dna(15, 64)), (17, None), (18, ""), (None, shared),
        (19, dna(16, 80) + dna(16, 80)), (20, "ACGT"), (21, dna(17, 31)),
    ]
    return out + [(100 + i, dna(200 + i, 10) + hot) for i in range(40)]


@pytest.mark.parametrize("length", [32, 40, 64, 100, 128, 200])
@pytest.mark.parametrize(("share", "chunk"), [(0.001, 1 << 20), (0.05, 61)])
def test_windows(spark, monkeypatch, rows, length, share, chunk):
    monkeypatch.setattr(spans, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "id long, sequence string").withColumns({"key": F.lit("x"), "pos": F.lit(1), "n": F.lit(2)})
    keys = {(r["id"], r["k"]): r["s"] for r in df.select("id", F.upper("sequence").alias("s"), F.xxhash64(F.upper("sequence")).alias("k")).collect()}
    got = [(r["id"], keys[r["id"], r["key"]], r["pos"]) for r in spans.shared_windows(df, length, share).collect()]
    assert set(got) == plain(rows, length) and len(got) == len(set(got))


def test_spans_and_shares(spark, rows):
    df = spark.createDataFrame(rows, "id long, sequence string")
    found = spans.shared_spans(df, 64)
    covered, longest = defaultdict(set), defaultdict(int)
    for level in (64, 128, 256, 512):
        for i, s, p in plain(rows, level):
            covered[i] |= {(s, q) for q in range(p, p + level)}
            longest[i] = max(longest[i], level)
    got = {r["id"]: r for r in spans.shared_shares(df, found).collect()}
    texts = defaultdict(set)
    for i, s in rows:
        if i is not None:
            texts[i].add((s or "").upper())
    assert {i: r["n_letters"] for i, r in got.items()} == {i: sum(map(len, t)) for i, t in texts.items()}
    assert {i: r["n_shared"] for i, r in got.items() if r["n_shared"]} == {i: len(c) for i, c in covered.items()}
    assert {i: r["longest"] for i, r in got.items() if r["longest"]} == dict(longest)
    one = {(r["start"], r["length"], r["longest"]) for r in found.where("id = 5").collect()}
    assert one == {(100, 410, 256)}


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, sequence string")
    assert spans.shared_windows(empty, 64).count() == 0
    assert spans.shared_shares(empty, spans.shared_spans(empty, 64)).count() == 0
    with pytest.raises(ValueError):
        spans.shared_windows(empty, 31)
    with pytest.raises(ValueError):
        spans.shared_windows(empty.drop("id"), 64)
