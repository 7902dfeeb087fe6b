"""Overlaps, top items and term counts against plain Python, with nulls, ties, repeats and hot keys."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import ngrams, overlap, topn


@pytest.fixture(scope="module")
def members():
    rng = random.Random(2)
    rows = []
    for m in range(300):
        degree = rng.choice([1, 1, 2, 3, 30, 90])
        rows += [(s, m) for s in rng.sample(range(-40, 120), degree)]
    rows += [(5, 1)] * 3000 + [(None, 1), (7, None), (2**31 - 1, 3), (-(2**31), 3)]  # one pair is a third of all rows
    rng.shuffle(rows)
    return rows


def plain_overlaps(rows):
    sets = defaultdict(set)
    for s, m in rows:
        if s is not None and m is not None:
            sets[s].add(m)
    if len(sets) > 1000:
        holders, both = defaultdict(list), Counter()
        for s in sets:
            for m in sets[s]:
                holders[m].append(s)
        for h in holders.values():
            both.update(itertools.combinations(sorted(h), 2))
        return {(a, b, n, len(sets[a]), len(sets[b])) for (a, b), n in both.items()}
    pairs = ((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2))
    return {p for p in pairs if p[2]}


@pytest.mark.parametrize("light", [0, 2, 16, 1000])
def test_overlaps(spark, members, light):
    df = spark.createDataFrame(members, "s int, m long").withColumns({"n": F.lit(1), "bits": F.lit("x")})
    got = overlap.overlap_sizes(df, "s", "m", light).collect()
    assert {tuple(r) for r in got} == plain_overlaps(members) and len(got) == len(plain_overlaps(members))


def test_overlaps_in_small_blocks(monkeypatch, members):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(overlap, "BLOCK", 7)
    monkeypatch.setattr(overlap, "ROWS", 5)
    monkeypatch.setattr(overlap, "HELD", 100)
    rng = np.random.default_rng(1)
    rows, want = [], Counter()
    for _ in range(60):
        sets, n = sorted(rng.choice(200, rng.integers(1, 60), replace=False).tolist()), int(rng.integers(1, 9))
        words = defaultdict(int)
        for s in sets:
            words[s >> 6] |= 1 << (s & 63)
        rows.append((list(words), [b - 2**64 if b >= 2**63 else b for b in words.values()], n))
        for a, b in itertools.combinations_with_replacement(sets, 2):
            want[a, b] += n
    batches = [pa.RecordBatch.from_pylist([{"words": w, "bits": b, "n": n} for w, b, n in rows[i : i + 9]]) for i in range(0, 60, 9)]
    got = Counter()
    for batch in overlap._count_pairs(4)(iter(batches)):
        for r in batch.to_pylist():
            got[r["set_a"], r["set_b"]] += r["n"]
    assert got == want


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], "s int, m long")
    assert overlap.overlap_sizes(empty, "s", "m").count() == 0
    alone = spark.createDataFrame([(1, 1), (2, 2), (None, None)], "s int, m long")
    assert overlap.overlap_sizes(alone, "s", "m").count() == 0


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(4)
    rows = [(0, i, float(rng.randrange(6)) / 4) for i in range(900)]  # a third of all rows, many ties
    rows += [(1, i, 0.5) for i in range(300)]  # one tie
    rows += [(2, rng.randrange(3), rng.random()) for _ in range(300)]  # few items, scored often
    rows += [(10 + rng.randrange(300), rng.randrange(9), rng.choice([0.1, 0.2, -0.0, 0.0, float("inf")])) for _ in range(1200)]
    rows += [(None, 1, 0.5), (10, None, 0.5), (10, 1, None), (10, 2, float("nan")), (0, 5, 9.0), (0, 5, 9.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "ranges"), [(1, 2), (3, 8), (50, 4), (2000, 3)])
def test_top(spark, scored, n, ranges):
    df = spark.createDataFrame(scored, "query long, item long, x double").withColumns({"g": F.lit(1), "r": F.lit(2), "rank": F.lit(3)})
    got = topn.top_per_group(df, "query", "item", "x", n, share=0.05, ranges=ranges).collect()
    best = defaultdict(dict)
    for g, i, s in scored:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(s, best[g].get(i, s))
    want = set()
    for g, items in best.items():
        for rank, (i, s) in enumerate(sorted(items.items(), key=lambda t: (-t[1], t[0]))[:n], 1):
            want.add((g, i, s + 0.0, rank))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_of_nothing(spark):
    empty = spark.createDataFrame([], "q long, i int, s double")
    assert topn.top_per_group(empty, "q", "i", "s", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_per_group(empty, "q", "i", "s", 0)
    with pytest.raises(ValueError):
        topn.top_per_group(empty, "q", "i", "x", 1)


def plain_ngrams(docs, max_n):
    count, records, outer = Counter(), defaultdict(set), defaultdict(set)
    for a, b, terms in docs:
        for i in range(len(terms or [])):
            for n in range(1, max_n + 1):
                run = tuple(terms[i : i + n])
                if len(run) < n or None in run or a is None or b is None:
                    break
                count[run] += 1
                outer[run].add(a)
                records[run].add((a, b))
    return {(len(g), *g, *[None] * (max_n - len(g)), c, len(outer[g]), len(records[g])) for g, c in count.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("max_n", [1, 3])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_ngrams(spark, kind, max_n, batch):
    rng = random.Random(max_n)
    word = (lambda x: x) if kind == "long" else (lambda x: f"w{x}é" if x else "")
    docs = []
    for r in range(60):
        terms = [word(0 if rng.random() < 0.4 else rng.randrange(1, 9)) for _ in range(rng.randrange(12))]
        if r % 9 == 0 and terms:
            terms[rng.randrange(len(terms))] = None
        docs.append((r % 7, r, terms))
    docs += [docs[5], (3, 99, None), (3, 98, []), (None, 1, [word(1)]), (2, None, [word(1)])]
    df = spark.createDataFrame(docs, f"a int, b long, terms array<{kind}>").withColumns({"w": F.lit(1), "salt": F.lit(1)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        runs = ngrams.suffixes(df, ["a", "b"], "terms", max_n)
        for share in (0.05, 1.0):  # the frequent term is hot, or nothing is
            got = ngrams.ngram_counts(runs, ["a", "b"], max_n, share=share, salts=3).collect()
            assert {tuple(r) for r in got} == plain_ngrams(docs, max_n)
            assert len(got) == len(plain_ngrams(docs, max_n))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ngrams_of_nothing(spark):
    empty = spark.createDataFrame([], "r long, terms array<string>")
    assert ngrams.ngram_counts(ngrams.suffixes(empty, ["r"], "terms", 2), ["r"], 2).count() == 0


def test_overlaps_of_many_sets(spark):
    """100,000 sets: most members in few of them, two in 1,500."""
    rng = random.Random(6)
    rows = [(rng.randrange(100_000), m) for m in range(60_000) for _ in range(rng.choice([1, 2, 3]))]
    rows += [(s, m) for m in (-1, -2) for s in rng.sample(range(100_000), 1500)]
    df = spark.createDataFrame(rows, "s int, m long")
    want = plain_overlaps(rows)
    got = overlap.overlap_sizes(df, "s", "m")
    assert got.count() == len(want) > 1_000_000
    few = {p for p in want if p[2] >= 0.5 * min(p[3], p[4]) and p[2] > 1}
    assert {tuple(r) for r in overlap.overlap_sizes(df, "s", "m", min_share=0.5).where("n_both > 1").collect()} == few


def test_top_with_the_share_of_the_session(spark, scored):
    """Without a share the partitions give it; the groups 0 and 1 are hot."""
    df = spark.createDataFrame(scored, "q long, i long, s double")
    one, two = (topn.top_per_group(df, "q", "i", "s", 4, share=x).collect() for x in (None, 1.0))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
