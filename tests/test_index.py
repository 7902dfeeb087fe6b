"""Chunks, buckets, indices, classification and log-ratios on small made-up references."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake.functions.kernels import SketchParams
from strandlake.operators import chunks, classify, index, logratio, orientation
from strandlake.operators.reads import latest_reads, zip_mates

P = SketchParams(16, 5)


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def reverse(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(1, 1, dna(1, 400)), (1, 2, dna(2, 300)), (2, 3, dna(3, 400)), (2, 4, dna(1, 100)), (3, 5, "N" * 80), (3, 6, None)]
    return spark.createDataFrame(rows, "bucket_id int, feature_idx long, sequence string").cache()


def reads(spark, *rows):
    return spark.createDataFrame(rows, "id long, sequence string, pair_sequence string")


def test_chunks(spark):
    rows = [
        (1, 1, "GG"), (1, 0, "AA"), (2, 0, "A"), (2, 2, "C"), (3, 1, "A"), (4, 0, "A"), (4, 0, "A"), (5, 0, None), (None, 0, "A"),
        (6, 0, ""), (7, None, "A"),
    ]
    df = spark.createDataFrame(rows, "feature_idx long, chunk_index int, chunk_data string").withColumn("n", F.lit(1))
    status = {r["feature_idx"]: r["status"] for r in chunks.chunk_report(df).collect()}
    assert status == {1: "ok", 2: "gap", 3: "start", 4: "duplicate", 5: "null", None: "null", 6: "ok", 7: "null"}
    assert {tuple(r) for r in chunks.reassemble(df).collect()} == {(1, "AAGG"), (6, "")}
    with pytest.raises(PySparkException, match="feature"):
        chunks.reassemble(df, strict=True).collect()
    assert chunks.reassemble(df.limit(0)).count() == 0


def test_chunked_equals_whole(spark, refs):
    pieces = [(r["feature_idx"], i // 37, r["sequence"][i : i + 37]) for r in refs.collect() if r["sequence"] for i in range(0, len(r["sequence"]), 37)]
    random.Random(1).shuffle(pieces)
    df = spark.createDataFrame(pieces, "feature_idx long, chunk_index int, chunk_data string")
    want = {(r["feature_idx"], r["sequence"]) for r in refs.collect() if r["sequence"]}
    assert {tuple(r) for r in chunks.reassemble(df, strict=True).collect()} == want


@pytest.mark.parametrize("size", [1, 7, 60, 1000])
def test_pieces_make_the_whole_sketch(spark, refs, size):
    """Of pieces shorter and longer than a window, with empty ones between."""
    pieces = []
    for r in refs.where("sequence IS NOT NULL").collect():
        cut = [r["sequence"][i : i + size] for i in range(0, len(r["sequence"]), size)]
        cut[1:1] = ["", ""]
        pieces += [(r["feature_idx"], i, t) for i, t in enumerate(cut)]
    random.Random(1).shuffle(pieces)
    df = spark.createDataFrame([*pieces, (90, 1, "ACGT"), (91, 0, None)], "feature_idx long, chunk_index int, chunk_data string")
    mapping = spark.createDataFrame([(r["feature_idx"], f"b{r['bucket_id']}") for r in refs.collect()] + [(90, "b1")], "feature_idx long, bucket_name string")
    whole, parts = (chunks.features_in_buckets(df, mapping, pieces_for=p) for p in (None, P))
    want, got = (sorted(map(tuple, index.build_index(x, P).collect())) for x in (whole, parts))
    assert got == want and want
    assert sorted(map(tuple, orientation.build_oriented(parts, P).collect())) == sorted(map(tuple, orientation.build_oriented(whole, P).collect()))
    assert chunks.overlapping_pieces(df.limit(0), P).count() == 0


def test_join_by_size(spark, refs, monkeypatch):
    """Broadcast, hashed or sorted, the hits are the same."""
    built = index.build_index(refs, P)
    query = reads(spark, *((i, dna(i, 200), None) for i in range(6)))
    got = []
    for broadcast, hashed in ((10**9, 10**9), (0, 10**9), (0, 0)):
        monkeypatch.setattr(classify, "BROADCAST_ENTRIES", broadcast)
        monkeypatch.setattr(classify, "HASHED_ENTRIES", hashed)
        got.append(sorted(map(tuple, classify.classify(query, built, P, 0.0).collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_mapping(spark):
    rows = [(1, "b"), (1, "b"), (2, "a\t"), (3, "a_"), (4, "x"), (4, "y"), (None, "z"), (5, None)]
    df = spark.createDataFrame(rows, "feature_idx long, bucket_name string")
    got = chunks.feature_buckets(df)
    assert {tuple(r) for r in got.collect()} == {(1, "b"), (2, "a_"), (3, "a_")}
    assert {tuple(r) for r in chunks.bucket_ids(got).collect()} == {("a_", 1), ("b", 2)}
    for part in (df, df.where("feature_idx = 1"), df.where("feature_idx IN (2, 3)")):
        with pytest.raises(ValueError):
            chunks.feature_buckets(part, strict=True)


def test_split_into_buckets(spark):
    files = spark.createDataFrame([(f"f{i}", f"g{i % 3}") for i in range(8)], "file_path string, group_label string")
    got = chunks.split_into_buckets(files, 3).groupBy("bucket_name").count().collect()
    assert {tuple(r) for r in got} == {("bucket_0", 3), ("bucket_1", 3), ("bucket_2", 2)}
    for n in (0, 9):
        with pytest.raises(ValueError):
            chunks.split_into_buckets(files, n)


def test_self_match_and_reverse(spark, refs):
    built = index.build_index(refs, P)
    query = dna(1, 400)[50:350]
    got = classify.classify(reads(spark, (1, query, None), (2, reverse(query), None), (3, "", None), (4, None, None), (5, "ACGT", None)), built, P)
    best = {r["query_id"]: (r["bucket_id"], r["score"]) for r in classify.best_hits(got).collect()}
    assert best == {1: (1, 1.0), 2: (1, 1.0)}


def test_threshold_is_inclusive(spark, refs):
    built = index.build_index(refs, P)
    query = reads(spark, (1, dna(3, 200) + dna(9, 200), None))
    exact = classify.classify(query, built, P, 0.0).where("bucket_id = 2").first()["score"]
    assert 0 < exact < 1
    assert classify.classify(query, built, P, exact).where("bucket_id = 2").count() == 1
    assert classify.classify(query, built, P, exact + 1e-9).where("bucket_id = 2").count() == 0
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            classify.classify(query, built, P, bad)


def test_negative_filter(spark, refs):
    built = index.build_index(refs, P)
    query = reads(spark, (1, dna(1, 400), None), (2, dna(1, 200) + dna(3, 200), None))
    without = classify.classify(query, built, P, 0.0, negative=built.where("bucket_id = 1"))
    got = {(r["query_id"], r["bucket_id"]): r["score"] for r in without.collect()}
    assert (1, 1) not in got and (2, 1) not in got
    plain = {(r["query_id"], r["bucket_id"]): r["score"] for r in classify.classify(query, built, P, 0.0).collect()}
    assert got[2, 2] > plain[2, 2]
    nothing = classify.classify(query, built, P, 0.0, negative=classify.query_sketch(query, P))
    assert nothing.count() == 0


def test_pairs(spark, refs):
    built = index.build_index(refs, P)
    text = dna(1, 400)
    rows = [(1, text[:120], reverse(text[200:320])), (2, text[:120], None), (3, text[:120], "AC")]
    got = {r["query_id"]: r["score"] for r in classify.classify(reads(spark, *rows), built, P, pair="pair_sequence").where("bucket_id = 1").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0}


def test_best_hits(spark):
    rows = [(1, 5, 0.5), (1, 3, 0.5), (1, 9, 0.4), (2, 1, float("nan")), (2, 2, 0.1), (3, 1, None), (None, 1, 0.9), (4, None, 0.9), (2, 2, 0.1)]
    hits = spark.createDataFrame(rows, "query_id long, bucket_id int, score double")
    assert {tuple(r) for r in classify.best_hits(hits).collect()} == {(1, 3, 0.5), (2, 2, 0.1)}
    assert {tuple(r) for r in classify.top_ranked(hits.where("query_id = 1"), 2).collect()} == {(1, 3, 0.5, 1), (1, 5, 0.5, 2)}
    shown = classify.wide(hits.where("query_id IN (1, 4)"), [3, 5, 7]).collect()
    assert {tuple(r) for r in shown} == {(1, 0.5, 0.5, 0.0), (4, 0.0, 0.0, 0.0)}
    names = spark.createDataFrame([(5, "five")], "bucket_id int, bucket_name string")
    assert {r["bucket_name"] for r in classify.named(hits, names).collect()} == {"five", "unknown"}


def test_wide_has_every_bucket(spark, tmp_path):
    """More buckets than the 64 columns of the SQL; each read is a feature whole."""
    from strandlake.plans.classify_queries import classify_wide

    texts = [(i, dna(100 + i, 120)) for i in range(1, 71)]
    tables = {
        "genome_chunks": ([(i, 0, t) for i, t in texts], "feature_idx long, chunk_index int, chunk_data string"),
        "feature_map": ([(i, f"bucket {i:03}") for i, _ in texts], "feature_idx long, bucket_name string"),
        "read_records": ([(i, f"r{i}", t, None, None) for i, t in texts], "id long, read_id string, sequence string, pair_sequence string, received_at timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = classify_wide(spark, str(tmp_path))
    assert got.columns == ["query_id", *(f"bucket_{b}" for b in range(1, 71))]
    assert all(r[f"bucket_{r['query_id']}"] == 1.0 for r in got.collect()) and got.count() == 70


def test_intersections_without_feature_1(spark, tmp_path):
    from strandlake.plans.sketch_queries import set_intersections

    chunks_ = [(1, 1, dna(1, 90)), (2, 0, dna(2, 90)), (3, 0, dna(3, 90))]  # 1 has no start
    spark.createDataFrame(chunks_, "feature_idx long, chunk_index int, chunk_data string").write.parquet(str(tmp_path / "genome_chunks.parquet"))
    names = spark.createDataFrame([(i, "b") for i in (1, 2, 3)], "feature_idx long, bucket_name string")
    names.write.parquet(str(tmp_path / "feature_map.parquet"))
    assert {tuple(r) for r in set_intersections(spark, str(tmp_path)).collect()} == {(2, 0, 0, 0), (3, 0, 0, 0)}


def test_aggregate_is_a_pooled_read(spark, refs):
    built = index.build_index(refs, P)
    query = reads(spark, (1, dna(1, 200), None), (2, dna(3, 200), None), (3, dna(1, 200), None))
    got = {r["bucket_id"]: r["score"] for r in classify.aggregate(query, built, P, 0.0).collect()}
    sketch = {(r["strand"], r["minimizer"]) for r in classify.query_sketch(query, P).collect()}
    for b in (1, 2):
        own = {r["minimizer"] for r in built.where(f"bucket_id = {b}").collect()}
        want = max(sum(s == t and m in own for s, m in sketch) / sum(s == t for s, _ in sketch) for t in (0, 1))
        assert got[b] == pytest.approx(want)


def test_index_is_distinct_and_sorted(spark, refs):
    built = index.sorted_for_pruning(index.build_index(refs.union(refs), P), 3)
    rows = [(r["minimizer"] % 2**64, r["bucket_id"]) for r in built.collect()]
    assert rows == sorted(set(rows))
    stats = index.index_stats(built).first()
    assert stats["n_entries"] == len(rows) and stats["min_minimizer"] % 2**64 == rows[0][0]
    empty = index.index_stats(built.limit(0)).first()
    assert (empty["n_entries"], empty["n_minimizers"], empty["avg_buckets"]) == (0, 0, None)


@pytest.mark.parametrize("lengths", [[10, 20, 30], [10, 20, 30, 40], [5, 5], [7]])
def test_file_stats(spark, lengths):
    import statistics

    rows = [("b", f"f{i}", n - 1) for i, n in enumerate(lengths)] + [("b", f"f{i}", 1) for i in range(len(lengths))] + [("b", "f0", None)]
    got = index.file_stats(spark.createDataFrame(rows, "b string, f string, n int"), "b", "f", "n").first()
    want = (statistics.mean(lengths), statistics.median(lengths), statistics.pstdev(lengths), min(lengths), max(lengths))
    assert tuple(got)[1:] == pytest.approx(want)


def test_merge(spark, refs):
    built = index.build_index(refs, P)
    a, b = built.where("bucket_id = 1"), built.where("bucket_id = 2")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "bucket_id int, bucket_name string")
    left, right = names.where("bucket_id = 1"), names.where("bucket_id = 2")
    ids = index.merged_ids(right, left)
    assert [(r["old_id"], r["bucket_id"]) for r in ids.orderBy("bucket_id").collect()] == [(2, 1), (1, 2)]
    merged = index.merge_indices(b, a, ids)
    assert merged.count() == built.count()
    shared = b.join(a, "minimizer").count()
    assert shared > 0
    assert index.merge_indices(b, a, ids, subtract_primary=True).count() == built.count() - shared
    counts = index.merge_counts(a, b).first()
    assert (counts["original"], counts["removed"]) == (a.count(), shared)
    index.check_merge(left, right, index.subtract(b, a))
    with pytest.raises(ValueError, match="occur in both"):
        index.check_merge(names, right)
    with pytest.raises(ValueError, match="no minimizers left"):
        index.check_merge(left, right, b.limit(0))
    with pytest.raises(ValueError, match="must have"):
        index.check_merge(left, right.limit(0))


def test_resolve_bucket(spark):
    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "7")], "bucket_id int, bucket_name string")
    assert index.resolve_bucket(names, " x ") == 1 and index.resolve_bucket(names, "7") == 7
    for bad in ("", "y", "z"):
        with pytest.raises(ValueError):
            index.resolve_bucket(names, bad)


def test_orientation(spark):
    text = dna(11, 500)
    rows = [(1, 1, text), (1, 2, reverse(text[100:400])), (1, 3, text[:200]), (2, 4, dna(12, 200)), (2, 5, "")]
    features = spark.createDataFrame(rows, "bucket_id int, feature_idx long, sequence string")
    for build in (orientation.build_oriented, orientation.build_growing):
        got = build(features, P)
        forward = index.build_index(features.where("feature_idx IN (1, 4)"), P)
        assert got.where("bucket_id = 2").exceptAll(forward).count() == 0
        extra = got.where("bucket_id = 1").exceptAll(forward).count()
        assert extra <= 4  # windows at the ends of the parts
    from strandlake.operators.sketch import minimizers

    chosen = orientation.choose_strands(minimizers(features, P, ["bucket_id", "feature_idx"]), orientation.baselines(features))
    assert {r["feature_idx"]: r["strand"] for r in chosen.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_log_ratio(spark, refs):
    p = SketchParams(32, 5)  # long enough that nothing matches by chance
    built = index.build_index(refs, p)
    num, den = (built.where(f"bucket_id = {b}") for b in (1, 2))
    query = reads(spark, (1, dna(2, 200), None), (2, dna(3, 200), None), (3, dna(77, 200), None), (4, dna(1, 90), None), (5, None, None))
    got = {r["query_id"]: r for r in logratio.log_ratio(query, num, den, p).collect()}
    assert {i: str(got[i]["log_ratio"]) for i in (3, 5)} == {3: "nan", 5: "nan"}
    assert got[4]["log_ratio"] == 0.0
    swapped = {r["query_id"]: r for r in logratio.log_ratio(query, den, num, p).collect()}
    for i in (1, 2):
        assert got[i]["log_ratio"] == -swapped[i]["log_ratio"]
    skipped = {r["query_id"]: tuple(r)[2:] for r in logratio.log_ratio(query, num, den, p, skip=1.0).collect()}
    assert skipped[1] == (None, float("inf"), "num_high") and skipped[4] == (None, float("inf"), "num_high")
    assert skipped[2][2] == "none"
    ids = lambda positive: {r["query_id"] for r in logratio.passing(logratio.log_ratio(query, num, den, p), positive).collect()}
    assert ids(False) == {2, 3, 5} and ids(True) == {1, 3, 5}
    kept = logratio.passing_reads(query, logratio.log_ratio(query, num, den, p))
    assert kept.columns == query.columns and kept.count() == 3
    logratio.check_single_bucket(num)
    with pytest.raises(ValueError):
        logratio.check_single_bucket(built)
    for bad in (1.5, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            logratio.check_skip(bad)


def test_latest_reads(spark):
    rows = [(1, "A", 5), (1, "C", 9), (1, "B", 9), (2, None, None), (2, "T", None), (None, "A", 1)]
    df = spark.createDataFrame(rows, "id long, sequence string, t long").select("id", "sequence", F.timestamp_seconds("t").alias("received_at"))
    assert {(r["id"], r["sequence"]) for r in latest_reads(df).collect()} == {(1, "B"), (2, None)}


def test_zip_mates(spark):
    schema = "ordinal long, header string, sequence string, quality string"
    one = spark.createDataFrame([(0, "a/1", "AC", "II"), (1, "b", "AC", None)], schema)
    two = spark.createDataFrame([(0, "a/2 x", "GT", "JJ"), (1, "b", "G", None), (2, "c", "T", None)], schema)
    assert {(r["read_id"], r["seq1"], r["seq2"]) for r in zip_mates(one, two).collect()} == {("a", "AC", "GT"), ("b", "AC", "G")}
    for bad in (two.where("ordinal = 0"), two.withColumn("header", F.lit("z"))):
        with pytest.raises(PySparkException):
            zip_mates(one, bad).collect()
    assert zip_mates(one, two.where("ordinal = 0"), strict=False).where("seq2 IS NULL").count() == 1
