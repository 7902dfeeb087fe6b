"""Token sizes, containers, mixing and splitting."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import mixing, packing, splitting, tokens

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+")
TEXT = st.text(alphabet="ab_9 \t\n\v\f\r.,é  漢-", max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 30))
def test_token_counts(texts, chunk):
    old, tokens.CHUNK = tokens.CHUNK, chunk
    try:
        got = tokens.count_tokens(pa.array(texts, pa.string())).tolist()
    finally:
        tokens.CHUNK = old
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string").withColumn("__text", F.lit(1))
    assert [tuple(r) for r in tokens.with_sizes(df, "text", ["id"]).orderBy("id").collect()] == [(1, 2), (2, 0)]
    with pytest.raises(ValueError):
        tokens.with_sizes(df.withColumnRenamed("id", "n_tokens"), "text", ["n_tokens"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 60))
def test_pack(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    where = packing.pack(sizes, capacity)
    fills = np.bincount(where, weights=sizes) if len(sizes) else np.zeros(0)
    assert (fills <= capacity).all() and (fills > 0).all()
    assert len(fills) <= len(packing.best_fit(sizes, capacity)[1])


def test_search_empties_containers():
    # From one item a container: 8+7, 8+7 and 5+5+5 are the best.
    sizes = np.array([8, 8, 7, 7, 5, 5, 5])
    where, fills = np.array([0, 1, 2, 3, 4, 5, 6]), sizes.astype(np.int64).copy()
    before = (fills**2).sum()
    packing.local_search(sizes, where, fills, 15)
    assert np.count_nonzero(fills) == 3 and (fills**2).sum() > before
    assert fills.tolist() == np.bincount(where, weights=sizes, minlength=7).tolist()


@pytest.mark.parametrize(("x", "others"), [(6, [[9]]), (10, [[8, 5]]), (10, [[4, 4, 5]])])
def test_steps_raise_squares(x, others):
    """A move, an exchange for one, an exchange for two."""
    sizes = np.array([x, *(s for o in others for s in o)])
    where = np.array([0, *(b for b, o in enumerate(others, 1) for _ in o)])
    fills = np.bincount(where, weights=sizes).astype(np.int64)
    before = (fills**2).sum()
    assert packing._step(sizes, where, fills, 0, 15)
    assert (fills**2).sum() > before and (fills <= 15).all()


def test_search_goes_on_after_failures():
    sizes = np.random.default_rng(0).integers(300, 1101, 1000)
    where = packing.pack(sizes, 2048)
    assert np.bincount(where, weights=sizes).max() <= 2048
    assert where.max() + 1 <= 353  # 355 if it ends after 200 failures in all


def test_containers(spark):
    rng = random.Random(1)
    texts = ["w " * rng.choice([1, 30, 70, 100, 101, 250, 1000]) for _ in range(300)] + [None, "", " \n", "w " * 100_000, "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "n_tokens": F.lit(1), "fill": F.lit(2)})
    got = packing.fill_containers(df, 100, shard_items=64).toPandas()
    assert got.groupby("container_id")["n_tokens"].sum().max() <= 100
    assert (got.groupby("container_id")["n_tokens"].sum() == got.groupby("container_id")["fill"].first()).all()
    sizes = defaultdict(int)
    for i, t in rows:
        sizes[i] += len(TOKEN.findall(t or ""))
    own = got.groupby("doc_id", dropna=False)["n_tokens"].sum()
    assert {None if i != i else int(i): int(n) for i, n in own.items()} == sizes
    assert set(got[~got["is_split"]].groupby("doc_id").size().items()) >= {(7.0, 3)} if sizes[7] <= 300 else True
    large = {i for i, t in rows if len(TOKEN.findall(t or "")) > 100}
    assert set(got[got["is_split"]]["doc_id"].astype(int)) == large
    assert packing.fill_containers(df.limit(0), 100).count() == 0
    waste = 1 - got["n_tokens"].sum() / (100 * got["container_id"].nunique())
    assert waste < 0.05
    with pytest.raises(ValueError):
        packing.fill_containers(df, 0)


def check_pieces(text, pieces, limit, overlap):
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert [p["piece"] for p in pieces] == list(range(1, len(pieces) + 1))
    assert pieces[0]["char_start"] == 0 and pieces[-1]["char_end"] == len(text) and pieces[-1]["token_end"] == len(spans)
    whole = text[: pieces[0]["char_end"]]
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b["token_start"] + b["overlap"] == a["token_end"] and b["overlap"] <= overlap
        whole += text[a["char_end"] : b["char_end"]]
        if b["overlap"] < min(overlap, a["token_end"]):  # less only for a line that fits no other way
            assert b["token_end"] - b["token_start"] == limit
    assert whole == text
    for p in pieces:
        assert len(TOKEN.findall(text[p["char_start"] : p["char_end"]])) == p["token_end"] - p["token_start"] <= limit
        if p["cut"] in ("line", "block"):
            assert "\n" in text[p["char_start"] : p["char_end"]][-(len(text) - len(text.rstrip()) + 200) :]
    cut_lines = {p["cut_line"] for p in pieces if p["cut_line"] is not None}
    assert cut_lines == {i for i, line in enumerate(text.split("\n"), 1) if len(TOKEN.findall(line)) > limit}


@pytest.mark.parametrize(("limit", "overlap", "reach"), [(20, 0, None), (20, 5, None), (20, 19, 3), (7, 2, 0), (1, 0, None)])
def test_pieces(spark, limit, overlap, reach):
    rng = random.Random(limit + overlap)
    texts = [None, "", " \n ", "a b"]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 30)):
            lines.append(rng.choice([" ", "  ", "."]).join(rng.choice(["ab", "é漢", "x_1", "(", "+="]) for _ in range(rng.choice([0, 0, 1, 3, 8, 19, 20, 21, 60]))))
        texts.append(rng.choice(["\n", "\r\n"]).join(lines))
    texts.append("w " * 50_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"piece": F.lit(1), "cut": F.lit("x")})
    by = defaultdict(list)
    for r in splitting.split_documents(df, limit, overlap, reach).orderBy("doc_id", "piece").collect():
        by[r["doc_id"]].append(r)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        check_pieces(t or "", by[i], limit, overlap)
    assert splitting.split_documents(df.limit(0), limit).count() == 0


def test_pieces_are_balanced_and_snap():
    strength = np.ones(100, np.int8)
    assert [e for e, _ in splitting.find_cuts(strength, 40, 0, 0)] == [33, 66, 100]
    strength[[30, 37]] = [2, 3]
    assert splitting.find_cuts(strength, 40, 0, 10)[0] == (37, 0)  # the blank line, though the line end is nearer
    with pytest.raises(ValueError):
        splitting.split_documents(None, 5, 5)


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    tokens_ = rng.integers(100, 1000, 60).astype(float)
    source, lang, topic = (rng.integers(0, n, 60) for n in (4, 3, 5))
    own = np.bincount(source, weights=tokens_)
    wanted = own * np.array([0.5, 0.9, 1.3, 5.0])
    caps = np.array([1.0, 2.0, 2.0, 2.0])
    rate = mixing.rake(tokens_, source, [lang, topic], wanted, caps)
    got = np.bincount(source, weights=tokens_ * rate)
    assert got[:3] == pytest.approx(wanted[:3]) and got[3] == pytest.approx(2 * own[3])
    assert (rate <= caps[source]).all() and (rate >= 0).all()


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        source = rng.choices(["a", " A\t", "b", "c", None, "other"], [4, 2, 3, 1, 1, 1])[0]
        rows.append((i, "w " * int(rng.paretovariate(1.2) * 5), source, rng.choice(["x", "Y ", None]), rng.choice(["s/f", "d/f", "f", None])))
    rows += [(None, "a b c", "a", None, None)] * 5 + [(9000, None, "b", "x", "s/f"), (9001, "", "b", "x", "s/f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, file_path string")
    return df.withColumns({"rate": F.lit(1), "uses": F.lit(1), "row": F.lit(1)})


def test_mix(spark, mixed):
    goals = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 2), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix(mixed, goals)
    draw, report = mix.draw.toPandas(), {r["source"]: r for r in mix.report.collect()}
    total = sum(len(TOKEN.findall(r["text"] or "")) for r in mixed.where("source IS NOT NULL").collect())
    assert set(report) == {"a", "b", "c", "none"}
    caps = {"a": 1, "b": 2, "c": 2}
    assert all(draw[draw["source"] == s]["uses"].max() <= c for s, c in caps.items())
    for s, r in report.items():
        own = draw[draw["source"] == s]
        assert r["drawn_tokens"] == (own["uses"] * own["n_tokens"]).sum()
        assert r["reachable"] == (r["tokens"] * r["max_repeats"] >= r["target_share"] * total)
        if r["reachable"]:
            assert abs(r["drawn_tokens"] - r["target_share"] * total) <= own["n_tokens"].max()
        else:
            assert r["drawn_tokens"] == r["tokens"] * r["max_repeats"]
    assert sum(r["share"] for r in report.values()) == pytest.approx(1)
    again = mixing.mix(mixed, goals).draw.toPandas()
    key = ["source", "doc_id", "uses"]
    assert again[key].sort_values(key).values.tolist().__repr__() == draw[key].sort_values(key).values.tolist().__repr__()


def test_mix_holds_every_topic(spark):
    """60 topics; the ten smallest lie in one source each, five in a, which is drawn less, and five in b."""
    places = [(s, f"t{t:02}") for t in range(50) for s in "ab" for _ in range(30)]
    places += [("a" if t < 55 else "b", f"t{t}") for t in range(50, 60) for _ in range(40)]
    rows = [(i, "w w w w", s, "x", f"{t}/f") for i, (s, t) in enumerate(places)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, file_path string")
    goals = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], "source string, target_share double, max_repeats int")
    uses = {r["doc_id"]: r["uses"] for r in mixing.mix(df, goals).draw.collect()}
    assert sum(n for i, n in uses.items() if places[i][0] == "a" and places[i][1] >= "t50") >= 190  # of 200


def test_mix_of_nothing(spark, mixed):
    goals = spark.createDataFrame([("a", 1.0, None), ("b", None, 2)], "source string, target_share double, max_repeats int")
    for docs, targets in ((mixed.limit(0), goals), (mixed, goals), (mixed, goals.limit(0))):
        mix = mixing.mix(docs, targets)
        assert mix.draw.count() == 0
        assert all(r["drawn_tokens"] == 0 for r in mix.report.collect())


def test_table_is_raked_as_the_driver_rakes(spark, mixed, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    goals = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 2)], "source string, target_share double, max_repeats int")
    key = ["source", "doc_id", "n_tokens", "uses"]
    one, two = (mixing.mix(mixed, goals, driver_cells=n).draw.toPandas()[key].sort_values(key) for n in (1000, 0))
    assert repr(one.values.tolist()) == repr(two.values.tolist())


def test_unknown_languages_are_one_category(spark):
    """Null and '' are two languages; margins may be given, their names not clash."""
    rows = [(i, "w", "ab"[i % 2], None if i % 4 < 2 else "", "f") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, file_path string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, goals, margins={"lang": F.col("lang")}).draw.count() == 40
    with pytest.raises(ValueError, match="clash"):
        mixing.mix(df, goals, margins={"row": F.col("lang")})


def test_search_looks_at_all_pairs():
    """The two items that make room stand at the ends of their container."""
    sizes = np.array([19, *[1] * 20, 10, *[5] * 5, 8])
    where = np.array([0, *[1] * 27])
    fills = np.bincount(where, weights=sizes).astype(np.int64)
    assert packing._step(sizes, where, fills, 0, 64) and fills.tolist() == [18, 64]


def test_effort_is_optional():
    sizes = np.random.default_rng(0).integers(300, 801, 400)
    counts = [packing.pack(sizes, 2048, effort).max() + 1 for effort in (0, 1, None)]
    assert counts == sorted(counts, reverse=True) and counts[0] == len(packing.best_fit(sizes, 2048)[1])
