"""Drawing documents so that each source supplies its target share of all tokens.

Iterative proportional fitting: the tokens in every cell of source, language and topic are raked
to the targets of the sources and to the shares that languages and topics have in the whole collection, with
no rate above the source's cap. The sources come last, so that theirs hold exactly where they
can. Each document is then drawn as often as its cell's rate says, by a systematic sample along the
sizes, so that a source's tokens miss its target by little more than one document.

The cells are one row for each source, language and topic that occur together. Up to a bound they are raked on the driver,
beyond it as a table, by the same steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.tokens import with_sizes
from strandlake.runtime import cut, discard, require_columns, small

#: Rounds of raking, and the relative change at which it ends; and steps for the sources in a round.
ROUNDS, TOLERANCE, STEPS = 200, 1e-10, 64
#: Cells up to which they are raked on the driver.
DRIVER_CELLS = 1_000_000
#: Rates are whole multiples of 2**-UNIT, so that sums don't depend on their order.
UNIT = 20
#: Documents that one task samples.
BLOCK = 500_000

_BLANK = " \t\n\x0b\x0c\r"

#: The margins besides the source: languages without case and outer blanks, and first folders of paths as topics.
MARGINS = {"lang": "lower(trim(lang))", "topic": "regexp_extract(file_path, '^([^/]*)/', 1)"}


def clean(source: Column) -> Column:
    """Outer blanks removed, lower case."""
    return F.lower(F.trim(source, F.lit(_BLANK)))


def rake(
    tokens: np.ndarray, source: np.ndarray, others: list[np.ndarray], wanted: np.ndarray, caps: np.ndarray
) -> np.ndarray:
    """For each cell how often, on average, its tokens are used.

    ``source`` and each of ``others`` give a cell's category; ``wanted`` is in tokens by source, ``caps`` the
    highest rate by source. The other margins are raked to the shares they have in ``tokens``.
    """
    cap = caps[source].astype(float)
    rate = np.minimum(np.where(wanted[source] > 0, 1.0, 0.0), cap)
    shares = [np.bincount(m, weights=tokens) / max(tokens.sum(), 1) for m in others]

    def fit(rate: np.ndarray, margin: np.ndarray, want: np.ndarray) -> np.ndarray:
        """One step of each category to ``want``: all its cells when there is too much, those below their cap when too little."""
        total, held, full = (
            np.bincount(margin, weights=w, minlength=len(want)) for w in (tokens * rate, tokens * rate * (rate >= cap), tokens * cap)
        )
        less = np.divide(want, total, out=np.ones(len(want)), where=total > 0)
        more = np.divide(want - held, total - held, out=np.ones(len(want)), where=total > held)
        grown = np.where(rate >= cap, cap, np.minimum(rate * more[margin], cap))
        moved = np.where((total >= want)[margin], rate * less[margin], grown)
        return np.where((full <= want)[margin], cap, moved)

    for _ in range(ROUNDS):
        before = rate
        for margin, share in zip(others, shares, strict=True):
            rate = fit(rate, margin, share * float((tokens * rate).sum()))
        for _ in range(STEPS):
            last, rate = rate, fit(rate, source, wanted)
            if _near(last, rate):
                break
        if _near(before, rate):
            break
    return rate


def _near(a: np.ndarray, b: np.ndarray) -> bool:
    return np.abs(a - b).max(initial=0) <= TOLERANCE * max(b.max(initial=0), 1)


def rake_table(cells: DataFrame, margins: list[str]) -> DataFrame:
    """``cells`` (``source``, ``margins``, ``n``, ``wanted`` of the source, ``cap``) with the ``rate`` that :func:`rake` gives."""
    tokens = F.col("n").cast("double")
    cap = F.col("cap").cast("double")
    every = max(float(cells.agg(F.sum(tokens)).first()[0] or 0), 1.0)

    def fit(rated: DataFrame, by: str, want: Column) -> DataFrame:
        used = tokens * F.col("rate")
        sums = rated.groupBy(by).agg(
            F.sum(used).alias("__total"), F.sum(F.when(F.col("rate") >= cap, used).otherwise(0.0)).alias("__held"),
            F.sum(tokens * cap).alias("__full"), F.sum(tokens).alias("__own"), F.max("wanted").alias("__wanted"),
        ).withColumn("__want", want)
        total, held, full, goal = (F.col(f"__{c}") for c in ("total", "held", "full", "want"))
        more = F.coalesce(F.try_divide(goal - held, total - held), F.lit(1.0))
        rate = (
            F.when(full <= goal, cap)
            .when(total >= goal, F.col("rate") * F.coalesce(F.try_divide(goal, total), F.lit(1.0)))
            .when(F.col("rate") >= cap, cap).otherwise(F.least(F.col("rate") * more, cap))
        )
        joined = rated.join(small(sums.select(by, total, held, full, goal)), by)
        return joined.withColumn("rate", rate).select(*rated.columns)

    def change(a: DataFrame, b: DataFrame) -> float:
        keys = ["source", *margins]
        pairs = a.select(*keys, F.col("rate").alias("__before")).join(b.select(*keys, "rate"), keys)
        row = pairs.agg(F.max(F.abs(F.col("rate") - F.col("__before"))).alias("d"), F.max("rate").alias("r")).first()
        return (row["d"] or 0.0) / max(row["r"] or 0.0, 1.0)

    def move(old: DataFrame, new: DataFrame, keep: DataFrame) -> DataFrame:
        written = cut(new)
        if old is not keep:
            discard(old)
        return written

    rated = cut(cells.withColumn("rate", F.least(F.when(F.col("wanted") > 0, 1.0).otherwise(0.0), cap)))
    for _ in range(ROUNDS):
        before = rated
        for m in margins:
            used = float(rated.agg(F.sum(tokens * F.col("rate"))).first()[0] or 0)
            rated = move(rated, fit(rated, m, F.col("__own") / F.lit(every) * F.lit(used)), before)
        for _ in range(STEPS):
            fitted = cut(fit(rated, "source", F.col("__wanted")))
            still = change(rated, fitted) <= TOLERANCE
            if rated is not before:
                discard(rated)
            rated = fitted
            if still:
                break
        done = change(before, rated) <= TOLERANCE
        discard(before)
        if done:
            break
    return rated


@dataclass(frozen=True)
class Mix:
    """``draw``: ``doc_id``, ``source``, ``n_tokens``, ``uses`` (above 0). ``report``: one row per target."""

    draw: DataFrame
    report: DataFrame


def _known(category: Column | str) -> Column:
    """A category's name, so that the null one has a name that no other has."""
    category = F.expr(category) if isinstance(category, str) else category
    return F.coalesce(F.concat(F.lit("="), category), F.lit(""))


def _rated(cells: DataFrame, margins: list[str], driver_cells: int) -> DataFrame:
    """``cells`` with ``units``, their rate in whole units."""
    if cells.count() > driver_cells:
        found = rake_table(cells, margins)
    else:
        columns = cells.toArrow()
        names, source = np.unique(columns["source"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        wanted, caps = np.zeros(len(names)), np.zeros(len(names))
        wanted[source], caps[source] = columns["wanted"].to_numpy(), columns["cap"].to_numpy()
        others = [columns[m].combine_chunks().dictionary_encode().indices.to_numpy() for m in margins]
        rate = rake(columns["n"].to_numpy().astype(float), source, others, wanted, caps)
        found = cells.sparkSession.createDataFrame(columns.append_column("rate", pa.array(rate, pa.float64())))
    unit = F.lit(1 << UNIT)
    return found.withColumn("units", F.least(F.round(F.col("rate") * unit).cast("long"), F.col("cap") * unit)).drop("rate")


def mix(
    docs: DataFrame,
    targets: DataFrame,
    seed: int = 0,
    margins: Mapping[str, Column | str] = MARGINS,
    driver_cells: int = DRIVER_CELLS,
) -> Mix:
    """``docs`` drawn to the shares of ``targets``.

    ``docs`` has ``doc_id``, ``text``, ``source`` and what the ``margins`` (name to expression) are made from, by default ``lang``
    and ``file_path``, whose first folder is the topic; ``targets`` has ``source``, ``target_share``, ``max_repeats``. A share is one
    of the tokens of all documents with a source. No
    document is used more than its source's ``max_repeats``; a source too small for that is used as often as
    allowed: its raked cells are all at their cap and still fall short, which is reported as not reachable. Sources compare without
    outer blanks and case; targets of the same
    source are added up with the larger cap; null shares and caps count as 0, targets without a source
    and documents whose source is null or no target are not drawn. All categories of a margin are held apart, null being one of them.
    A draw has uses >= 1, so that documents without tokens may
    appear, too. Each row is a document of its own. Empty documents give a report with 0 tokens. More than ``driver_cells`` cells
    are raked as a table.
    """
    require_columns(docs, "doc_id", "text", "source")
    clash = {"doc_id", "source", "n_tokens", "row"} & set(margins)
    if clash:
        raise ValueError(f"names of margins clash with columns: {', '.join(sorted(clash))}")
    names = list(margins)
    cell = ["source", *names]
    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", clean(F.col("source")).alias("source"),
        *[_known(c).alias(m) for m, c in margins.items()],
    )
    sizes = with_sizes(picked, "text", ["doc_id", *cell])
    sizes = cut(sizes.where(F.col("source").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0

    goals = (
        targets.where(F.col("source").isNotNull()).groupBy(clean(F.col("source")).alias("source"))
        .agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).cast("double").alias("target_share"),
            F.max(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"),
        )
        .withColumn("wanted_tokens", F.col("target_share") * F.lit(float(total)))
    )
    goals = small(goals)
    bounds = goals.select("source", F.col("wanted_tokens").alias("wanted"), F.col("max_repeats").cast("long").alias("cap"))
    cells = sizes.groupBy(*cell).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    rated = _rated(cut(cells.join(bounds, "source").select(*cell, "n", "docs", "wanted", "cap")), names, driver_cells)
    by_source = rated.groupBy("source").agg(
        F.sum("n").alias("tokens"), F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("cap")).alias("most"),
        F.bool_and((F.col("units") == F.col("cap") * F.lit(1 << UNIT)) | (F.col("n") == 0)).alias("at_cap"),
    )
    by_source = small(by_source)

    blocks = max(1, -(-int(by_source.agg(F.sum("docs")).first()[0] or 0) // BLOCK))
    docs_rated = sizes.join(small(rated.where("units > 0").select(*cell, F.col("units").alias("rate"))), cell).select(
        "doc_id", "source", "n_tokens", "row", "rate",
        F.floor(F.log2(F.col("n_tokens") + 1) * 4).cast("int").alias("class"),
        F.xxhash64(F.lit(seed), F.coalesce("doc_id", "row")).alias("h"),
    ).withColumn("salt", F.pmod("h", F.lit(blocks)))
    block = ["source", "class", "salt"]
    before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = docs_rated.groupBy(*block).agg(F.sum("rate").alias("rates")).select(
        *block,
        (F.coalesce(F.sum("rates").over(before), F.lit(0)) + F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << UNIT)))
        .alias("begin"),
    )
    upto = Window.partitionBy(*block).orderBy("n_tokens", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("begin") + F.col("upto")
    draw = (
        docs_rated.withColumn("upto", F.sum("rate").over(upto)).join(begins, block)
        .withColumn("uses", (F.shiftright(end, UNIT) - F.shiftright(end - F.col("rate"), UNIT)).cast("int"))
        .where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    )

    short = F.coalesce("at_cap", F.lit(True)) & (F.coalesce("most", F.lit(0)) < F.col("wanted_tokens"))
    listed = goals.join(by_source, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (~short).alias("reachable"),
        "wanted_tokens",
    )
    reached = draw.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn_tokens"), F.sum("uses").alias("drawn_documents")
    )
    everything = Window.partitionBy(F.lit(0))  # one row for each target
    report = listed.join(reached, "source", "left").fillna(0, ["drawn_tokens", "drawn_documents"]).withColumn(
        "share", F.try_divide(F.col("drawn_tokens").cast("double"), F.sum("drawn_tokens").over(everything))
    )
    return Mix(draw, report)
