"""How often every term or run of terms occurs, and in how many records.

Suffix sorting: every position gives the run of at most ``max_n`` terms that starts there.
The runs are routed by their first term, sorted in reverse lexicographic order, and read once
with a stack of open prefixes: a prefix is complete as soon as a run doesn't start with it, and then
has its count and its set of records, without any run of terms having been sent more than once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.skew import heavy_keys, is_heavy, salt
from strandlake.runtime import partitions


def suffixes(df: DataFrame, records: Sequence[str], terms: str, max_n: int) -> DataFrame:
    """One row per position of the array ``terms``: the record columns and ``t1`` .. ``t<max_n>``.

    Columns after the end of the array or from the first null term on are null; positions whose own
    term is null give no row, as do null and empty arrays.
    """
    at = [F.expr(f"get(__terms, __p + {j})").alias(f"t{j + 1}") for j in range(max_n)]
    rows = df.select(*records, F.col(terms).alias("__terms")).where(F.size("__terms") > 0)
    rows = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.size("__terms") - 1))).select(*records, *at)
    for j in range(2, max_n + 1):
        rows = rows.withColumn(f"t{j}", F.when(F.col(f"t{j - 1}").isNotNull(), F.col(f"t{j}")))
    return rows.where("t1 IS NOT NULL")


class _Level:
    """The open prefix of one length on the stack."""

    __slots__ = ("count", "members", "prefix")

    def __init__(self, prefix: tuple, count: int, members: np.ndarray) -> None:
        self.prefix, self.count, self.members = prefix, count, members


def _differs(column: pa.Array, before: object, first: bool) -> np.ndarray:
    """Where a row's value isn't the one of the row before; nulls equal each other."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        neq = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = neq | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    out[0] = first or column[0].as_py() != before
    return out


def _distinct(group: np.ndarray, members: np.ndarray, n_groups: int, in_order: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct members of each group by each number of leading columns; where the full ones stand."""
    width = members.shape[1]
    order = np.arange(len(group)) if in_order else np.lexsort([*members.T[::-1], group])
    g, m = group[order], members[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    counts = np.zeros((width, n_groups), np.int64)
    for q in range(width):
        new[1:] |= m[1:, q] != m[:-1, q]
        counts[q] = np.bincount(g[new], minlength=n_groups)
    return counts, order[new]


def _stack(max_n: int, records: int, weighted: bool):
    names = ["n", *(f"t{j + 1}" for j in range(max_n)), "occurrences", *(f"records_{q + 1}" for q in range(records))]

    def emit(level: int, prefixes: list[pa.Array], count: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        kind = prefixes[0].type
        columns = [pa.array(np.full(len(count), level, np.int32)), *prefixes]
        columns += [pa.nulls(len(count), kind) for _ in range(max_n - level)]
        columns += [pa.array(count.astype(np.int64)), *(pa.array(s.astype(np.int64)) for s in sets)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def close(level: int, top: _Level, kind: pa.DataType) -> pa.RecordBatch:
        sets = np.array([[len(np.unique(top.members[:, : q + 1], axis=0))] for q in range(records)])
        return emit(level, [pa.array([v], kind) for v in top.prefix], np.array([top.count]), sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Level | None] = [None] * max_n
        last: tuple | None = None
        kind = None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            terms = [batch.column(f"t{j + 1}") for j in range(max_n)]
            kind = terms[0].type
            members = np.column_stack([
                batch.column(f"r{q + 1}").to_numpy(zero_copy_only=False).astype(np.int64) for q in range(records)
            ])
            weight = batch.column("w").to_numpy(zero_copy_only=False) if weighted else None
            starts = np.zeros(size, bool)
            for j in range(max_n):
                starts = starts | _differs(terms[j], last and last[j], last is None)
                there = ~terms[j].is_null().to_numpy(zero_copy_only=False)
                group = np.cumsum(starts) - 1 + (0 if starts[0] else 1)  # group 0: the open prefix goes on
                groups = int(group[-1]) + 1
                heads = np.flatnonzero(starts) if starts[0] else np.concatenate([[0], np.flatnonzero(starts)])
                g, m = group[there], members[there]
                count = np.bincount(g, weights=weight[there] if weighted else None, minlength=groups)
                sets, kept = _distinct(g, m, groups, in_order=j == max_n - 1)
                exists = there[heads]
                top = stack[j]
                if starts[0] and top is not None:
                    yield close(j + 1, top, kind)
                    top = None

                def tail(k: int, g=g, m=m, kept=kept) -> np.ndarray:
                    return m[kept][g[kept] == k]

                begin = 0
                if not starts[0]:
                    if top is not None:
                        top.count += int(count[0])
                        top.members = np.unique(np.concatenate([top.members, tail(0)]), axis=0)
                        if groups > 1:
                            yield close(j + 1, top, kind)
                            top = None
                    begin = 1
                closed = np.arange(begin, groups - 1)
                closed = closed[exists[closed]]
                if len(closed):
                    at = pa.array(heads[closed])
                    yield emit(j + 1, [t.take(at) for t in terms[: j + 1]], count[closed], sets[:, closed])
                if groups - 1 >= begin:
                    k = groups - 1
                    top = None
                    if exists[k]:
                        at = int(heads[k])
                        top = _Level(tuple(t[at].as_py() for t in terms[: j + 1]), int(count[k]), tail(k))
                stack[j] = top
            last = tuple(t[size - 1].as_py() for t in terms)
        for j, top in enumerate(stack):
            if top is not None:
                yield close(j + 1, top, kind)

    return run


def ngram_counts(
    runs: DataFrame, records: Sequence[str], max_n: int = 1, share: float | None = None, salts: int | None = None
) -> DataFrame:
    """Counts of every run of 1 to ``max_n`` terms in the rows of :func:`suffixes`.

    ``records`` are whole-number columns, the outermost first. Output: ``n`` INT, ``t1`` .. (null beyond
    ``n``), ``occurrences``, and for each number of leading record columns ``records_1`` .. LONG, in how many
    distinct records the run occurs. Repeated rows each count as an occurrence and once as a record. Rows
    with a null first term or null record are left out; other columns are ignored; an empty table gives no rows.

    A first term with at least ``share`` of all rows (by default a quarter of a mean partition) is hot: its rows are combined
    before the shuffle and spread by a salt of the outermost record, which keeps the record sets of the salts apart, so counts add up.
    """
    salts = salts or partitions(runs.sparkSession)
    terms = [f"t{j + 1}" for j in range(max_n)]
    keys = [f"r{q + 1}" for q in range(len(records))]
    rows = runs.select(*terms, *[F.col(c).cast("long").alias(k) for c, k in zip(records, keys, strict=True)])
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ["t1", *keys]))
    kind = runs.schema["t1"].dataType.simpleString()
    schema = f"n int, {', '.join(f'{t} {kind}' for t in terms)}, occurrences long, " + ", ".join(
        f"records_{q + 1} long" for q in range(len(records))
    )
    order = [*(F.desc_nulls_last(t) for t in terms), *(F.asc(k) for k in keys)]
    _, heavy = heavy_keys(rows, ["t1"], share)
    hot = is_heavy("t1", heavy["t1"])
    light = rows.where(~hot).repartition("t1").sortWithinPartitions(*order)
    out = light.mapInArrow(_stack(max_n, len(keys), False), schema)
    if heavy["t1"]:
        dense = rows.where(hot).groupBy(*terms, *keys).agg(F.count(F.lit(1)).alias("w"))
        dense = dense.withColumn("salt", salt(["r1"], salts)).repartition("t1", "salt")
        dense = dense.sortWithinPartitions("salt", *order).drop("salt")
        # Two salts may share a partition; their record sets are disjoint, so their counts still add up.
        parts = dense.mapInArrow(_stack(max_n, len(keys), True), schema)
        sums = ["occurrences", *(f"records_{q + 1}" for q in range(len(keys)))]
        out = out.unionByName(parts.groupBy("n", *terms).agg(*[F.sum(c).alias(c) for c in sums]))
    return out
