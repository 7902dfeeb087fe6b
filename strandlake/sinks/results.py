"""Writing results: tab-separated text, Parquet, and sequences."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.encoding import fixed4

TSV, TSV_GZ, PARQUET = "tsv", "tsv.gz", "parquet"
#: Quality of a base where none is known.
PLACEHOLDER = "I"


def output_format(path: str | None, kind: str | None = None) -> str:
    """``kind`` if given, else by the extension: Parquet, gzip text, else text; text for no path and ``-``.

    No path and ``-`` mean the standard output, which takes text only: other kinds are an error.
    """
    if path is None or path == "-":
        if kind not in (None, TSV):
            raise ValueError(f"{kind} can't go to the standard output")
        return TSV
    return kind or {".parquet": PARQUET, ".gz": TSV_GZ}.get(os.path.splitext(path)[1], TSV)


def formatted(hits: DataFrame, scores: Sequence[str] = ("score",)) -> DataFrame:
    """Score columns as text with four decimals."""
    return hits.withColumns({c: fixed4(_named(c)) for c in scores})


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def write_results(
    hits: DataFrame, path: str | None, scores: Sequence[str] = ("score",), rounded: bool = False, kind: str | None = None
) -> None:
    """Hits in the form the path's extension, or ``kind``, asks for, as a folder of parts; as text to the standard output without a path.

    Text has a header and four decimals. Parquet keeps full precision unless ``rounded``.
    """
    kind = output_format(path, kind)
    if kind == PARQUET:
        shown = hits.withColumns({c: F.round(_named(c), 4) for c in scores}) if rounded else hits
        shown.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    if path is None or path == "-":
        print(*hits.columns, sep="\t")
        for row in formatted(hits, scores).toLocalIterator():  # partition by partition
            print(*("" if v is None else v for v in row), sep="\t")
        return
    writer = formatted(hits, scores).write.mode("overwrite").option("sep", "\t").option("header", "true")
    if kind == TSV_GZ:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def sequence_format(path: str) -> str:
    lowered = path.lower()
    for ending, kind in ((".fasta.gz", "fasta"), (".fa.gz", "fasta"), (".fastq.gz", "fastq"), (".fq.gz", "fastq")):
        if lowered.endswith(ending):
            return kind
    raise ValueError(f"{path}: sequences are written as .fasta.gz, .fa.gz, .fastq.gz or .fq.gz")


def mate_paths(path: str) -> tuple[str, str]:
    """``x.fastq.gz`` as ``x.R1.fastq.gz`` and ``x.R2.fastq.gz``."""
    sequence_format(path)
    base, kind, gz = path.rsplit(".", 2)
    return f"{base}.R1.{kind}.{gz}", f"{base}.R2.{kind}.{gz}"


def _record(kind: str, header: str, sequence: str, quality: str | None) -> Column:
    if kind == "fasta":
        return F.concat(F.lit(">"), header, F.lit("\n"), sequence)
    filler = F.expr(f"repeat('{PLACEHOLDER}', length(`{sequence}`))")
    known = F.coalesce(F.col(quality), filler) if quality else filler
    return F.concat(F.lit("@"), header, F.lit("\n"), sequence, F.lit("\n+\n"), known)


def write_sequences(
    reads: DataFrame,
    path: str,
    header: str = "read_id",
    sequences: Sequence[str] = ("sequence",),
    qualities: Sequence[str | None] = (None,),
    single_file: bool = False,
) -> list[str]:
    """Gzip FASTA or FASTQ by the path's ending; with two ``sequences`` a folder for each mate. The paths written.

    Missing qualities are filled; rows without a header or a first sequence are left out. A read without a mate is only in
    the first folder.
    ``single_file`` gathers all in one task, for small results.
    """
    kind = sequence_format(path)
    paths = list(mate_paths(path)) if len(sequences) == 2 else [path]
    rows = reads.where(F.col(header).isNotNull() & F.col(sequences[0]).isNotNull())
    if single_file:
        rows = rows.coalesce(1)
    for target, sequence, quality in zip(paths, sequences, [*qualities, None][: len(paths)], strict=True):
        own = rows.where(F.col(sequence).isNotNull())
        own.select(_record(kind, header, sequence, quality)).write.mode("overwrite").option("compression", "gzip").text(target)
    return paths
