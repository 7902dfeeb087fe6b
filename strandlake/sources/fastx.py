"""Reading FASTA and FASTQ as the data source ``fastx``.

Plain files are split by bytes, so that one large file is read by many tasks; files compressed as a whole (gzip,
zstd) are one task each. Blocks of bytes are scanned for line ends at once and become Arrow columns without a
step per line. A path may be a URI of any file system that Arrow knows (file, hdfs, s3, gs), which every executor must
reach. A record belongs to the split its first byte is in.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.runtime import small

SCHEMA = "file string, split int, record long, header string, sequence string, quality string"
#: Bytes of a split, and of a block that is scanned at once; a block grows if a record is larger.
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20

_GZIP, _ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
_LF, _CR, _GREATER, _AT, _PLUS = (ord(c) for c in "\n\r>@+")


class _Split(InputPartition):
    def __init__(self, path: str, number: int, begin: int, end: int) -> None:
        self.path, self.number, self.begin, self.end = path, number, begin, end


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _head(path: str) -> bytes:
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        return f.read(4)


def _is_compressed(path: str) -> bool:
    head = _head(path)
    return head[:2] == _GZIP or head == _ZSTD


def _open(path: str):
    """The file's text as a stream of bytes; plain files can be read from any place."""
    system, inner = _system(path)
    head = _head(path)
    file = system.open_input_file(inner)
    if head[:2] == _GZIP:
        return gzip.GzipFile(fileobj=file)
    if head == _ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
    return file


def _expand(path: str) -> list[str]:
    """Files of a path: itself, those of a folder, or those whose names match a pattern."""
    system, inner = _system(path)
    prefix = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    folder, name = os.path.split(inner)
    pattern = any(c in name for c in "*?[")
    info = system.get_file_info(folder if pattern else inner)
    if info.type == pafs.FileType.Directory:
        listed = system.get_file_info(pafs.FileSelector(info.path))
        files = [f.path for f in listed if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        found = sorted(f for f in files if not pattern or fnmatch.fnmatchcase(os.path.basename(f), name))
    else:
        found = [inner] if info.type == pafs.FileType.File and not pattern else []
    if not found:
        raise FileNotFoundError(path)
    return [prefix + f for f in found] if prefix else found


def _texts(column: pa.Array) -> pa.Array:
    """Bytes as text; what isn't UTF-8 is replaced."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()], pa.string())


def _lines(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each complete line begins and ends (with its line end)."""
    letters = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(letters == _LF) + 1
    return letters, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


class _Blocks:
    """What is unread of a split, as growing bytes that begin at ``at``."""

    def __init__(self, stream, at: int) -> None:
        self.stream, self.at, self.data, self.ended = stream, at, b"", False

    def more(self) -> bool:
        """Reads a block, at least as much as is held; False if there is nothing more."""
        if self.ended:
            return False
        block = self.stream.read(max(BLOCK_BYTES, len(self.data)))
        if not block:
            self.ended = True
            if self.data and not self.data.endswith(b"\n"):
                self.data += b"\n"
            return bool(self.data)
        self.data += block
        return True

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _fastq(blocks: _Blocks, path: str, end: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Headers, sequences and qualities, a block at a time."""
    while True:
        letters, begin, stop = _lines(blocks.data)
        n = len(begin) // 4
        first, plus = letters[begin[: 4 * n : 4]], letters[begin[2 : 4 * n : 4]]
        size = stop - begin - 1
        size -= (size > 0) & (letters[np.maximum(stop - 2, 0)] == _CR)
        good = (first == _AT) & (plus == _PLUS) & (size[1 : 4 * n : 4] == size[3 : 4 * n : 4])
        own = blocks.at + begin[: 4 * n : 4] < end
        count = int(np.argmin(good & own)) if not (good & own).all() else n
        if count:
            offsets = pa.py_buffer(np.concatenate([begin, stop[-1:]]).astype(np.int32))
            lines = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(blocks.data)])
            columns = [_texts(lines.take(pa.array(np.arange(k, 4 * count, 4)))) for k in (0, 1, 3)]
            header, sequence, quality = (pc.utf8_rtrim(c, "\r\n") for c in columns)
            yield pc.utf8_slice_codeunits(header, 1), sequence, quality
            blocks.drop(int(stop[4 * count - 1]))
        if count < n:
            if not own[count]:
                return
            if size[4 * count] or first[count] != _LF and first[count] != _CR:
                raise ValueError(f"{path}: invalid FASTQ record at byte {blocks.at}")
            blocks.drop(int(stop[4 * count] - begin[4 * count]))  # an empty line between records
        elif not blocks.more():
            if blocks.data.strip() and blocks.at < end:
                raise ValueError(f"{path}: invalid FASTQ record at byte {blocks.at}")
            return


def _fasta(blocks: _Blocks, path: str, end: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    while True:
        letters, begin, stop = _lines(blocks.data)
        is_header = letters[begin] == _GREATER
        heads = np.flatnonzero(is_header)
        if len(heads) and blocks.data[: begin[heads[0]]].strip() or (blocks.ended and not len(heads) and blocks.data.strip()):
            raise ValueError(f"{path}: neither '>' nor '@' at byte {blocks.at}")
        # A record is whole if another one follows, or at the end of the file.
        count = len(heads) if blocks.ended else max(len(heads) - 1, 0)
        count = int(np.searchsorted(blocks.at + begin[heads[:count]], end))
        if count:
            till = begin[heads[count]] if count < len(heads) else len(blocks.data)
            lines = int(np.searchsorted(begin, till))
            inside = np.repeat(is_header[:lines], (stop - begin)[:lines])
            kept = ~inside & (letters[:till] != _LF) & (letters[:till] != _CR)
            kept[: begin[heads[0]]] = False
            upto = np.concatenate([[0], np.cumsum(kept)])
            edges = np.append(begin[heads[:count]], till)
            offsets = pa.py_buffer(upto[edges].astype(np.int32))
            sequence = pa.Array.from_buffers(pa.binary(), count, [None, offsets, pa.py_buffer(letters[:till][kept].tobytes())])
            lines_at = pa.py_buffer(np.concatenate([begin, stop[-1:]]).astype(np.int32))
            every = pa.Array.from_buffers(pa.binary(), len(begin), [None, lines_at, pa.py_buffer(blocks.data)])
            header = pc.utf8_rtrim(_texts(every.take(pa.array(heads[:count]))), "\r\n")
            yield pc.utf8_slice_codeunits(header, 1), _texts(sequence), pa.nulls(count, pa.string())
            blocks.drop(int(till))
        if count < len(heads) and blocks.at + (0 if count else begin[heads[0]]) >= end or not blocks.more():
            return


def _to_first_record(blocks: _Blocks, fastq: bool, end: int) -> bool:
    """Drops what is left of a record that began before; False if none begins in the split.

    In FASTQ a header is an ``@`` two lines before a ``+``: a quality line may begin with ``@``, but then two lines on
    there are letters.
    """
    while True:
        letters, begin, _ = _lines(blocks.data)
        first = letters[begin[1:]]  # the first line is the rest of one
        found = np.flatnonzero((first[:-2] == _AT) & (first[2:] == _PLUS) if fastq else first == _GREATER)
        if len(found):
            blocks.drop(int(begin[found[0] + 1]))
            return blocks.at < end
        if not blocks.more():
            return False


class FastxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[_Split]:
        out = []
        for path in (f for p in self.paths for f in _expand(p)):
            system, inner = _system(path)
            size = system.get_file_info(inner).size
            step = max(size, 1) if _is_compressed(path) else self.split_bytes
            out += [_Split(path, i, b, min(b + step, size)) for i, b in enumerate(range(0, max(size, 1), step))]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        compressed, path = _is_compressed(partition.path), partition.path
        with _open(path) as stream:
            begins = stream.read(4096).lstrip()[:1]
            fastq = begins == b"@"
        with _open(path) as stream:
            blocks = _Blocks(stream, max(0, partition.begin - 1))
            if partition.begin:
                stream.seek(partition.begin - 1)
                if not _to_first_record(blocks, fastq, partition.end):
                    return
            end = float("inf") if compressed else partition.end
            number = 0
            for columns in (_fastq if fastq else _fasta)(blocks, path, end):
                n = len(columns[0])
                fixed = [pa.array([path] * n, pa.string()), pa.array(np.full(n, partition.number, np.int32)), pa.array(np.arange(number, number + n))]
                number += n
                yield pa.RecordBatch.from_arrays([*fixed, *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file``, ``split``, ``record`` (from 0 in its split), ``header``, ``sequence``, ``quality`` (null in FASTA).

    A path is a file, a folder, or a pattern. FASTA sequences may span lines; FASTQ records have four. Blank lines between
    records are skipped, an empty file has no records, anything else is an error.
    """
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("splitBytes", split_bytes).load(",".join(paths))


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``ordinal``, their place among all records of their file, from 0."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = records.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return records.join(small(begins), ["file", "split"]).withColumn("ordinal", F.col("begin") + F.col("record")).drop("begin")


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """``header``, ``sequence`` of FASTA on any file system that Spark reads, by expressions alone.

    Lines end in LF. Splits are Spark's own.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    header = F.substring_index("v", "\n", 1)
    body = F.substring(F.col("v"), F.length(header) + 2, F.length("v"))
    return rows.where(F.length("v") > 0).select(
        F.regexp_replace(header, "\r$", "").alias("header"), F.regexp_replace(body, "[\r\n]", "").alias("sequence")
    )
