"""Index configurations in TOML, and the parsers of options."""

from __future__ import annotations

import csv
import math
import os
import re
import tomllib
import warnings
from dataclasses import dataclass, field

from strandlake.functions.kernels import SIZES, SketchParams

# The suffixes of byte sizes.
_UNITS = {"": 0, "B": 0, "K": 1, "KB": 1, "M": 2, "MB": 2, "G": 3, "GB": 3, "T": 4, "TB": 4}
_FALLBACKS = ("create_new", "skip", "error")


def parse_bytes(text: str) -> int | None:
    """``4G``, ``1.5 mb`` or a plain number as bytes; None for ``auto``."""
    text = text.strip()
    if text.lower() == "auto":
        return None
    match = re.fullmatch(r"([0-9.]+)\s*(.*)", text, re.DOTALL)
    if not match:
        raise ValueError(f"{text!r} is no size: it begins with no number")
    number, unit = match[1], match[2].strip().upper()
    if unit not in _UNITS:
        raise ValueError(f"{text!r} is no size: {match[2]!r} is not a unit")
    try:
        size = float(number) * 1024 ** _UNITS[unit]
    except ValueError:
        raise ValueError(f"{text!r} is no size: {number!r} is not a number") from None
    if not math.isfinite(size) or size >= 2**64:
        raise ValueError(f"{text!r} is more than 64 bits can count")
    return math.floor(size + 0.5)


def format_bytes(size: int) -> str:
    power = min(4, max(0, (size.bit_length() - 1) // 10))
    return f"{size / 1024**power:.2f} {'KMGT'[power - 1]}B" if power else f"{size} B"


def format_duration(seconds: float) -> str:
    if not math.isfinite(seconds) or seconds < 0:
        return "?"
    minutes, s = divmod(math.floor(seconds + 0.5), 60)
    h, m = divmod(minutes, 60)
    return f"{h}h{m:02}m{s:02}s" if h else f"{m}m{s:02}s" if m else f"{s}s"


def parse_bloom_fpp(text: str) -> float:
    fpp = float(text)
    if not 0 < fpp < 1:
        raise ValueError(f"a bloom filter's rate of false positives lies between 0 and 1, not at {text}")
    return fpp


def parse_length(text: str, name: str) -> int:
    """A positive length; a warning below the smallest k."""
    value = int(text)
    if value < 1:
        raise ValueError(f"{name}: a length is 1 or more")
    if value < min(SIZES):
        warnings.warn(f"{name}: {value} letters are too few for any k, which is {min(SIZES)} or more", stacklevel=2)
    return value


@dataclass(frozen=True)
class IndexConfig:
    """``buckets`` maps names to absolute paths, in the order of the names."""

    params: SketchParams
    output: str
    buckets: dict[str, list[str]]
    orient: bool = False
    max_shard_size: int | None = None
    folder: str = field(default=".", compare=False)


def _load(path: str) -> tuple[dict, str]:
    with open(path, "rb") as f:
        try:
            return tomllib.load(f), os.path.dirname(os.path.abspath(path))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{path} is not TOML: {e}") from e


def _require(table: dict, section: str, *keys: str) -> None:
    missing = [k for k in keys if k not in table]
    if missing:
        raise ValueError(f"[{section}] lacks {', '.join(missing)}")


def _existing(folder: str, paths: list[str], what: str) -> list[str]:
    full = [os.path.join(folder, p) for p in paths]  # an absolute path stays as it is
    for p in full:
        if not os.path.exists(p):
            raise FileNotFoundError(f"{p} ({what})")
    return full


def read_index_config(path: str) -> IndexConfig:
    """A TOML file with ``[index]`` and ``[buckets.<name>]``; paths are relative to the file."""
    raw, folder = _load(path)
    _require(raw, "", "index")
    index, buckets = raw["index"], raw.get("buckets", {})
    _require(index, "index", "window", "salt", "output")
    if not buckets:
        raise ValueError(f"{path} names no bucket")
    files = {}
    for name in sorted(buckets):
        if not buckets[name].get("files"):
            raise ValueError(f"{path}: nothing goes into bucket {name!r}")
        files[name] = _existing(folder, buckets[name]["files"], f"bucket '{name}'")
    return IndexConfig(
        SketchParams(index.get("k", 64), index["window"], index["salt"]),
        os.path.join(folder, index["output"]),
        files,
        bool(index.get("orient_sequences", False)),
        index.get("max_shard_size"),
        folder,
    )


@dataclass(frozen=True)
class AddConfig:
    """How files are added: ``mode`` is new_bucket, existing_bucket or best_bin."""

    index: str
    mode: str
    files: list[str]
    bucket_name: str | None = None
    threshold: float | None = None
    fallback: str = "create_new"


def read_add_config(path: str) -> AddConfig:
    raw, folder = _load(path)
    _require(raw, "", "target", "assignment", "files")
    _require(raw["target"], "target", "index")
    assignment = raw["assignment"]
    mode = assignment.get("mode")
    needed = {"new_bucket": (), "existing_bucket": ("bucket_name",), "best_bin": ("threshold",)}
    if mode not in needed:
        raise ValueError(f"unknown assignment mode: {mode}")
    _require(assignment, "assignment", *needed[mode])
    threshold = assignment.get("threshold")
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError(f"{path}: the threshold {threshold} isn't a score")
    fallback = assignment.get("fallback", "create_new")
    if fallback not in _FALLBACKS:
        raise ValueError(f"unknown fallback: {fallback}")
    paths = raw["files"].get("paths")
    if not paths:
        raise ValueError(f"{path} lists nothing to add")
    return AddConfig(
        _existing(folder, [raw["target"]["index"]], "target index")[0],
        mode,
        _existing(folder, paths, "file to add"),
        assignment.get("bucket_name") or raw["files"].get("bucket_name"),
        threshold,
        fallback,
    )


def write_index_config(path: str, params: SketchParams, output: str, buckets: dict[str, list[str]], orient: bool = True) -> None:
    """The TOML of a configuration; names and paths are quoted."""
    for name in buckets:
        if not name or re.search(r"\s", name):
            raise ValueError(f"bucket name has white space or is empty: {name!r}")

    def quoted(text: str) -> str:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'

    lines = ["[index]", f"k = {params.k}", f"window = {params.w}", f"salt = 0x{params.salt:x}", f"output = {quoted(output)}"]
    lines.append(f"orient_sequences = {str(orient).lower()}")
    for name, files in buckets.items():
        lines += ["", f"[buckets.{quoted(name)}]", f"files = [{', '.join(map(quoted, files))}]"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _sequence_files(folder: str, extensions: tuple[str, ...]) -> list[tuple[str, str]]:
    """Name without the extension, and path, of the folder's files that have one of the extensions."""
    found = []
    for file in sorted(os.listdir(folder)):
        ending = max((e for e in extensions if file.endswith(e)), key=len, default=None)
        if ending is not None:
            found.append((file[: -len(ending)], os.path.join(folder, file)))
    if not found:
        raise ValueError(f"{folder} holds no file ending in {', '.join(extensions)}")
    return found


def buckets_per_file(folder: str, extensions: tuple[str, ...]) -> dict[str, list[str]]:
    """A bucket for every sequence file of a folder, named by the file without its extensions."""
    out: dict[str, list[str]] = {}
    for name, path in _sequence_files(folder, extensions):
        if name in out:
            raise ValueError(f"several files would be bucket {name}")
        out[name] = [path]
    return out


def read_file_list(path: str) -> list[dict[str, str]]:
    """The rows of a tab-separated list with a column ``file_path`` and perhaps ``group_label``, blanks removed, empty lines skipped."""
    with open(path, newline="") as f:
        rows = [{k: (v or "").strip() for k, v in r.items() if k} for r in csv.DictReader(f, delimiter="\t")]
    rows = [r for r in rows if any(r.values())]
    if not rows or any(not r.get("file_path") for r in rows):
        raise ValueError(f"{path} lists no files in a column file_path")
    return rows


def one_bucket(name: str, source: str, extensions: tuple[str, ...]) -> dict[str, list[str]]:
    """One bucket of all sequence files of a folder, or of all files of a list (:func:`read_file_list`)."""
    if os.path.isdir(source):
        return {name: [path for _, path in _sequence_files(source, extensions)]}
    return {name: [r["file_path"] for r in read_file_list(source)]}


def grouped_buckets(source: str, n: int) -> dict[str, list[str]]:
    """The files of a list dealt to ``n`` buckets in the order of their labels; the first ones get one more if they aren't even."""
    rows = sorted(read_file_list(source), key=lambda r: r.get("group_label", ""))
    if not 1 <= n <= len(rows):
        raise ValueError(f"{len(rows)} files don't fill {n} buckets")
    size, more = divmod(len(rows), n)
    ends = [i * size + min(i, more) for i in range(n + 1)]
    return {f"bucket_{i}": [r["file_path"] for r in rows[ends[i] : ends[i + 1]]] for i in range(n)}
