"""Scalar expressions on sequences, sketches and scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(2**63)

# Purines (A, G) are 1, pyrimidines (T, C) are 0, in either case.
PURINES, PYRIMIDINES = "AaGg", "TtCc"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed(value: int) -> int:
    """A 64-bit pattern as the LONG that carries it."""
    value &= 2**64 - 1
    return value - 2**64 if value >= 2**63 else value


def unsigned_key(h: Column | str) -> Column:
    """A LONG that orders by signed comparison as ``h`` does by unsigned comparison."""
    return _col(h).bitwiseXOR(F.lit(SIGN))


def ry_bits(sequence: Column | str) -> Column:
    """Purines as 1, pyrimidines as 0; every other character stays, and marks an invalid base."""
    return F.translate(_col(sequence), PURINES + PYRIMIDINES, "1" * len(PURINES) + "0" * len(PYRIMIDINES))


def base_to_bit(base: Column | str) -> Column:
    """1, 0, or null for a character that is no valid base."""
    bit = ry_bits(base)
    return F.when(bit.isin("0", "1"), bit.cast("int"))


def complement_bits(bits: Column | str) -> Column:
    """The reverse complement of a string of 0 and 1."""
    return F.reverse(F.translate(_col(bits), "01", "10"))


def pack_bits(bits: Column | str) -> Column:
    """A string of up to 64 bits as the LONG with that pattern."""
    return F.conv(_col(bits), 2, -10).cast("long")


def reverse_complement(kmer: Column | str, k: int) -> Column:
    """The reverse complement of a packed k-mer of ``k`` bits (1 to 64)."""
    if not 1 <= k <= 64:
        raise ValueError("k must be in 1 .. 64")
    x = F.bitwise_not(_col(kmer))
    for shift, mask in (
        (1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF),
    ):
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(low))
    return F.shiftrightunsigned(x, 64 - k) if k < 64 else x


def base_read_id(header: Column | str) -> Column:
    """A header up to the first space or tab, without a mate suffix ``/1`` or ``/2``."""
    return F.regexp_replace(F.regexp_extract(_col(header), "^[^ \t]*", 0), "/[12]$", "")


def sanitize_bucket_name(name: Column | str) -> Column:
    """Control characters, and characters beyond ASCII that are no white space, become ``_``."""
    return F.regexp_replace(_col(name), r"(?U)\p{Cntrl}|[^\x21-\x7E\s]", "_")


def source_label(path: Column | str, sequence: Column | str) -> Column:
    return F.concat_ws("::", _col(path), _col(sequence))


def source_path(label: Column | str) -> Column:
    """The part of a source label before the first ``::``."""
    return F.element_at(F.split(_col(label), "::"), 1)


def count_hits(minimizers: Column | str, bucket: Column | str) -> Column:
    """How many elements of ``minimizers``, repeats counted, are in ``bucket``. Nulls are in none.

    Repeats are what is left when the distinct elements are taken away, so that neither list is searched for each element:
    a map from the bucket's elements is looked up instead.
    """
    known = F.array_intersect(_col(minimizers), _col(bucket))
    lookup = F.map_from_arrays(F.filter(known, F.isnotnull), F.filter(known, F.isnotnull))
    return F.size(F.filter(_col(minimizers), lambda m: F.try_element_at(lookup, m).isNotNull()))


def intersection_size(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b)))


def overlap(matches: Column | str, size: Column | str) -> Column:
    """Matches as a share of the sketch; 0 for an empty one."""
    return F.when(_col(size) > 0, _col(matches) / _col(size)).otherwise(F.lit(0.0))


def orientation(fwd_overlap: Column | str, rc_overlap: Column | str) -> Column:
    """``rc`` only if its overlap is greater; a tie is ``fwd``."""
    return F.when(_col(rc_overlap) > _col(fwd_overlap), "rc").otherwise("fwd")


def score(fwd_hits: Column, fwd_total: Column, rc_hits: Column, rc_total: Column) -> Column:
    """The greater share of hits of the two strands; a strand without minimizers gives 0."""
    return F.greatest(overlap(fwd_hits, fwd_total), overlap(rc_hits, rc_total))


def log_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """log10(n / d): NaN for 0/0, -Infinity for 0/d, Infinity for n/0."""
    n, d = _col(numerator), _col(denominator)
    ratio = F.try_divide(n, F.when(d != 0, d))
    return (
        F.when((n == 0) & (d == 0), F.lit(float("nan")))
        .when(n == 0, F.lit(float("-inf")))
        .when(d == 0, F.lit(float("inf")))
        .otherwise(F.log10(ratio))
    )


def log_ratio_label(numerator: Column | str, denominator: Column | str) -> Column:
    return F.format_string("log10([%s] / [%s])", _col(numerator), _col(denominator))


def fixed4(x: Column | str) -> Column:
    """Four decimals of the exact binary value, a tie going to the even digit; ``NaN``, ``inf`` and ``-inf`` for the special values.

    The product with 10,000 is taken as a rounded one and its exact error: halves of 26 bits multiply without one. Beyond
    2**40, where no product would be exact, whole numbers are near enough that Java's formatting serves.
    """
    x = _col(x)
    size = F.abs(x)
    split = size * F.lit(134217729.0)  # 2**27 + 1
    high = split - (split - size)
    product = size * F.lit(1e4)
    error = (high * F.lit(1e4) - product) + (size - high) * F.lit(1e4)
    whole = F.floor(product)
    beyond = (product - whole) - F.lit(0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(whole, F.lit(2)) == 1))
    n = whole + up.cast("long")
    digits = F.concat_ws(".", F.floor(n / F.lit(10_000)).cast("string"), F.lpad(F.pmod(n, F.lit(10_000)).cast("string"), 4, "0"))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == F.lit(float("inf")), "inf")
        .when(x == F.lit(float("-inf")), "-inf")
        .when(size >= F.lit(2.0**40), F.format_string("%.4f", x))
        .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), digits))
    )


def trim_reads(df, sequence: str = "sequence", pair: str | None = None, trim_to: int | None = None, min_length: int | None = None):  # noqa: E501
    """Reads whose first sequence has ``min_length`` letters before, and ``trim_to`` at, trimming.

    Both tests look at the first sequence only; the mate is cut to what it has. Null sequences are dropped
    once a test applies, a null mate stays null, and no option given leaves the rows as they are.
    """
    for option in (trim_to, min_length):
        if option is not None and option < 1:
            raise ValueError("lengths must be positive")
    if min_length is not None:
        df = df.where(F.length(sequence) >= min_length)
    if trim_to is not None:
        df = df.where(F.length(sequence) >= trim_to).withColumn(sequence, F.substring(sequence, 1, trim_to))
        if pair is not None:
            df = df.withColumn(pair, F.substring(pair, 1, trim_to))
    return df
