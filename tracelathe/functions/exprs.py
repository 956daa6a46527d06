"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_D = "decimal(38,0)"


def digits(hex_text: Column) -> Column:
    """Hex digits without prefix and leading zeros; null when the text is no hex literal."""
    bare = F.regexp_extract(hex_text, r"^0[xX]([0-9a-fA-F]+)$", 1)
    return F.when(bare != "", F.regexp_replace(bare, "^0+(?=.)", ""))


def hex_decimal(hex_text: Column) -> Column:
    """Exact value up to 31 hex digits as DECIMAL(38,0); null beyond."""
    d = digits(hex_text)
    n = F.length(d)
    low = F.conv(F.right(d, F.lit(16)), 16, 10).cast("decimal(20,0)")
    high = F.conv(F.left(d, n - 16), 16, 10).cast("decimal(19,0)")
    wide = (high * F.lit("18446744073709551616").cast("decimal(20,0)") + low).cast(_D)
    return F.when(n <= 16, F.conv(d, 16, 10).cast(_D)).when(n <= 31, wide)


def hex_double(hex_text: Column) -> Column:
    """Value of any width as DOUBLE."""
    d = digits(hex_text)
    pieces = F.regexp_extract_all(
        F.lpad(d, (F.ceil(F.length(d) / 8) * 8).cast("int"), "0"), F.lit("[0-9a-fA-F]{8}"), F.lit(0))
    wide = F.aggregate(pieces, F.lit(0.0),
                       lambda acc, p: acc * F.lit(4294967296.0) + F.conv(p, 16, 10).cast("double"))
    return F.when(F.length(d) <= 16, F.conv(d, 16, 10).cast("double")).when(d.isNotNull(), wide)


def hex_bits(hex_text: Column) -> Column:
    """The 64-bit pattern as BIGINT (two's complement); null for wider values."""
    d = digits(hex_text)
    return F.when(F.length(d) <= 16, F.conv(d, 16, -10).cast("bigint"))


def count_entropy(n: Column) -> Column:
    """Aggregate: Shannon entropy (natural log) of counts, ``ln N - sum(n ln n)/N``."""
    total = F.sum(n)
    return F.coalesce(F.greatest(F.ln(total) - F.sum(n * F.ln(n)) / total, F.lit(0.0)), F.lit(0.0))


def ratio_or_inf(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(float("inf")))


def masked(text: Column) -> Column:
    """Text with hex literals and digit runs replaced, so that equal faults read the same."""
    return F.regexp_replace(F.regexp_replace(text, "0x[0-9a-fA-F]+", "<hex>"), "[0-9]+", "<n>")
