"""Rounding and number text with half-even, exact-binary semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` moved into [low, high]; NULL stays NULL, which ``least`` alone would turn into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def nearest_int(x: Column) -> Column:
    """Nearest integer; halves go to the even neighbour."""
    return F.rint(x.cast("double")).cast("int")


def fixed_text(x: Column, decimals: int) -> Column:
    """Fixed-point text of the exact binary value; halves go to the even digit.

    ``format_string`` and ``round`` are half-up on the shortest decimal form; the pattern form of
    ``format_number`` rounds the stored value itself.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def round_half_even(x: Column, decimals: int) -> Column:
    return fixed_text(x, decimals).cast("double")


def double_text(x: Column) -> Column:
    """Shortest text of a double in plain notation down to 1e-4, as ``7.0``, ``0.0005``, ``5e-05``."""
    text = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,22)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(text, r"(\.0)?E.*$", "")
    exponent = F.lpad(F.regexp_extract(text, r"E-(\d+)$", 1), 2, "0")
    small = F.abs(x)
    return (
        F.when((small >= 1e-4) & (small < 1e-3), plain)
        .when((small > 0) & (small < 1e-4), F.concat(mantissa, F.lit("e-"), exponent))
        .otherwise(text)
    )
