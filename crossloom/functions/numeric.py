"""Rounding of a double's exact value, half to even, as the tapes' prices need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fixed(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def round3(x: Column | str) -> Column:
    """x to three decimals; 0.0005 is the one tie that the formatter gets wrong."""
    x = _col(x)
    return F.when(F.abs(x) == 0.0005, F.signum(x) * 0.001).otherwise(_fixed(x, "0.000").cast("double"))


def round6(x: Column | str) -> Column:
    """x to six decimals."""
    return _fixed(_col(x), "0.000000").cast("double")


def fixed3(x: Column | str) -> Column:
    """x with three decimals, as text."""
    x = _col(x)
    return F.when(x == 0.0005, F.lit("0.001")).when(x == -0.0005, F.lit("-0.001")).otherwise(_fixed(x, "0.000"))


def time_bin(ts: Column | str, width: Column | int) -> Column:
    """Start of the bin of width seconds that holds ts."""
    ts = _col(ts)
    return ts - F.pmod(ts, F.lit(width) if isinstance(width, int) else width)
