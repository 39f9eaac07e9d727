"""Column functions: deterministic draws, rounding, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_int(*key: Column | str, below: Column | int) -> Column:
    """A whole number in [0, below) from the md5 of the key's parts joined by bars; the same in any SQL engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below))


def draw_unit(*key: Column | str) -> Column:
    """A number in [0, 1) from the same digest."""
    return draw_int(*key, below=1 << 32) / F.lit(float(1 << 32))


def md5_key(*key: Column | str) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def r6(column: Column | str) -> Column:
    """Rounded to six places, so that sums in another order compare equal."""
    return F.round(column, 6)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """A quotient that is 0 where the denominator is 0 or null."""
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    return F.coalesce(n / F.when(d != 0, d), F.lit(0.0))


def epoch(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6
