"""Numeric helpers with the reference's exact rounding/formatting rules
(I7-I9, I12, I13, I19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(c, nd: int) -> Column:
    """Python ``round(x, nd)`` / ``f"{x:.{nd}f}"`` on the binary value:
    ``format_number`` is correctly rounded (half-even on exact ties), unlike
    ``round``/``bround`` on a scaled double."""
    return F.regexp_replace(F.format_number(_col(c), nd), ",", "").cast("double")


def fixed(c, nd: int, thousands: bool = False) -> Column:
    """Text like Python ``f"{x:.{nd}f}"`` (``,.{nd}f`` with ``thousands``)."""
    s = F.format_number(_col(c), nd)
    return s if thousands else F.regexp_replace(s, ",", "")


def pandas_round(c, nd: int) -> Column:
    """pandas ``Series.round(nd)``: half-even on the *scaled* value."""
    k = float(10 ** nd)
    return F.rint(_col(c) * k) / k


def parse_mid(c) -> Column:
    """I7 ``parse_mid("lo-hi")``: mean of the first and last '-' separated
    parts, rounded to 1 dp; any parse error -> 0.0 (so "18-20 (point of
    lay)" -> 0.0 and "-5" -> 0.0)."""
    parts = F.split(_col(c).cast("string"), "-", -1)
    lo = F.element_at(parts, 1).try_cast("double")
    hi = F.element_at(parts, -1).try_cast("double")
    m = (lo + hi) / 2
    ok = m.isNotNull() & ~F.isnan(m) & (F.abs(m) != float("inf"))
    return F.when(ok, py_round(m, 1)).otherwise(F.lit(0.0))


def rnd(c, nd: int) -> Column:
    """Presentation rounding, half-up on the scaled double:
    ``floor(x * 10^nd + 0.5) / 10^nd``.  Plain IEEE operations, so any engine
    evaluating the same formula returns the identical double (``round`` on a
    double differs between engines at binary near-ties)."""
    k, v = float(10 ** nd), _col(c).cast("double")
    # floor() gives a bigint: NaN, infinities and numbers beyond it stay as they are
    return F.when(F.abs(v) * k < 9.0e18, F.floor(v * k + 0.5) / k).otherwise(v)
