"""Rounding to a precision's order or to significant figures, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_int(x: Column) -> Column:
    """Decimal order, rounded down; -300 for NaN and what is under 1e-300, 300 above 1e300."""
    return F.when(F.isnan(x) | (x < 1e-300), -300).when(x > 1e300, 300).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")


def to_decimals(x: Column, n: Column) -> Column:
    up = F.pow(F.lit(10.0), F.abs(n))
    return F.when(n >= 0, F.rint(x * up) / up).otherwise(F.rint(x / up) * up)


def round_to(x: Column, prec: Column) -> Column:
    """``x`` to the decimal order of ``prec``; as it is if ``prec`` is NaN."""
    return F.when(F.isnan(prec), x).otherwise(to_decimals(x, -log10_int(prec)))


def round_figures(x: Column, figures: int) -> Column:
    return to_decimals(x, F.lit(figures - 1) - log10_int(x))


def with_precision(val: Column, prec: Column, figures: int = 4) -> Column:
    """Text of a value and its precision: the precision to one figure, the value to its order.

    Without a precision ``figures`` significant figures; with a precision of nought ten decimals."""
    plain = lambda x: F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")
    both = F.get(F.transform(F.array(round_figures(prec, 1)), lambda one: F.concat(plain(round_to(val, one)), F.lit(" ±"), plain(one))), 0)
    return F.when(F.isnan(prec), plain(round_figures(val, figures))).when(prec == 0, F.concat(plain(val), F.lit(" ±0"))).otherwise(both)
