"""Exact money aggregation and rounding.

Sums run over integer cents, or over decimals for rows with an exchange rate, so that they do
not depend on the order in which partitions arrive. Results leave as double USD.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUM_TYPE = "decimal(38,11)"
# Cents of any long times a rate fill 38 digits: rates below ten million keep eleven places.
CENTS, RATE = "decimal(19,0)", "decimal(18,11)"


def as_col(value):
    return value if isinstance(value, Column) else F.col(value)


def cents_sum(cents, when=None):
    """Exact sum of ``cents * fx_rate`` over the rows meeting ``when``; NULL when none does."""
    value = as_col(cents)
    if when is not None:
        value = F.when(when, value)
    at_par = F.col("fx_rate").eqNullSafe(1.0)
    plain = F.sum(F.when(at_par, value)).cast(_SUM_TYPE)
    rate = F.col("fx_rate").cast(RATE)
    converted = F.sum(F.when(~at_par, value.cast(CENTS) * rate)).cast(_SUM_TYPE)
    return F.coalesce(plain + converted, plain, converted)


def to_usd(cents):
    """Exact cents to double USD."""
    return cents.cast("double") / F.lit(100.0)


def usd_sum(cents, when=None):
    return to_usd(cents_sum(cents, when))


def count_when(condition):
    """Number of rows meeting the condition, 0 when none does."""
    return F.count(F.when(condition, F.lit(1)))


def round_half_up(value, places):
    """Decimal rounding, half away from zero; the six-digit cast drops float noise first."""
    return F.round(as_col(value).cast("decimal(28,6)"), places).cast("double")


def round_toward_plus(value, places=0):
    """Browser-style rounding: half toward plus infinity."""
    scale = float(10**places)
    return F.floor(as_col(value) * scale + 0.5).cast("double") / scale


def ratio(numerator, denominator):
    """Division, NULL when the denominator is 0 or NULL."""
    top, bottom = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(bottom != 0, top / bottom)


def percent(numerator, denominator, places=1):
    """Rounded percentage, 0.0 when there is nothing to divide by."""
    return F.coalesce(
        round_half_up(ratio(numerator, denominator) * 100.0, places), F.lit(0.0)
    )


def or_zero(value):
    return F.coalesce(as_col(value), F.lit(0.0))
