"""Small numeric Column helpers. NULL means undefined; NaN never leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an odd rounding offset. Sums of doubles depend on order, and structured inputs
# often sit on exact decimal ties; moving the tie keeps the rounded report independent of order.
ROUND_OFFSET = 0.5000317


def fix(value, digits: int = 6) -> Column:
    """Round for reports: one IEEE expression that other engines reproduce exactly."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(ROUND_OFFSET)).cast("double") / F.lit(scale)


def db_power(power: Column) -> Column:
    """10 log10 of a power, NULL on exact silence."""
    return F.when(power > 0, 10 * F.log10(power))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def wrap_pi(angle: Column) -> Column:
    """Wrap a phase difference to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL on a zero base instead of an infinite ratio."""
    return F.when(bottom != 0, top / bottom)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def rms_array(values: Column) -> Column:
    """Root mean square of an array; 0 when empty."""
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(
        F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(values))
    )
