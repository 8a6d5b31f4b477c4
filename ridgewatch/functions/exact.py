"""Rounding as decimal text does it: the exact binary value, ties to even."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """x with a fixed number of decimals, as text, without grouping."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def _least_rounded_up(digits: int) -> float:
    """The least number that rounds up to one unit of the last decimal."""
    tie = Decimal(5).scaleb(-digits - 1)
    near = float(tie)
    return near if Decimal(near) > tie else math.nextafter(near, 1.0)


def exact_round(x: Column, digits: int) -> Column:
    """x rounded to a number of decimals; NaN and infinities stay.

    Below one unit of the last decimal the text form would round a lone 5 down, so these values are compared instead.
    """
    unit, size = 10.0**-digits, F.abs(x)
    odd = F.isnan(x) | (size == float("inf"))
    small = F.when(size >= _least_rounded_up(digits), F.signum(x) * unit).otherwise(0.0)
    return F.when(odd, x).when(size < unit, small).otherwise(fixed(x, digits).cast("double"))
