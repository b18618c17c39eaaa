"""Arithmetic, comparisons and aggregates that keep to IEEE doubles where Spark does not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def equal(a: Column, b: Column) -> Column:
    """NaN equals nothing."""
    return (a == b) & ~F.isnan(a)


def greater(a: Column, b: Column) -> Column:
    """NaN is neither greater nor less."""
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def at_least(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a) & ~F.isnan(b)


def min_of(*values: Column) -> Column:
    """The least value; NaN if one is NaN."""
    return F.when(reduce(lambda x, y: x | y, [F.isnan(v) for v in values]), F.lit(NAN)).otherwise(F.least(*values))


def max_of(*values: Column) -> Column:
    return F.greatest(*values)


def all_of(*values: Column) -> Column:
    """min_of for booleans."""
    return F.least(*values)


def any_of(*values: Column) -> Column:
    return F.greatest(*values)


def as_numeric(value: Column) -> Column:
    """1.0 for true, 0.0 for false."""
    return value.cast("double")


def count() -> Column:
    return F.count(F.lit(1)).cast("double")


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def minimum(value: Column) -> Column:
    """min of doubles; NaN if any value is NaN."""
    return F.when(F.max(F.isnan(value)), F.lit(NAN)).otherwise(F.min(value))


def weighted_avg(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of weights; NaN for weights of sum zero."""
    return divide(F.sum(value * weight), F.sum(weight))


def avg_over_time(value: Column) -> Column:
    """Mean of value, each row weighing the length of its interval."""
    return weighted_avg(value, F.col("_end_time") - F.col("_start_time"))


def first_row(value: Column, *order: str) -> Column:
    """value of the row that comes first in order, which has to be total."""
    return F.min_by(value, F.struct(*order))


def find_or_default(condition: Column, value: Column, default: Column, *order: str) -> Column:
    """value of the first row for which condition holds, else the first row's default."""
    place = F.struct(*order)
    return F.coalesce(F.min_by(F.when(condition, value), F.when(condition, place)), F.min_by(default, place))
