"""Intervals in numbered slices of equal length.

A slice belongs to an interval if the interval covers at least its later half: beginnings round half up to
a slice's beginning, ends to the end of the slice before. Intervals that cover no slice have none.

Defined cases: null times and empty tables give no rows; repeated rows stay; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import END, START, coalesce_intervals

FIRST, LAST, SLICE = "start_slice", "end_slice", "slice"
#: Slices of a bucket in which runs are merged before they meet others.
SLICES = 4096


def boundary(time: Column, length: float) -> Column:
    """The slice that begins nearest to a time; halves round up."""
    return F.floor(time / length + 0.5)


def in_slices(df: DataFrame, length: float) -> DataFrame:
    """Rows that have a slice, with their first and last one."""
    found = df.withColumns({FIRST: boundary(F.col(START), length), LAST: boundary(F.col(END), length) - 1})
    return found.filter(F.col(FIRST) <= F.col(LAST))


def each_slice(df: DataFrame, length: float) -> DataFrame:
    """A row for each slice of each row."""
    return in_slices(df, length).withColumn(SLICE, F.explode(F.sequence(FIRST, LAST)))


def runs(df: DataFrame, series: list[str], values: list[str], length: float) -> DataFrame:
    """Runs of slices in which a series keeps its values: series, first and last slice, values. Rows of a series don't overlap."""
    rows = in_slices(df, length).select(*series, *values, F.col(FIRST).alias(START), (F.col(LAST) + 1).alias(END))
    merged = coalesce_intervals(rows, series, values, SLICES)
    return merged.select(*series, F.col(START).cast("long").alias(FIRST), (F.col(END) - 1).cast("long").alias(LAST), *values)
