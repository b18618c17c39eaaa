"""Bottlenecks and performance issues over attributed usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import DURATION, temporal_aggregate

GLOBAL, LOCAL, NONE = "GLOBAL", "LOCAL", "NONE"


def status(usage: Column, available: Column, sample: Column, capacity: Column, threshold: float = 0.95) -> Column:
    """GLOBAL if the resource is used up, LOCAL if the phase's own share is."""
    return F.when(sample >= threshold * capacity, GLOBAL).when(usage >= threshold * available, LOCAL).otherwise(NONE)


def of_type(rows: DataFrame, by: list[str], name: str = "status") -> DataFrame:
    """A metric type's status: GLOBAL if all its metrics are, else LOCAL if any is a bottleneck."""
    rule = F.when(F.min(F.col(name) == GLOBAL), GLOBAL).when(F.max(F.col(name) != NONE), LOCAL).otherwise(NONE)
    return rows.groupBy(*by).agg(rule.alias(name))


def combine(rows: DataFrame, by: list[str], name: str = "status") -> DataFrame:
    """Predicates over the members of each group: any, all, or at least half of them have a bottleneck."""
    found = F.col(name) != NONE
    return rows.groupBy(*by).agg(F.max(found).alias("any"), F.min(found).alias("all"), (2 * F.count_if(found) >= F.count(F.lit(1))).alias("majority"))


def combine_by_type(rows: DataFrame, by: list[str], type_: str, name: str = "status") -> DataFrame:
    """Predicates in two steps, within each type of the members and then over the types: every type has a bottleneck in any of
    its members, or some type has one in all of them."""
    found = F.col(name) != NONE
    types = rows.groupBy(*by, type_).agg(F.max(found).alias("_any"), F.min(found).alias("_all"))
    return types.groupBy(*by).agg(F.min("_any").alias("every_type"), F.max("_all").alias("whole_type"))


def duration_issues(rows: DataFrame, phase: str, cause: str, bucket: float, name: str = "status") -> DataFrame:
    """Per phase and cause that is the only one at some time: the phase's time with any bottleneck, what remains of it once the cause is removed, and what that saves.

    Causes may change at different times: they are compared on the slices between the changes of all of a phase's causes. A cause's own rows may not overlap.
    """
    hits = rows.filter(F.col(name) != NONE)
    cells = temporal_aggregate(hits, [phase], {"_n": F.count(F.lit(1)), cause: F.min(cause)}, bucket, merge=False)
    alone = F.col("_n") == 1
    sums = cells.groupBy(phase, F.when(alone, F.col(cause)).alias(cause)).agg(F.sum(DURATION).alias("saving"))
    total = F.sum("saving").over(Window.partitionBy(phase))  # a row per cause
    found = sums.withColumn("bottlenecked", total).filter(F.col(cause).isNotNull())
    return found.select(phase, cause, "bottlenecked", (F.col("bottlenecked") - F.col("saving")).alias("remaining"), "saving")


def durations(rows: DataFrame, slice_of: list[str], cause: str, by: list[str], name: str = "status") -> DataFrame:
    """Time with a bottleneck of each cause, time in which it is the only cause, and time without.

    slice_of names one slice of one phase; a row is the status of one cause in it.
    """
    joined = rows.withColumn("n_causes", F.count_if(F.col(name) != NONE).over(Window.partitionBy(*slice_of)))
    here = F.col(name) != NONE
    time = lambda c: F.sum(F.when(c, F.col(DURATION)).otherwise(0.0))
    return joined.groupBy(*by, cause).agg(time(here).alias("bottlenecked"), time(here & (F.col("n_causes") == 1)).alias("uniquely"), time(~here).alias("free"))


def imbalance(phases: DataFrame, parent: str, type_: str) -> DataFrame:
    """Per parent and type: phases, mean and longest duration, and what balance would save."""
    return phases.groupBy(parent, type_).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(DURATION).alias("mean"), F.max(DURATION).alias("longest"), (F.max(DURATION) - F.avg(DURATION)).alias("saving"))


def balanced_makespan(phases: DataFrame, parent: str, type_: str) -> DataFrame:
    """Per parent whose phases follow one another: makespan as measured, and with each phase as long as its type's mean."""
    mean = phases.groupBy(type_).agg(F.avg(DURATION).alias("mean"))
    return phases.join(mean, type_).groupBy(parent).agg(F.sum(DURATION).alias("measured"), F.sum("mean").alias("balanced"))


def finish_times(phases: DataFrame, edges: DataFrame) -> DataFrame:
    """Earliest finish of each phase (id, duration) when it starts as its predecessors (edges: id, after) end.

    Each round hands finishes on along all edges and stops when none moves; rounds are as many as the longest
    chain. The graph may not have cycles.
    """
    from ..functions.session import cut

    times = cut(phases.select("id", "duration", F.col("duration").alias("finish")))
    n = times.count()
    for _ in range(n + 1):
        ready = edges.join(times.select(F.col("id").alias("after"), "finish"), "after").groupBy("id").agg(F.max("finish").alias("ready"))
        new = cut(times.join(ready, "id", "left").select("id", "duration", (F.coalesce("ready", F.lit(0.0)) + F.col("duration")).alias("next"), "finish"))
        moved = not new.filter("next <> finish").isEmpty()
        times = new.select("id", "duration", F.col("next").alias("finish"))
        if not moved:
            return times.select("id", "finish")
    raise ValueError("the phases wait for one another in a circle")
