"""Writing results as tab-separated text, by Spark, in parts; and the layouts of lists and of values by time slice.

A layout is a frame whose columns are the fields of the format with `_` for `.`. Phases, metrics and their types are
known by identifiers made of their paths alone, so every layout can be made by itself and needs no numbering
of all paths. Slices are counted from time zero of the given rows.

Defined cases: an empty table gives a header only; null capacities are N/A; a path that repeats in a list is one entry
from its first beginning to its last end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import timeslices as T
from ..operators.bottlenecks import GLOBAL, LOCAL, NONE
from ..operators.intervals import END, START, running

#: How statuses are spelled.
LETTERS = {NONE: "N", LOCAL: "L", GLOBAL: "G"}


def export_tsv(df: DataFrame, place: str, dots: bool = False) -> None:
    """A header and tab-separated rows; booleans as TRUE and FALSE, strings in double quotes, unescaped.

    With dots, a layout's format: dots in the names of fields, no quotes, booleans as 1 and 0.
    """
    cell = {"boolean": lambda c: F.upper(c.cast("string")), "string": lambda c: F.concat(F.lit('"'), c, F.lit('"'))}
    if dots:
        cell = {"boolean": lambda c: c.cast("int").cast("string")}
    cells = [cell.get(kind, lambda c: c.cast("string"))(F.col(f"`{name}`")) for name, kind in df.dtypes]
    line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells])
    names = [n.replace("_", ".") if dots else n for n in df.columns]
    df.select(line.alias("\t".join(names))).write.option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").csv(place)


def identifier(path: Column) -> Column:
    """64 bits of a path's digest in hexadecimal."""
    return F.substring(F.md5(path), 1, 16)


def metric_types(metrics: DataFrame, kind: str = "consumable") -> DataFrame:
    return metrics.select("type").distinct().select(identifier(F.col("type")).alias("metric_type_id"), F.col("type").alias("metric_type_path"), F.lit(kind).alias("metric_class"))


def metric_list(metrics: DataFrame) -> DataFrame:
    """A row for each metric; capacity as text."""
    found = metrics.groupBy("path", "type").agg(F.max("capacity").alias("capacity"))
    return found.select(identifier(F.col("path")).alias("metric_id"), identifier(F.col("type")).alias("metric_type_id"), F.col("path").alias("metric_path"), F.coalesce(F.col("capacity").cast("string"), F.lit("N/A")).alias("capacity"))


def with_ancestors(phases: DataFrame) -> DataFrame:
    """path, type and time of phases and of all their ancestors, each over the time of what is below it."""
    untyped = lambda path: F.regexp_replace(path, r"\[[^\]]*\]", "")
    every = phases.select(START, END, F.explode(F.array_union(P.ancestors_of(F.col("path")), F.array("path"))).alias("path"))
    spans = every.groupBy("path").agg(F.min(START).alias(START), F.max(END).alias(END))
    return spans.withColumn("type", untyped(F.col("path")))


def _depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1).cast("long")


def _parent_id(path: Column) -> Column:
    above = P.parent_of(path)
    return F.when(path != "/", identifier(F.when(above == "", "/").otherwise(above)))


def phase_types(phases: DataFrame) -> DataFrame:
    """Types of the given phases, as with_ancestors returns them; the root has no parent."""
    t = F.col("type")
    return phases.select("type").distinct().select(identifier(t).alias("phase_type_id"), t.alias("phase_type_path"), _parent_id(t).alias("parent_phase_type_id"), _depth(t).alias("depth"))


def phase_list(phases: DataFrame, length: float, simulated: str = "") -> DataFrame:
    """Phases, as with_ancestors returns them, with slices and their place among the siblings by beginning and path.

    Give replayed times in place of measured ones and simulated="simulated_" for the layout of a replay. Phases
    shorter than a slice may end in the slice before their first.
    """
    p, first, last = F.col("path"), T.boundary(F.col(START), length), T.boundary(F.col(END), length) - 1
    rows = phases.withColumns({"_parent": F.coalesce(_parent_id(p), F.lit("")), "_one": F.lit(1)})
    placed = running(rows, ["_parent"], [START, "path"], {"_index": "_one"}, bucket=F.floor(F.col(START) / (length * T.SLICES)))
    return placed.select(
        identifier(p).alias("phase_id"), identifier(F.col("type")).alias("phase_type_id"), p.alias("phase_path"), _parent_id(p).alias("parent_phase_id"), _depth(p).alias("depth"),
        first.alias(f"{simulated}start_time_slice"), last.alias(f"{simulated}end_time_slice_inclusive"), (F.col("_index") - 1).alias("canonical_index"),
    )


def _runs(rows: DataFrame, ids: dict[str, str], value: str, length: float) -> DataFrame:
    named = rows.select(START, END, *[identifier(F.col(c)).alias(n) for n, c in ids.items()], value)
    return T.runs(named, list(ids), [value], length).withColumnsRenamed({T.FIRST: "start_time_slice", T.LAST: "end_time_slice_inclusive"})


def metric_runs(metrics: DataFrame, length: float, value: str = "usage", name: str = "observed_usage") -> DataFrame:
    """A metric's values in runs of slices; for blocking metrics give the boolean column and is_blocked."""
    return _runs(metrics.withColumn(name, F.col(value)), {"metric": "path"}, name, length)


def usage_by_slice(rows: DataFrame, length: float) -> DataFrame:
    """Attributed usage and available capacity of each metric (rows: path, times, usage, capacity) in each slice."""
    out = T.each_slice(rows, length)
    return out.select(identifier(F.col("path")).alias("metric"), F.col(T.SLICE).alias("time_slice"), "usage", "capacity")


def bottleneck_runs(rows: DataFrame, length: float) -> DataFrame:
    """Runs of slices in which a metric type is a bottleneck of a phase or is not (rows: phase, type, times, status)."""
    found = rows.withColumn("is_bottleneck", F.col("status") != NONE)
    return _runs(found, {"phase_id": "phase", "metric_type_id": "type"}, "is_bottleneck", length)


def status_runs(rows: DataFrame, length: float) -> DataFrame:
    """Runs of slices by a metric's status in a phase (rows: phase, metric, times, status), spelled as N, L or G."""
    letter = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])[F.col("status")]
    return _runs(rows.withColumn("bottleneck_status", letter), {"phase_id": "phase", "metric": "metric"}, "bottleneck_status", length)
