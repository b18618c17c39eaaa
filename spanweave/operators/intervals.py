"""Operators on intervals: rows with half-open [_start_time, _end_time) in seconds.

`keys` name the columns that tell series apart. None of the operators collects rows to the driver;
each is a composition of joins, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import stored

START, END, DURATION = RESERVED = ("_start_time", "_end_time", "_duration")


def with_duration(df: DataFrame) -> DataFrame:
    return df.withColumn(DURATION, F.col(END) - F.col(START))


def aliased(df: DataFrame, alias: str) -> DataFrame:
    """Every column as alias_name, reserved ones as alias_start_time and so on."""
    return df.select(*[F.col(c).alias(f"{alias}_{c.lstrip('_')}") for c in df.columns])


def _buckets(start: Column, end: Column, width: float) -> Column:
    """Numbers of the buckets of time that [start, end) touches."""
    first, last = F.floor(start / width).cast("long"), F.ceil(end / width).cast("long") - 1
    return F.sequence(first, F.greatest(first, last))


def overlap_join(left: DataFrame, right: DataFrame, aliases: tuple[str, str], on: list[tuple[str, str]] = (), bucket: float | None = None) -> DataFrame:
    """Pairs of rows that overlap in time and agree in the columns `on`; the result's interval is the overlap.

    With columns to agree in, Spark joins on them. Without, rows are dealt to buckets of `bucket`
    seconds and joined on those; a pair counts in the bucket where its overlap begins.
    """
    a, b = aliases
    x, y = aliased(left, a), aliased(right, b)
    meet = [F.col(f"{a}_{p.lstrip('_')}") == F.col(f"{b}_{q.lstrip('_')}") for p, q in on]
    start, end = F.greatest(f"{a}_start_time", f"{b}_start_time"), F.least(f"{a}_end_time", f"{b}_end_time")
    if not bucket and not meet:
        raise ValueError("a join without columns to agree in needs a bucket width")
    if bucket:
        x = x.withColumn("_bucket", F.explode(_buckets(F.col(f"{a}_start_time"), F.col(f"{a}_end_time"), bucket)))
        y = y.withColumn("_bucket2", F.explode(_buckets(F.col(f"{b}_start_time"), F.col(f"{b}_end_time"), bucket)))
        meet = [*meet, F.col("_bucket") == F.col("_bucket2"), F.col("_bucket") == F.floor(start / bucket)]
    meet = [*meet, F.col(f"{a}_start_time") < F.col(f"{b}_end_time"), F.col(f"{b}_start_time") < F.col(f"{a}_end_time")]
    joined = x.join(y, reduce(lambda p, q: p & q, meet)).drop("_bucket", "_bucket2")
    return joined.select(start.alias(START), end.alias(END), (end - start).alias(DURATION), *joined.columns)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, bucket: Column | None = None) -> DataFrame:
    """df with running sums and maxima (new column: column) over the rows of each group up to and with the row, in a total order.

    bucket, a column that grows with the order, splits a group over tasks: rows run inside a bucket, and go on from what the
    buckets before add up to.
    """
    exprs = {n: (F.sum, c) for n, c in (sums or {}).items()} | {n: (F.max, c) for n, c in (maxima or {}).items()}
    if bucket is None:
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: f(c).over(over) for n, (f, c) in exprs.items()})
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_b").agg(*[f(c).alias(f"_{n}") for n, (f, c) in exprs.items()])
    totals = totals.select(*by, "_b", *[f(f"_{n}").over(before).alias(f"_{n}") for n, (f, c) in exprs.items()])
    joined = rows.withColumns({n: f(c).over(inside) for n, (f, c) in exprs.items()}).join(totals, [*by, "_b"])
    both = {n: F.greatest(n, f"_{n}") if n in (maxima or {}) else F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in exprs}
    return joined.withColumns(both).select(*df.columns, *exprs)


def split_at(df: DataFrame, bucket: float) -> DataFrame:
    """The rows cut at the edges of buckets of time, with the bucket's number as _b."""
    rows = df.withColumn("_b", F.explode(_buckets(F.col(START), F.col(END), bucket)))
    rows = rows.withColumns({START: F.greatest(F.col(START), F.col("_b") * bucket), END: F.least(F.col(END), (F.col("_b") + 1) * bucket)})
    return rows.filter(F.col(START) < F.col(END))


def slices(df: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """The elementary slices between neighbouring change points of each group of keys.

    With bucket, the edges of buckets are change points too, and no task gets more than a bucket
    of a group; _seam marks the slices that begin at an edge where nothing changes.
    """
    if not bucket:
        points = df.select(*keys, F.explode(F.array(START, END)).alias("s")).distinct()
        return points.withColumn("e", F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))).filter(F.col("e").isNotNull())
    point = lambda at, seam: F.struct(at.cast("double").alias("s"), F.lit(seam).alias("seam"))
    edges = F.flatten(F.transform(_buckets(F.col(START), F.col(END), bucket), lambda b: F.array(point(b * bucket, True), point((b + 1) * bucket, True))))
    points = df.select(*keys, F.explode(F.concat(F.array(point(F.col(START), False), point(F.col(END), False)), edges)).alias("p"))
    points = points.groupBy(*keys, F.col("p.s").alias("s")).agg(F.min("p.seam").alias("_seam")).withColumn("b", F.floor(F.col("s") / bucket))
    last = (F.col("b") + 1) * bucket
    return points.withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy(*keys, "b").orderBy("s")), last)).drop("b")


def temporal_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, Column], bucket: float | None = None, merge: bool = True, seams: bool = True, combine: dict[str, Callable] | None = None) -> DataFrame:
    """Aggregates over the rows active in each elementary slice, by group of keys.

    Slices without an active row give none. Neighbouring slices of equal values are merged. With a
    bucket (seconds; needed without keys) slices and rows meet in buckets of time, so a hot group is
    spread over tasks and no slice meets rows that are far from it. Unmerged slices are then cut at the
    edges of buckets; without seams those parts are put together again.

    Slices times active rows are quadratic where many rows are active at once. combine (with a bucket) has for each aggregate the function
    that puts together its values over parts of the rows, such as F.sum for a count; then a row meets as many runs of slices as
    the logarithm of the slices in a bucket, and a slice as many runs.
    """
    cut = slices(df, keys, bucket)
    if combine:
        out = _over_runs(df, cut, keys, aggregates, combine, bucket)
    elif bucket:
        rows = df.withColumn("_b", F.explode(_buckets(F.col(START), F.col(END), bucket)))
        cut = cut.withColumn("_b", F.floor(F.col("s") / bucket))
        joined = rows.join(cut, [*keys, "_b"])
    else:
        joined = df.join(cut, keys)
    if not combine:
        active = joined.filter((F.col(START) <= F.col("s")) & (F.col(END) >= F.col("e")))
        out = active.groupBy(*keys, *(["_b", "_seam"] if bucket else []), "s", "e").agg(*[c.alias(n) for n, c in aggregates.items()])
    out = out.withColumnsRenamed({"s": START, "e": END})
    if bucket and not (merge or seams):
        out = _without_seams(out, keys, list(aggregates))
    out = with_duration(out).select(START, END, DURATION, *keys, *aggregates)
    return coalesce_intervals(out, keys, list(aggregates), bucket) if merge else out


def _over_runs(df: DataFrame, cut: DataFrame, keys: list[str], aggregates: dict[str, Column], combine: dict[str, Callable], bucket: float) -> DataFrame:
    """Aggregates for the slices of cut (keys, s, e, _seam) in which a row is active.

    The slices of a bucket have places from 0. Runs of 2**k places, beginning at multiples of that, make a tree: the places of a row are
    the disjoint union of two runs a level at most, and a place lies in one run a level.
    """
    by = [*keys, "_b"]
    places = cut.withColumn("_b", F.floor(F.col("s") / bucket))
    places = stored(places.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy("s")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))}))
    rows = df.filter(F.col(START) < F.col(END)).withColumn("_b", F.explode(_buckets(F.col(START), F.col(END), bucket)))
    rows = rows.withColumns({"s": F.greatest(F.col(START), (F.col("_b") * bucket).cast("double")), "e": F.least(F.col(END), ((F.col("_b") + 1) * bucket).cast("double"))})
    rows = rows.join(places.select(*by, "s", F.col("_i").alias("_from")), [*by, "s"]).join(places.select(*by, "e", (F.col("_i") + 1).alias("_to")), [*by, "e"])
    run = lambda k, at, here: F.when(here, F.struct(k.alias("k"), at.cast("long").alias("at")))

    def runs(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        first, last = F.ceil(F.col("_from") / size), F.floor(F.col("_to") / size)
        return F.array(run(k, first, (first < last) & (first % 2 == 1)), run(k, last - 1, (first < last) & (last % 2 == 1)))

    levels = lambda n: F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int"))
    held = rows.withColumn("_r", F.explode(F.filter(F.flatten(F.transform(levels(F.col("_to") - F.col("_from")), runs)), lambda r: r.isNotNull())))
    held = held.withColumns({"_k": F.col("_r.k"), "_at": F.col("_r.at")}).groupBy(*by, "_k", "_at").agg(*[c.alias(n) for n, c in aggregates.items()])
    asked = places.withColumn("_k", F.explode(levels(F.col("_n")))).withColumn("_at", F.floor(F.col("_i") / F.pow(F.lit(2.0), F.col("_k"))))
    return asked.join(held, [*by, "_k", "_at"]).groupBy(*by, "_seam", "s", "e").agg(*[combine[n](n).alias(n) for n in aggregates])


def _without_seams(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Slices (with _b and _seam) joined across edges of buckets where nothing changes: only the first and the last slice of a bucket meet others."""
    ends = Window.partitionBy(*keys, "_b")
    marked = df.withColumn("_edge", (F.col(START) == F.min(START).over(ends)) | (F.col(START) == F.max(START).over(ends)))
    over = Window.partitionBy(*keys).orderBy(START)
    edges = marked.filter("_edge")
    edges = edges.withColumn("_run", F.sum(F.when(F.col("_seam") & (F.lag(END).over(over) == F.col(START)), 0).otherwise(1)).over(over))
    joined = edges.groupBy(*keys, "_run").agg(F.min(START).alias(START), F.max(END).alias(END), *[F.min_by(v, START).alias(v) for v in values])
    columns = [START, END, *keys, *values]
    return joined.select(*columns).unionByName(marked.filter("not _edge").select(*columns))


def temporal_sum(df: DataFrame, keys: list[str], value: str, bucket: float | None = None) -> DataFrame:
    """Sum of value over the active rows by changes at the ends of rows: one row per change, never slices times rows.

    Sums run through the changes, so doubles may differ from the exact operator in the last digits. With bucket, the changes
    of a group run through buckets of time.
    """
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(START).alias("s"), F.col(value).alias("v"), F.lit(1).alias("n")), F.struct(F.col(END).alias("s"), (-F.col(value)).alias("v"), F.lit(-1).alias("n")))).alias("p"))
    changes = ends.groupBy(*keys, F.col("p.s").alias("s")).agg(F.sum("p.v").alias("v"), F.sum("p.n").alias("n"))
    at = F.floor(F.col("s") / bucket) if bucket else None
    out = running(changes, keys, ["s"], sums={"_v": "v", "_n": "n"}, bucket=at)
    out = _until_next(out, keys, bucket)
    return with_duration(out.filter("_n > 0").select(*keys, F.col("s").alias(START), F.col("_e").alias(END), F.col("_v").alias(value)))


def _until_next(changes: DataFrame, keys: list[str], bucket: float | None) -> DataFrame:
    """Changes (keys, s) with _e, when the next one of the group comes; with bucket, that of a bucket's last is the first of the next bucket with changes."""
    if not bucket:
        return changes.withColumn("_e", F.lead("s").over(Window.partitionBy(*keys).orderBy("s")))
    inside, out = Window.partitionBy(*keys, "_b").orderBy("s"), changes.withColumn("_b", F.floor(F.col("s") / bucket))
    firsts = out.groupBy(*keys, "_b").agg(F.min("s").alias("s"))
    firsts = firsts.select(*keys, "_b", F.lead("s").over(Window.partitionBy(*keys).orderBy("_b")).alias("_next"))
    return out.withColumn("_e", F.lead("s").over(inside)).join(firsts, [*keys, "_b"]).withColumn("_e", F.coalesce("_e", "_next"))


#: Groups of fewer rows than this are dealt out whole, larger ones by buckets of time.
LARGE_GROUP = 100_000


def _code(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).cast("int")


def large_groups(df: DataFrame, keys: list[str], most: int | None = None) -> Column:
    """Whether a row's group may have more than `most` rows in df: a condition that holds for any table with the same keys.

    Groups are counted by a hash of 16 bits, so that what is counted and sent has a fixed size; small groups under the hash of
    a large one go with it. What a caller does for either part has to give the same rows.
    """
    counts = df.groupBy(_code(keys).alias("_code")).count().agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("count") > (LARGE_GROUP if most is None else most), F.col("_code"))).alias("large")).first()
    if len(counts["large"]) > 256 or 0 < counts["n"] == len(counts["large"]):
        return F.lit(True)
    return _code(keys).isin(counts["large"]) if counts["large"] else F.lit(False)


def parts(condition: Column) -> tuple[bool, bool]:
    """Whether large_groups leaves small groups, and large ones."""
    known = {"true": (False, True), "false": (True, False)}
    return known.get(condition._jc.toString(), (True, True))


def temporal_state(df: DataFrame, keys: list[str], counts: list[str], state: Column, bucket: float | None = None) -> DataFrame:
    """keys, interval, state: runs of equal state, which is a function of the sums of counts over the active rows of a group.

    counts name columns of whole numbers, so sums are exact; the first one is 1 in every row, and there is no run where its sum is
    0. Sums run through the changes at the ends of rows: two rows for each row of df, where slices times active rows are
    quadratic. df is read twice. With bucket, large groups are summed up by time before they are moved, and run through buckets.
    """
    rows = df.filter(F.col(START) < F.col(END)).select(*keys, START, END, *counts)
    is_large = large_groups(rows, keys) if bucket and keys else F.lit(bool(bucket))
    small, large = parts(is_large)

    def changes(rows: DataFrame) -> DataFrame:
        at = lambda time, sign: F.struct(F.col(time).alias("s"), *[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in counts])
        ends = rows.select(*keys, F.explode(F.array(at(START, 1), at(END, -1))).alias("p")).select(*keys, "p.*")
        found = ends.groupBy(*keys, "s").agg(*[F.sum(c).alias(c) for c in counts])
        return found.filter(" or ".join(f"{c} <> 0" for c in counts))

    def of_small(rows: DataFrame) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy("s")
        sums = changes(rows.repartition(*map(F.col, keys)) if keys else rows).withColumns({c: F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in counts})
        sums = sums.select(*keys, "s", F.when(F.col(counts[0]) > 0, state).alias("state"))
        fresh = ~F.col("state").eqNullSafe(F.lag("state").over(over)) | F.lag("s").over(over).isNull()
        runs = sums.withColumn("_new", fresh).filter("_new").withColumn(END, F.lead("s").over(over))
        return runs.filter("state is not null").select(*keys, F.col("s").alias(START), END, "state")

    def of_large(rows: DataFrame) -> DataFrame:
        sums = running(changes(rows), keys, ["s"], {f"_{c}": c for c in counts}, bucket=F.floor(F.col("s") / bucket)).drop(*counts).withColumnsRenamed({f"_{c}": c for c in counts})
        found = _until_next(sums, keys, bucket).filter(F.col(counts[0]) > 0).select(*keys, F.col("s").alias(START), F.col("_e").alias(END), state.alias("state"))
        return coalesce_intervals(found, keys, ["state"], bucket).select(*keys, START, END, "state")

    found = [of_small(rows.filter(~is_large))] * small + [of_large(rows.filter(is_large))] * large
    return reduce(DataFrame.unionByName, found)


def coalesce_intervals(df: DataFrame, series: list[str], values: list[str], bucket: float | None = None) -> DataFrame:
    """Merge consecutive rows of a series when one ends where the next begins and all values agree.

    With bucket, rows are first merged inside buckets of time. Only the first and the last run of each
    bucket then meet their neighbours, two rows a bucket whatever the number of rows.
    """
    if not bucket:
        return with_duration(_merged(df, series, series, values)).select(*RESERVED, *series, *values)
    runs = _merged(df.withColumn("_b", F.floor(F.col(START) / bucket)), [*series, "_b"], [*series, "_b"], values)
    ends = Window.partitionBy(*series, "_b")
    runs = runs.withColumn("_edge", (F.col(START) == F.min(START).over(ends)) | (F.col(START) == F.max(START).over(ends)))
    edges = _merged(runs.filter("_edge"), series, series, values)
    return with_duration(edges.unionByName(runs.filter("not _edge").drop("_b", "_edge"))).select(*RESERVED, *series, *values)


def _merged(df: DataFrame, by: list[str], series: list[str], values: list[str]) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(START)
    same = F.lag(END).over(over) == F.col(START)
    for v in values:
        same = same & F.lag(v).over(over).eqNullSafe(F.col(v))
    marked = df.withColumn("_new", F.when(same, 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(over))
    return runs.groupBy(*series, "_run").agg(F.min(START).alias(START), F.max(END).alias(END), *[F.first(v).alias(v) for v in values]).drop("_run")


def covered_time(df: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """The union of each group's intervals, as disjoint intervals; with bucket a group is covered by buckets of time."""
    if bucket:
        return coalesce_intervals(covered_time(split_at(df.select(*keys, START, END), bucket), [*keys, "_b"]), keys, [], bucket).drop(DURATION)
    over = Window.partitionBy(*keys).orderBy(START, END)
    reach = F.max(END).over(over.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.when(reach >= F.col(START), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("_run")


def interval_minus(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], bucket: float | None = None) -> DataFrame:
    """What is left of each row of left without the times of right in the same group; row tells rows of left apart.

    With bucket, both sides are cut at the edges of buckets and meet inside one; what is left of a row is put together again.
    """
    if bucket:
        parts = interval_minus(split_at(left, bucket), split_at(right.select(*keys, START, END), bucket), [*keys, "_b"], [*row, "_b"])
        return with_duration(_merged(parts, row, [c for c in left.columns if c not in RESERVED], [])).select(*left.columns)
    gone = covered_time(right, keys).select(*keys, F.col(START).alias("_gs"), F.col(END).alias("_ge"))
    met = left.alias("l").join(gone.alias("g"), [F.col(f"l.{k}") == F.col(f"g.{k}") for k in keys] + [F.col(START) < F.col("_ge"), F.col("_gs") < F.col(END)], "left")
    met = met.select("l.*", "_gs", "_ge")
    over = Window.partitionBy(*row).orderBy("_gs")
    ahead = met.withColumn("_next", F.lead("_gs").over(over)).withColumn("_first", F.row_number().over(over) == 1)
    pieces = F.array(
        F.when(F.col("_first"), F.struct(F.col(START).alias("s"), F.coalesce("_gs", END).alias("e"))),
        F.when(F.col("_gs").isNotNull(), F.struct(F.col("_ge").alias("s"), F.coalesce("_next", END).alias("e"))),
    )
    out = ahead.withColumn("_p", F.explode(F.filter(pieces, lambda p: p.isNotNull()))).filter("_p.s < _p.e")
    out = out.withColumn(START, F.col("_p.s")).withColumn(END, F.col("_p.e")).drop("_p", "_gs", "_ge", "_next", "_first")
    return with_duration(out).select(*left.columns)


def covered_from(df: DataFrame, keys: list[str], value: str, spans: DataFrame, bucket: float | None = None) -> DataFrame:
    """The series of df over the whole of each span (keys, interval): clipped to it, and zero where the series has no row."""
    held = overlap_join(df.select(*keys, value, START, END), spans.select(*keys, START, END), ("r", "s"), [(k, k) for k in keys], bucket)
    held = held.select(START, END, *[F.col(f"r_{k}").alias(k) for k in keys], F.col(f"r_{value}").alias(value))
    known = spans.select(*keys, START, END, F.monotonically_increasing_id().alias("_span"))
    empty = interval_minus(known.withColumn(DURATION, F.col(END) - F.col(START)), held, keys, ["_span"], bucket)
    return with_duration(held.unionByName(empty.select(START, END, *keys, F.lit(0.0).alias(value))))


def between(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows that overlap [start, end), whole."""
    return df.filter((F.col(START) < end) & (F.col(END) > start))


def series_sum(parts: list[DataFrame], keys: list[str], value: str, bucket: float | None = None) -> DataFrame:
    """The sum of several series on their common change points; a series counts as zero where it has no row."""
    rows = reduce(DataFrame.unionByName, [p.select(START, END, *keys, value) for p in parts])
    return temporal_aggregate(rows, keys, {value: F.sum(value)}, bucket)
