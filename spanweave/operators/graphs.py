"""Graphs of phases that wait for one another: dependencies, longest paths, interchangeable siblings, validation.

A graph falls into groups (column `group`: a job, a parent, a customer); edges never cross groups, and all joins
carry the group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.session import cut, stored
from .intervals import large_groups, parts, running


def direct_predecessors(rows: DataFrame, group: str = "group", node: str = "node", start: str = "start", end: str = "end", width: float | None = None) -> DataFrame:
    """group, after, node: a node waits for those that ended before it began, but for those that another such node waits for.

    Let a node's line be the latest start among the nodes of its group that ended before it began. What it waits for ended
    after that line, as whatever ended before it is waited for by the node that started then. Both ends of
    that range are places in the group's order of ends, so the edges come out of a join on places: work is as large as
    the result, where comparing all pairs (and all that lie between) would be cubic in a group. width splits large groups over
    tasks by time.
    """
    if width:
        is_large = large_groups(rows, [group])
        small, large = parts(is_large)
        found = [direct_predecessors(rows.filter(~is_large), group, node, start, end)] * small
        if not large:
            return found[0]
        rows = rows.filter(is_large)
        return reduce(DataFrame.unionByName, [*found, _predecessors(rows, group, node, start, end, width)])
    return _predecessors(rows, group, node, start, end, None)


def _predecessors(rows: DataFrame, group: str, node: str, start: str, end: str, width: float | None) -> DataFrame:
    bucket = F.floor(F.col("t") / width) if width else None
    # Nodes are part of the order, as places have to be the same each time.
    base = rows.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(start).alias("s"), F.col(end).alias("e"))
    # Ends come before starts of the same time: a node may begin as another one ends.
    marks = base.select("g", "n", F.explode(F.array(F.struct(F.col("e").alias("t"), F.lit(0).alias("kind"), F.col("s").alias("line")), F.struct(F.col("s").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(base.schema["s"].dataType).alias("line")))).alias("m")).select("g", "n", "m.*")
    seen = stored(running(marks.withColumn("one", 1 - F.col("kind")), ["g"], ["t", "kind", "n"], {"ended": "one"}, {"latest": "line"}, bucket))
    ends = seen.filter("kind = 0").select("g", "n", "t", F.col("ended").alias("place"))
    starts = seen.filter("kind = 1 and ended > 0").select("g", F.col("n").alias("node"), "latest", F.col("ended").alias("high"))
    # The places of the ends up to the line: one more walk over the group's times.
    asks = starts.select("g", F.col("latest").alias("t"), F.lit(1).alias("kind"), F.struct("node", "high").alias("ask"))
    known = ends.select("g", "t", F.lit(0).alias("kind"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"))
    ranged = running(known.unionByName(asks).withColumn("one", 1 - F.col("kind")), ["g"], ["t", "kind", "ask"], {"low": "one"}, bucket=bucket).filter("kind = 1 and low < ask.high")
    pairs = ranged.select("g", "ask.node", F.explode(F.sequence(F.col("low") + 1, F.col("ask.high"))).alias("place"))
    return pairs.join(ends.select("g", "place", F.col("n").alias("after")), ["g", "place"]).select(F.col("g").alias(group), "after", F.col("node").alias(node))


#: Groups of fewer edges, and of fewer nodes, are solved inside a task.
LARGE = 20_000


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """group, node, finish: the longest path that ends in a node, durations added up; when a node can finish at the earliest.

    nodes: group, node, duration, a row for each node; edges: group, after, node. Small groups are solved inside a task, many at a
    time in the order of their edges; large ones by doubling. A circle raises an error.
    """
    is_large = large_groups(nodes.select("group").unionAll(edges.select("group")), ["group"], LARGE)
    small, large = parts(is_large)
    found = [_solved_in_tasks(nodes.filter(~is_large), edges.filter(~is_large))] * small
    found += [_solved_by_doubling(nodes.filter(is_large), edges.filter(is_large))] * large
    return reduce(DataFrame.unionByName, found)


def finishes(sizes: np.ndarray, names: np.ndarray, lengths: np.ndarray, arcs: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """When nodes finish in many graphs, sizes[i] nodes and arcs[i] edges of graph i end to end; NaN on circles and behind them. A step deals with all nodes that wait for no other."""
    codes, known = pd.factorize(np.concatenate([names, after, before]))
    own = np.repeat(np.arange(len(sizes)), sizes) * len(known) + codes[: len(names)]
    of, order = np.repeat(np.arange(len(arcs)), arcs) * len(known), np.argsort(own, kind="stable")
    asked = [of + codes[len(names) :][: len(after)], of + codes[len(names) + len(after) :]]
    places = [np.minimum(np.searchsorted(own[order], x), max(len(own) - 1, 0)) for x in asked]
    has = np.ones(len(after), dtype=bool) if len(own) else np.zeros(len(after), dtype=bool)
    for x, at in zip(asked, places):
        has[has] = own[order][at[has]] == x[has]
    a, b = (order[at[has]] for at in places)
    ready, out, waits = np.zeros(len(names)), np.full(len(names), np.nan), np.bincount(b, minlength=len(names))
    free = waits == 0
    while free.any():
        out[free] = ready[free] + lengths[free]
        now = free[a]
        np.maximum.at(ready, b[now], out[a[now]])
        waits = waits - np.bincount(b[now], minlength=len(names))
        a, b = a[~now], b[~now]
        free = (waits == 0) & np.isnan(out)
    return out


def _solved_in_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def solve(names: pd.Series, lengths: pd.Series, after: pd.Series, before: pd.Series) -> pd.Series:
        sizes, arcs = (x.str.len().to_numpy(dtype=np.int64) for x in (names, after))
        flat = lambda x, kind: np.concatenate([np.zeros(0, dtype=kind), *x])
        found = finishes(sizes, flat(names, object), flat(lengths, float), arcs, flat(after, object), flat(before, object))
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [], index=names.index)

    held = nodes.groupBy("group").agg(F.collect_list(F.struct("node", "duration")).alias("own"))
    arcs = edges.groupBy("group").agg(F.collect_list(F.struct("after", "node")).alias("arcs"))
    each = lambda rows, name: F.coalesce(F.transform(rows, lambda x: x[name].cast("string") if name != "duration" else x[name].cast("double")), F.array().cast("array<string>" if name != "duration" else "array<double>"))
    solved = held.join(arcs, "group", "left").withColumn("finish", solve(each("own", "node"), each("own", "duration"), each("arcs", "after"), each("arcs", "node")))
    solved = stored(solved.select("group", F.explode(F.arrays_zip("own", "finish")).alias("z")).select("group", "z.own.node", "z.finish"))
    if not solved.filter("finish is null or isnan(finish)").isEmpty():
        raise ValueError("the phases wait for one another in a circle")
    return solved


def _solved_by_doubling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Doubling in max-plus algebra: after round k the table holds the longest way of each pair of nodes that a path of up to 2**k
    edges connects, so a chain of n nodes takes log2(n) rounds. The table has a row per connected pair of a group, and each
    round is one join and one aggregate.
    """
    length = nodes.select("group", F.col("node").alias("a"), "duration")
    ways = edges.select("group", F.col("after").alias("a"), F.col("node").alias("b")).distinct().join(length, ["group", "a"]).select("group", "a", "b", F.col("duration").alias("length"))
    ways = stored(ways)
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum("length"), F.count_if(F.col("a") == F.col("b"))).first())
    before = size(ways)
    while True:
        if before[2]:
            raise ValueError("the phases wait for one another in a circle")
        left, right = ways.withColumnRenamed("b", "mid"), ways.select("group", F.col("a").alias("mid"), "b", F.col("length").alias("more"))
        joined = left.join(right, ["group", "mid"]).select("group", "a", "b", (F.col("length") + F.col("more")).alias("length"))
        ways = stored(ways.unionByName(joined).groupBy("group", "a", "b").agg(F.max("length").alias("length")))
        now = size(ways)
        if now == before:
            break
        before = now
    ready = ways.groupBy("group", F.col("b").alias("node")).agg(F.max("length").alias("ready"))
    return nodes.join(ready, ["group", "node"], "left").select("group", "node", (F.coalesce("ready", F.lit(0.0)) + F.col("duration")).alias("finish"))


def sibling_classes(nodes: DataFrame, edges: DataFrame, parent: str = "group") -> DataFrame:
    """nodes (group, node, type, parent, ...) with class: siblings of one type that wait for the same nodes and that the same nodes wait for are interchangeable.

    Sets of neighbours are compared by count and two sums of 64-bit hashes, which need no list and no order.
    """

    def signature(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        hashed = [F.sum(F.xxhash64(F.lit(seed), other).cast("decimal(20,0)")) for seed in (1, 2)]
        return df.groupBy("group", F.col(own).alias("node")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[h.cast("string") for h in hashed]).alias(name))

    pairs = edges.select("group", "after", "node").distinct()
    tied = nodes.join(signature(pairs, "node", "after", "_in"), ["group", "node"], "left").join(signature(pairs, "after", "node", "_out"), ["group", "node"], "left")
    return tied.withColumn("class", F.concat_ws("|", F.col(parent).cast("string"), "type", F.coalesce("_in", F.lit("0")), F.coalesce("_out", F.lit("0")))).drop("_in", "_out")


def imbalance_impact(nodes: DataFrame, edges: DataFrame, parent: str = "group", block: str | None = None) -> DataFrame:
    """group, type, n, measured, balanced, impact for each type with interchangeable siblings in a group: the group's length when
    its nodes take as long as measured, when those of the type take the mean of their class, and what that saves.

    A length is the group's longest path. The means stay inside a class, so inside one parent. The cases of a group are told
    apart by a case number in the group, so that all are solved by the same rounds of doubling.

    block: a column of nodes that edges connect (group, after, node) in place of nodes: all nodes of a block wait for all of
    those it waits for. Pairs of nodes are not made then, and a block takes as long as its longest node.
    """
    block = block or "node"
    held = nodes.select("group", F.col(block).alias("_block"), "type", "duration", F.col(parent).alias("_parent"))
    held = held.groupBy("group", F.col("_block").alias("node"), "type", "_parent").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"), F.max("duration").alias("most"))
    held = stored(sibling_classes(held, edges, "_parent").drop("_parent"))
    classes = held.groupBy("group", "type", "class").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    cases = stored(classes.filter("n > 1").groupBy("group", "type").agg(F.sum("n").alias("n")).withColumnRenamed("type", "case"))
    every = cases.select("group", "case").unionByName(cases.select("group", F.lit(None).cast("string").alias("case")).distinct())
    means = classes.select("group", "class", "mean")
    rows = held.join(means, ["group", "class"]).join(every, "group")
    duration = F.when(F.col("type") == F.col("case"), F.col("mean")).otherwise(F.col("most"))
    named = F.struct("group", "case")
    rows = rows.groupBy(named.alias("group"), "node").agg(F.max(duration).alias("duration"))
    solved = longest_paths(stored(rows), edges.join(every, "group").select(named.alias("group"), "after", "node"))
    spans = solved.groupBy("group").agg(F.max("finish").alias("length")).select("group.*", "length")
    measured = spans.filter(F.col("case").isNull()).select("group", F.col("length").alias("measured"))
    balanced = spans.filter(F.col("case").isNotNull()).select("group", "case", F.col("length").alias("balanced"))
    return cases.join(balanced, ["group", "case"]).join(measured, "group").select("group", F.col("case").alias("type"), "n", "measured", "balanced", (F.col("measured") - F.col("balanced")).alias("impact"))


def on_circles(edges: DataFrame) -> DataFrame:
    """group, node: the nodes that wait for themselves through others.

    Nodes that nothing waits for, or that wait for nothing, cannot be on a circle: they are peeled off a few times, so that
    doubling is left with what lies between circles.
    """
    left = cut(edges.select("group", F.col("after").alias("a"), F.col("node").alias("b")).distinct())
    n = left.count()
    for _ in range(8):
        inner = left.join(left.select("group", F.col("b").alias("a")).distinct(), ["group", "a"], "left_semi")
        inner = cut(inner.join(left.select("group", F.col("a").alias("b")).distinct(), ["group", "b"], "left_semi").select("group", "a", "b"))
        m = inner.count()
        left, stopped, n = inner, m == n, m
        if stopped or not m:
            break
    reach = left
    while n:
        more = reach.withColumnRenamed("b", "mid").join(reach.select("group", F.col("a").alias("mid"), "b"), ["group", "mid"]).select("group", "a", "b")
        reach = cut(reach.union(more).distinct())
        m = reach.count()
        if m == n:
            break
        n = m
    return reach.filter("a = b").select("group", F.col("a").alias("node")).distinct()


def model_violations(phases: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, path, other: what keeps the records of phases (path, start, end) and edges (after, path) from being one model.

    root: there are several roots, or (path null) none; parent: a phase's parent has no record; repeated: a path has several
    records; time: a phase ends before it starts; unknown: an edge names a phase without a record; parents: an edge between phases
    of different parents; circle: a phase that waits for itself. A root is a path of one component or `/` itself.
    """
    parent = F.element_at(P.ancestors_of(F.col("path")), -1)
    counts = phases.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("end") < F.col("start")).alias("back"))
    known = cut(counts.withColumn("parent", F.when(F.col("path") == "/", None).otherwise(parent)))
    row = lambda rule, path, other: [F.lit(rule).alias("rule"), path.alias("path"), other.alias("other")]
    none = F.lit(None).cast("string")
    rooted = not known.filter("path = '/'").isEmpty()
    roots = known.filter(F.col("parent").isNull() if rooted else F.col("parent").isNull() | (F.col("parent") == "/"))
    n_roots = roots.count()
    several = roots.filter(F.lit(n_roots > 1)).select(*row("root", F.col("path"), none))
    nothing = phases.sparkSession.range(int(n_roots == 0)).select(*row("root", none, none))
    names = known.select(F.col("path").alias("parent"))
    missing = known.join(roots.select("path"), "path", "left_anti").join(names, "parent", "left_anti").select(*row("parent", F.col("path"), F.col("parent")))
    repeated = known.filter("n > 1").select(*row("repeated", F.col("path"), none))
    back = known.filter("back > 0").select(*row("time", F.col("path"), none))
    pairs = cut(edges.select("after", "path").distinct())
    ends = pairs.select(F.explode(F.array(F.struct(F.col("after").alias("path"), F.col("path").alias("other")), F.struct("path", F.col("after").alias("other")))).alias("x")).select("x.*")
    unknown = ends.join(known.select("path"), "path", "left_anti").select(*row("unknown", F.col("path"), F.col("other")))
    up = lambda c: F.element_at(P.ancestors_of(F.col(c)), -1)
    apart = pairs.filter(~up("after").eqNullSafe(up("path"))).select(*row("parents", F.col("path"), F.col("after")))
    circle = on_circles(pairs.filter(up("after").eqNullSafe(up("path"))).select(F.coalesce(up("path"), F.lit("")).alias("group"), "after", F.col("path").alias("node"))).select(*row("circle", F.col("node"), none))
    out = several
    for more in (nothing, missing, repeated, back, unknown, apart, circle):
        out = out.unionByName(more)
    return out.distinct()
