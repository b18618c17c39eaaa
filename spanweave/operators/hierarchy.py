"""Operators on trees of phases and resources, whose paths name their ancestors.

Nothing here walks a tree node by node: a path holds its ancestors, so inheritance is a join on exploded prefixes
followed by an aggregate, and what goes up level by level takes as many rounds as the tree is deep.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.patterns import compile_pattern, metric_regex
from ..functions.session import stored
from .bottlenecks import GLOBAL, LOCAL, NONE
from .intervals import DURATION, END, START, coalesce_intervals, covered_time, interval_minus, overlap_join, temporal_state, with_duration


def lineage(path: Column) -> Column:
    """The ancestors of a path, the root first, and the path itself."""
    return F.concat(P.ancestors_of(path), F.array(path))


def _above(rows: DataFrame, path: str) -> DataFrame:
    """rows once for each path of their lineage: _up, and _depth, which grows towards the row's own path."""
    return rows.select("*", F.posexplode(lineage(F.col(path))).alias("_depth", "_up"))


# Phases and resources


def nearest_mapped(phases: DataFrame, mapping: DataFrame) -> DataFrame:
    """phase, mapped_at: the nearest of a phase and its ancestors with an entry in mapping (phase, resource); null without any.

    phases needs a column `phase`. Only prefixes and names of entries are moved.
    """
    entries = mapping.select(F.col("phase").alias("_up")).distinct()
    up = _above(phases.select("phase").distinct(), "phase")
    return up.join(entries.withColumn("_entry", F.col("_up")), "_up", "left").groupBy("phase").agg(F.max_by("_entry", F.when(F.col("_entry").isNotNull(), F.col("_depth"))).alias("mapped_at"))


def within(path: Column, root: Column) -> Column:
    """path is root or lies below it."""
    return (path == root) | P.is_descendant_of(path, root)


def mapped_resources(phases: DataFrame, mapping: DataFrame, resources: DataFrame) -> DataFrame:
    """phase, mapped_at, resource: the paths of resources (column resource, metrics too) that a phase may use.

    These lie at or below a resource of the phase's nearest entry. Without an entry a phase may use all of them, as if the
    root had one for `/`. Resources meet entries by their own prefixes, so no phase meets a resource that it may not use.
    """
    nearest = nearest_mapped(phases, mapping).withColumn("mapped_at", F.coalesce("mapped_at", F.lit("/")))
    everywhere = mapping.sparkSession.createDataFrame([("/", "/")], "phase string, resource string")
    own = mapping.select("phase", "resource")
    entries = own.unionByName(everywhere.join(own.filter("phase = '/'"), "phase", "left_anti")).distinct()
    below = _above(resources.select("resource").distinct(), "resource").select("_up", F.col("resource").alias("found"))
    usable = entries.join(below, F.col("resource") == F.col("_up")).select(F.col("phase").alias("mapped_at"), F.col("found").alias("resource")).distinct()
    return nearest.join(usable, "mapped_at").select("phase", "mapped_at", "resource")


def mapping_violations(mapping: DataFrame) -> DataFrame:
    """phase, resource, parent: entries whose resource is not inside what the nearest entry above the phase maps."""
    own = mapping.select("phase", "resource").distinct()
    up = _above(own.select("phase").distinct(), "phase").filter(F.col("_up") != F.col("phase"))
    known = own.select(F.col("phase").alias("_up")).distinct()
    parents = up.join(known, "_up").groupBy("phase").agg(F.max_by("_up", "_depth").alias("parent"))
    asked = own.join(parents, "phase")
    held = own.select(F.col("phase").alias("parent"), F.col("resource").alias("_up"))
    inside = _above(asked, "resource").join(held, ["parent", "_up"], "left_semi").select("phase", "resource").distinct()
    return asked.join(inside, ["phase", "resource"], "left_anti").select("phase", "resource", "parent")


# Metadata


def inherited(nodes: DataFrame, metadata: DataFrame, names: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """path, mapped: for each of names the value that is nearest in the node's lineage, null without one; an array in the order of names.

    nodes: path; metadata: path, name, value. aliases (alias, canonical) turn values into the name that both sides use.
    """
    values = metadata.filter(F.col("name").isin(*names)).select(F.col("path").alias("_up"), "name", "value")
    if aliases is not None:
        named = aliases.select(F.col("alias").alias("value"), "canonical")
        values = values.join(named, "value", "left").withColumn("value", F.coalesce("canonical", "value")).drop("canonical")
    columns = [f"_{k}" for k in range(len(names))]
    own = values.groupBy("_up").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for c, n in zip(columns, names)])
    nodes = nodes.select("path").distinct().withColumn("_parent", P.nearest_above(F.col("path")))
    # Parents are few beside nodes, so only their lineages are walked.
    up = _above(nodes.select(F.col("_parent").alias("path")).filter("path is not null").distinct(), "path").join(own, "_up")
    above = up.groupBy(F.col("path").alias("_parent")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_depth"))).alias(f"{c}_up") for c in columns])
    found = nodes.join(own.withColumnRenamed("_up", "path"), "path", "left").join(above, "_parent", "left")
    return found.select("path", F.array(*[F.coalesce(c, f"{c}_up") for c in columns]).alias("mapped"))


# Folds from the leaves up


@dataclass(frozen=True)
class Predicate:
    """How a parent's status follows from its children's: `inner` over all children, or over the children of each type and then `outer` over the types.

    any: one is a bottleneck; all: each is; majority: at least half of them are. The result is GLOBAL if one that counts is
    GLOBAL, else LOCAL.
    """

    inner: str
    outer: str | None = None


def _combined(rule: str, n: Column, hits: Column, high: Column) -> Column:
    """The severity of n members of which hits are bottlenecks and high are GLOBAL ones."""
    holds = {"any": hits > 0, "all": hits == n, "majority": (hits > 0) & (2 * hits >= n)}[rule]
    return F.when(holds, F.when(high > 0, 2).otherwise(1)).otherwise(0)


def _by_rule(rules: dict, default, choose: Column, value) -> Column:
    """value(rule) for the rule that choose (a parent's type) names; choose is computed once."""
    if not rules:
        return value(default)
    place = F.create_map(*[F.lit(x) for pair in zip(rules, range(len(rules))) for x in pair])[choose]
    return F.get(F.array(*[value(rule) for rule in (*rules.values(), default)]), F.coalesce(place, F.lit(len(rules))))


_SEVERITY = {NONE: 0, LOCAL: 1, GLOBAL: 2}


def type_of(path: Column) -> Column:
    """A path without the tags of its components."""
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def fold_statuses(leaves: DataFrame, keys: list[str], default: Predicate, rules: dict[str, Predicate] | None = None, bucket: float | None = None, parent_type=type_of) -> DataFrame:
    """path, keys, status and interval of every ancestor of the leaves (path, keys, status, interval), merged where they agree.

    The tree is folded bottom up, one round for each of its depths: a parent's status in a slice comes from the statuses
    that its children have in it, leaves and folded ones alike, by the predicate for the parent's type. Where no child
    is active there is no row. Children are counted through the changes at their ends, so work grows with their number. The
    leaves are computed once and kept without their own paths; each level is kept, as the next one and the result read it.
    """
    rules = rules or {}
    by_type = any(r.outer is not None for r in (default, *rules.values()))
    severity = F.coalesce(F.create_map(*[F.lit(x) for pair in _SEVERITY.items() for x in pair])[F.col("status")], F.lit(0))
    names = F.array(*[F.lit(s) for s in _SEVERITY])
    kind = parent_type(F.col("path"))
    n, hits, high = F.col("_n"), F.col("_hits"), F.col("_high")
    flat = lambda r: _combined(r.inner, n, hits, high)

    def children(rows: DataFrame) -> DataFrame:
        """rows under their parents' paths. A leaf's own path is not needed any more."""
        own = {"path": P.nearest_above(F.col("path")), "_type": type_of(F.col("path")), "_sev": severity.cast("byte")}
        return rows.filter(F.col(START) < F.col(END)).withColumns(own).select("path", *keys, *(["_type"] if by_type else []), "_sev", START, END)

    def folded(rows: DataFrame) -> DataFrame:
        """path, keys, interval and severity of the parents of children."""
        counted = rows.withColumns({"_n": F.lit(1), "_hits": (F.col("_sev") > 0).cast("int"), "_high": (F.col("_sev") > 1).cast("int")})
        if not by_type:
            return temporal_state(counted, ["path", *keys], ["_n", "_hits", "_high"], _by_rule(rules, default, kind, flat), bucket)
        # Over all children the types' counts add up; by type each type is one member.
        cells = temporal_state(counted, ["path", "_type", *keys], ["_n", "_hits", "_high"], F.struct("_n", "_hits", "_high", _by_rule(rules, default, kind, flat).alias("_tsev")), bucket)
        cells = stored(cells.select("path", *keys, START, END, F.lit(1).alias("_tn"), "state._n", "state._hits", "state._high", (F.col("state._tsev") > 0).cast("int").alias("_thits"), (F.col("state._tsev") > 1).cast("int").alias("_thigh")))
        rule = _by_rule(rules, default, kind, lambda r: flat(r) if r.outer is None else _combined(r.outer, F.col("_tn"), F.col("_thits"), F.col("_thigh")))
        return temporal_state(cells, ["path", *keys], ["_tn", "_n", "_hits", "_high", "_thits", "_thigh"], rule, bucket)

    depth = P.depth_of(F.col("path"))
    rows = stored(children(leaves.filter(depth > 0)).withColumn("_depth", depth))
    depths = {r["_depth"] for r in rows.select("_depth").distinct().collect()}  # as many as the tree is deep
    levels, below = [], None
    for level in range(max(depths, default=-1), -1, -1):
        here = [rows.filter(F.col("_depth") == level).drop("_depth")] if level in depths else []
        below = stored(folded(reduce(DataFrame.unionByName, here + ([] if below is None else [children(below)]))).withColumn("status", F.get(names, F.col("state"))).drop("state"))
        levels.append(below)
    if not levels:
        return coalesce_intervals(leaves.limit(0), ["path", *keys], ["status"])
    out = with_duration(reduce(DataFrame.unionByName, levels))
    return out.select(START, END, DURATION, "path", *keys, "status")


# Blocked time


def active_time(phases: DataFrame, blocking: DataFrame, on: list[str], row: list[str], bucket: float | None = None) -> DataFrame:
    """The pieces of phases in which nothing blocks them: what the intervals of blocking (on, interval) leave of each row."""
    return interval_minus(phases, blocking, on, row, bucket)


def blocked_time(phases: DataFrame, blocking: DataFrame, on: list[str], keep: list[str], bucket: float | None = None) -> DataFrame:
    """The pieces of phases (columns keep, interval) that lie in the union of the blocking intervals."""
    met = overlap_join(phases.select(*on, *[c for c in keep if c not in on], START, END), covered_time(blocking, on, bucket), ("p", "b"), [(c, c) for c in on], bucket)
    return met.select(START, END, "_duration", *[F.col(f"p_{c}").alias(c) for c in keep])


def blocked_above(blocked: DataFrame, bucket: float | None = None) -> DataFrame:
    """path and interval of every ancestor's blocked time: a composite is blocked while one of its leaves (path, interval) is."""
    blocked = stored(blocked.select(START, END, "path"))
    up = blocked.select(START, END, F.explode(P.ancestors_of(F.col("path"))).alias("path"), F.lit(1).alias("_n"))
    return with_duration(temporal_state(up, ["path"], ["_n"], F.lit(1), bucket)).select(START, END, DURATION, "path")


# Nodes by pattern


def find(nodes: DataFrame, pattern: str, start: DataFrame | None = None) -> DataFrame:
    """path of the nodes (column path, all of a tree but perhaps its root `/`) that a path pattern finds, from the nodes of start (column path; the root if there is none).

    Steps down from the root are one regular expression, evaluated where the nodes are read. After `..` or from given nodes the
    steps down join on the prefix of as many components as are left, or on all prefixes where `**` leaves their number open.
    """
    absolute, steps = compile_pattern(pattern)
    every = nodes.select("path").filter("path <> '/'")
    at = None if absolute or start is None else start.select("path").distinct()  # None: the root
    root = nodes.sparkSession.createDataFrame([("/",)], "path string")
    for step in steps:
        for _ in range(step.up):
            at = (root.limit(0) if at is None else at.filter("path <> '/'").select(F.element_at(P.ancestors_of(F.col("path")), -1).alias("path"))).distinct()
        if step.regex is None:
            continue
        if at is None:
            at = every.filter(F.col("path").rlike(rf"\A{step.regex}\z")).distinct()
            continue
        up = P.ancestors_of(F.col("path"))
        ends = every.withColumn("_up", F.explode(up)) if step.depth is None else every.withColumn("_up", F.get(up, F.size(up) - step.depth))
        below = ends.withColumn("_rest", F.expr("if(_up = '/', path, substring(path, length(_up) + 1))"))
        at = below.filter(F.col("_rest").rlike(rf"\A{step.regex}\z")).join(at.withColumnRenamed("path", "_up"), "_up", "left_semi").select("path").distinct()
    return root if at is None else at


def find_metrics(metrics: DataFrame, pattern: str, resources: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """resource, metric of the metrics (columns resource, metric) that `resource pattern:name` finds, `*` in the name standing for any characters."""
    place, _, name = pattern.rpartition(":")
    found = find(resources, place, start).withColumnRenamed("path", "resource")
    return metrics.select("resource", "metric").distinct().filter(F.col("metric").rlike(metric_regex(name))).join(found, "resource", "left_semi")
