"""Connected components of a graph by label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Links that a task joins at once before the rounds begin.
LINKS_PER_TASK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a[i], b[i]) and the smallest node that each reaches in them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: tasks of bounded size each leave one link per node."""

    def thin(batches):
        held, size = [], 0
        for pdf in batches:
            held, size = [*held, pdf], size + len(pdf)
            if size >= LINKS_PER_TASK:
                yield leave(pd.concat(held))
                held, size = [], 0
        if size:
            yield leave(pd.concat(held))

    def leave(pdf):
        nodes, roots = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})

    links = cut(links)
    return links.repartition(-(-max(1, links.count()) // LINKS_PER_TASK)).mapInPandas(thin, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for each node that links (a, b: long) names.

    Links are thinned out first, so that a dense group of n nodes goes into the rounds with some n links.
    Every round takes the smallest label among a node and its neighbours, then the label of that
    label. Sums are made before the shuffle, so a node with very many links is no hot key, and each
    round is cut off in the shared folder.
    """
    pairs = thinned(links.filter("a <> b").select("a", "b"))
    pairs = cut(pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b"))
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = pairs.join(labels, pairs["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        joined = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(joined.join(jump, joined["next"] == jump["via"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
