"""Suffix arrays of integer sequences in numpy, by prefix doubling."""

from __future__ import annotations

import numpy as np


def equal_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array the index at which its run of equal entries begins."""
    new = np.empty(len(sorted_keys), dtype=bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def suffix_array(symbols: np.ndarray, ends: np.ndarray, most: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sort the suffixes of several sequences that lie end to end.

    symbols: non-negative; ends: for each position the end of its sequence; a suffix stops there.
    Returns the suffix array and, per doubling step k, the rank of each position by its first 2**k
    symbols (equal ranks: equal symbols, none of them past an end). With most, sorting stops when
    prefixes of that length are told apart.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    runs = equal_runs(symbols[order])
    rank[order] = runs
    levels, h = [rank.copy()], 1
    slots = _tied(runs)
    while len(slots) and (most is None or h < most):
        at = order[slots]
        then = at + h
        inside = then < ends[at]
        second = np.zeros(len(at), dtype=np.int64)
        second[inside] = rank[then[inside]].astype(np.int64) + 1
        # a suffix that ends within the next h symbols is unlike any other: its own position tells it apart
        short = ~inside
        key = rank[at].astype(np.int64) * (2 * n + 2) + np.where(short, np.cumsum(short), second + n)
        resort = np.argsort(key, kind="stable")
        at, runs = at[resort], equal_runs(key[resort])
        order[slots] = at
        rank[at] = slots[runs]
        levels.append(rank.copy())
        slots = slots[_tied(runs)]
        h *= 2
    return order, levels


def _tied(runs: np.ndarray) -> np.ndarray:
    first = runs == np.arange(len(runs))
    alone = first.copy()
    alone[:-1] &= first[1:]
    return np.flatnonzero(~alone)


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, at_least: int = 1) -> np.ndarray:
    """lcp[i]: symbols shared by order[i-1] and order[i] if at_least of them are, else 0; lcp[0] and lcp[n] are 0."""
    n = len(order)
    lcp = np.zeros(n + 1, dtype=np.int64)
    floor = min(at_least.bit_length() - 1, len(levels) - 1)
    pairs = np.flatnonzero(levels[floor][order[:-1]] == levels[floor][order[1:]])
    a, b = order[:-1][pairs].astype(np.int64), order[1:][pairs].astype(np.int64)
    end_a, end_b, shared = ends[a], ends[b], np.zeros(len(pairs), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < end_a) & (b < end_b))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        for x in (shared, a, b):
            x[same] += 1 << k
    lcp[pairs + 1] = np.where(shared >= at_least, shared, 0)
    return lcp


def nearest_smaller(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each i the least of lcp[j + 1 : i + 1] for the nearest j < i with values[j] < values[i]; 0 where there is none.

    All entries between i and where it points are larger than values[i], so it may go on to where that one points.
    """
    to, low = np.arange(len(values)) - 1, lcp.copy()
    while True:
        up = np.flatnonzero((to >= 0) & (low > 0))
        up = up[values[to[up]] >= values[up]]
        if not len(up):
            return np.where(to >= 0, low, 0)
        via = to[up]
        low[up] = np.minimum(low[up], low[via])
        to[up] = to[via]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions some span starts[i] : starts[i] + lengths[i] covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
