"""Repeated runs of lines against brute force over all substrings of lines."""

import random
from collections import defaultdict

from spanweave.llm import lines


def texts(seed, n=40):
    rnd = random.Random(seed)
    block = [rnd.choice("abcdefghij") for _ in range(30)]
    made = [[rnd.choice("abc") for _ in range(rnd.randrange(0, 25))] for _ in range(n // 2)]
    made += [block[rnd.randrange(0, 10) : rnd.randrange(12, 31)] + [rnd.choice("xyz") for _ in range(rnd.randrange(3))] for _ in range(n // 2)]
    return made + [["r"] * 50, ["r"] * 20, block, block]


def occurrences(docs, length):
    found = defaultdict(list)
    for i, doc in docs.items():
        for at in range(len(doc) - length + 1):
            found[tuple(doc[at : at + length])].append((i, at))
    return {k: v for k, v in found.items() if len(v) > 1}


def all_maximal(docs, least):
    """(first, length, copies) of every repeat that no line before or after extends in all its copies."""
    out, length = set(), least
    while found := occurrences(docs, length):
        for at in found.values():
            left = {docs[i][p - 1] if p else (i, p) for i, p in at}
            right = {docs[i][p + length] if p + length < len(docs[i]) else (i, p) for i, p in at}
            if len(left) > 1 and len(right) > 1:
                out.add((*min(at), length, len(at)))
        length += 1
    return out


def test_intervals_by_brute_force(spark):
    for seed, least in ((1, 3), (2, 5)):
        docs = {i: t for i, t in enumerate(texts(seed))}
        df = spark.createDataFrame([(i, "\n".join(t)) for i, t in docs.items()], "doc_id long, text string").repartition(5)
        got = {tuple(r) for r in lines.maximal_runs(df, least).collect()}
        every = all_maximal(docs, least)
        assert got <= every
        # listed: those that are the whole common prefix of the suffixes that share their first least, 2 * least ... lines
        listed = {r for r in every if any(len(occurrences(docs, h)[tuple(docs[r[0]][r[1] : r[1] + h])]) == r[3] for h in (least << k for k in range(6)) if h <= r[2] < 2 * h)}
        assert got == listed and max(r[2] for r in got) >= 19


def test_removed_lines_by_brute_force(spark):
    for seed, least in ((3, 3), (4, 4)):
        docs = {i: t for i, t in enumerate(texts(seed))}
        df = spark.createDataFrame([(i, "\n".join(t)) for i, t in docs.items()], "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.dedup_lines(df, least).collect()}
        gone, length = defaultdict(set), least
        while found := occurrences(docs, length):
            for at in found.values():
                for i, p in sorted(at)[1:]:
                    gone[i] |= set(range(p, p + length))
            length += 1
        assert got == {i: (len(gone[i]), "\n".join(x for k, x in enumerate(t) if k not in gone[i])) for i, t in docs.items()}
