import random

import pytest

from spanweave.operators import graphs as G


def intervals(seed, n=40):
    rnd = random.Random(seed)
    return [(g, f"{g}{i}", s, s + rnd.randrange(1, 12)) for g in "ab" for i in range(n) for s in [rnd.randrange(0, 60)]]


def plain_edges(rows):
    out = set()
    for g, b, s, _ in rows:
        before = [(a, a_s, a_e) for h, a, a_s, a_e in rows if h == g and a_e <= s]
        out |= {(g, a, b) for a, _, a_e in before if not any(a_e <= c_s for c, c_s, _ in before if c != a)}
    return out


@pytest.mark.parametrize("seed,width", [(1, None), (2, 7.0), (3, 1.0)])
def test_direct_predecessors(spark, seed, width):
    rows = intervals(seed)
    df = spark.createDataFrame([(g, n, float(s), float(e)) for g, n, s, e in rows], "group string, node string, start double, end double")
    got = [tuple(r) for r in G.direct_predecessors(df, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_edges(rows) and len(got) > 20
    assert G.direct_predecessors(df.limit(0), width=width).count() == 0


def plain_finish(nodes, edges):
    duration = {(g, n): d for g, n, d in nodes}
    before = {}
    for g, a, b in edges:
        before.setdefault((g, b), []).append((g, a))
    done = {}

    def finish(v):
        if v not in done:
            done[v] = duration[v] + max((finish(u) for u in before.get(v, [])), default=0.0)
        return done[v]

    return {v: finish(v) for v in duration}


def graph(seed, n=25):
    rnd = random.Random(seed)
    nodes = [(g, f"n{i}", float(rnd.randrange(0, 9))) for g in "ab" for i in range(n)]
    edges = sorted({(g, f"n{i}", f"n{j}") for g in "ab" for _ in range(40) for i, j in [sorted(rnd.sample(range(n), 2))]})
    return nodes, edges + [("b", f"n{i}", f"n{i + 1}") for i in range(n - 1)]


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "group string, node string, duration double"), spark.createDataFrame(edges, "group string, after string, node string")


def test_longest_paths(spark):
    nodes, edges = graph(4)
    got = {(r["group"], r["node"]): r["finish"] for r in G.longest_paths(*frames(spark, nodes, edges)).collect()}
    assert got == plain_finish(nodes, edges)
    alone = G.longest_paths(*frames(spark, nodes[:2], [])).collect()
    assert sorted(r["finish"] for r in alone) == sorted(n[2] for n in nodes[:2])
    with pytest.raises(ValueError):
        G.longest_paths(*frames(spark, nodes, [("a", "n0", "n1"), ("a", "n1", "n2"), ("a", "n2", "n0")]))


def test_circles(spark):
    _, edges = graph(5)
    chain = [("c", f"n{i}", f"n{i + 1}") for i in range(30)]
    ring = [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "z", "n3"), ("b", "s", "s")]
    df = frames(spark, [("a", "x", 1.0)], edges + chain + ring)[1]
    assert sorted(map(tuple, G.on_circles(df).collect())) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "s")]
    assert G.on_circles(df.filter("group = 'c'")).count() == 0


def test_interchangeable_siblings_and_impact(spark):
    # Two groups of workers between barriers: w1, w2 wait for s; w3, w4 for m.
    nodes = [("g", n, d, n[0]) for n, d in [("s", 1.0), ("w1", 2.0), ("w2", 8.0), ("m", 1.0), ("w3", 10.0), ("w4", 2.0), ("e", 1.0)]] + [("h", "w1", 4.0, "w")]
    edges = [("g", a, b) for a, b in [("s", "w1"), ("s", "w2"), ("w1", "m"), ("w2", "m"), ("m", "w3"), ("m", "w4"), ("w3", "e"), ("w4", "e")]]
    df = spark.createDataFrame(nodes, "group string, node string, duration double, type string")
    e = spark.createDataFrame(edges, "group string, after string, node string")
    classes = {}
    for r in G.sibling_classes(df, e).collect():
        classes.setdefault((r["group"], r["class"]), set()).add(r["node"])
    assert sorted(map(sorted, classes.values())) == [["e"], ["m"], ["s"], ["w1"], ["w1", "w2"], ["w3", "w4"]]
    assert [tuple(r) for r in G.imbalance_impact(df, e).collect()] == [("g", "w", 4, 21.0, 14.0, 7.0)]
    assert G.imbalance_impact(df.limit(0), e).collect() == []


def test_model_violations(spark):
    rows = [("/", 0.0, 9.0), ("/a", 0.0, 5.0), ("/a/x", 0.0, 1.0), ("/a/y", 2.0, 1.0), ("/b/x", 0.0, 1.0), ("/a/x", 0.0, 1.0), ("/c", 1.0, 2.0), ("/d", 1.0, 2.0)]
    edges = [("/a", "/c"), ("/c", "/d"), ("/d", "/a"), ("/a/x", "/c"), ("/a/x", "/a/q")]
    phases, df = (lambda r: spark.createDataFrame(r, "path string, start double, end double")), spark.createDataFrame(edges, "after string, path string")
    got = sorted(map(tuple, G.model_violations(phases(rows), df).collect()), key=repr)
    assert got == sorted([
        ("parent", "/b/x", "/b"), ("repeated", "/a/x", None), ("time", "/a/y", None), ("circle", "/a", None), ("circle", "/c", None), ("circle", "/d", None),
        ("parents", "/c", "/a/x"), ("unknown", "/a/q", "/a/x"),
    ], key=repr)
    several = G.model_violations(phases([("/a", 0.0, 1.0), ("/b", 0.0, 1.0), ("/b/c", 0.0, 1.0)]), df.limit(0)).collect()
    assert sorted(map(tuple, several)) == [("root", "/a", None), ("root", "/b", None)]
    assert [tuple(r) for r in G.model_violations(phases([("/a/b", 0.0, 1.0)]), df.limit(0)).collect()].count(("root", None, None)) == 1
    assert G.model_violations(phases(rows[:4]).filter("end >= start"), df.limit(0)).collect() == []


def test_impact_by_blocks_makes_no_pairs_of_nodes(spark):
    # Three blocks of 40 workers that wait for one another: 3,200 pairs of nodes, two edges between blocks.
    from .work import most_rows

    nodes = [("g", f"w{b}.{i}", float(1 + (i * 7 + b) % 9), "xy"[i % 2], f"b{b}") for b in range(3) for i in range(40)]
    df = spark.createDataFrame(nodes, "group string, node string, duration double, type string, block string")
    edges = spark.createDataFrame([("g", "b0", "b1"), ("g", "b1", "b2")], "group string, after string, node string")
    block = {n[1]: n[4] for n in nodes}
    pairs = spark.createDataFrame([("g", a, b) for a in block for b in block if int(block[a][1]) + 1 == int(block[b][1])], "group string, after string, node string")
    out = []
    assert most_rows(spark, lambda: out.extend(map(tuple, G.imbalance_impact(df, edges, "block", "block").collect()))) < 400
    plain = sorted((*r[:3], *[round(v, 9) for v in r[3:]]) for r in out)
    assert len(plain) == 2 and plain == sorted((*r[:3], *[round(v, 9) for v in r[3:]]) for r in map(tuple, G.imbalance_impact(df, pairs, "block").collect()))


@pytest.mark.parametrize("most", [-1, 50, 10_000])
def test_longest_paths_however_groups_are_solved(spark, monkeypatch, most):
    monkeypatch.setattr(G, "LARGE", most)
    nodes, edges = graph(6)
    nodes, edges = [*nodes, ("c", "n0", 2.0)], [*edges, ("a", "unknown", "n3")]
    got = {(r["group"], r["node"]): r["finish"] for r in G.longest_paths(*frames(spark, nodes, edges)).collect()}
    assert got == plain_finish(nodes, edges[:-1])
    with pytest.raises(ValueError):
        G.longest_paths(*frames(spark, [(g, n, 0.0) for g, n, _ in nodes], [("a", "n0", "n1"), ("a", "n1", "n0")]))
