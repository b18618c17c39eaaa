import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import attribution as A
from spanweave.operators import hierarchy as H

PHASES = ["/", "/j[id=1]", "/j[id=1]/s[id=1]", "/j[id=1]/s[id=1]/t[id=1]", "/j[id=1]/s[id=2]/t[id=1]", "/j[id=10]/s[id=1]"]
RESOURCES = ["/m[id=1]", "/m[id=1]:cpu", "/m[id=1]/d:io", "/m[id=10]:cpu", "/net:bytes"]


def frames(spark, mapping):
    return spark.createDataFrame([(p,) for p in PHASES], "phase string"), spark.createDataFrame(mapping, "phase string, resource string"), spark.createDataFrame([(r,) for r in RESOURCES], "resource string")


def test_nearest_mapped_ancestor_wins(spark):
    mapping = [("/j[id=1]", "/m[id=1]"), ("/j[id=1]/s[id=1]", "/m[id=1]/d"), ("/j[id=1]/s[id=1]", "/m[id=1]:cpu"), ("/j[id=1]/s[id=2]/t[id=1]", "/net:bytes")]
    phases, m, resources = frames(spark, mapping)
    got = {}
    for r in H.mapped_resources(phases, m, resources).collect():
        got.setdefault((r["phase"], r["mapped_at"]), set()).add(r["resource"])
    assert got == {
        ("/", "/"): set(RESOURCES), ("/j[id=10]/s[id=1]", "/"): set(RESOURCES), ("/j[id=1]", "/j[id=1]"): {"/m[id=1]", "/m[id=1]:cpu", "/m[id=1]/d:io"},
        ("/j[id=1]/s[id=1]", "/j[id=1]/s[id=1]"): {"/m[id=1]/d:io", "/m[id=1]:cpu"}, ("/j[id=1]/s[id=1]/t[id=1]", "/j[id=1]/s[id=1]"): {"/m[id=1]/d:io", "/m[id=1]:cpu"},
        ("/j[id=1]/s[id=2]/t[id=1]", "/j[id=1]/s[id=2]/t[id=1]"): {"/net:bytes"},
    }
    assert sorted(map(tuple, H.mapping_violations(m).collect())) == [("/j[id=1]/s[id=2]/t[id=1]", "/net:bytes", "/j[id=1]")]
    assert H.mapping_violations(m.limit(0)).collect() == [] and H.mapped_resources(phases, m.limit(0), resources).count() == len(PHASES) * len(RESOURCES)


def test_inherited_metadata(spark):
    nodes = spark.createDataFrame([(p,) for p in PHASES], "path string")
    metadata = spark.createDataFrame([("/", "host", "h0"), ("/j[id=1]", "host", "alias1"), ("/j[id=1]/s[id=1]", "rack", "r1"), ("/j[id=1]/s[id=1]/t[id=1]", "host", None), ("/j[id=1]", "other", "x")], "path string, name string, value string")
    aliases = spark.createDataFrame([("alias1", "h1"), ("h1", "h1")], "alias string, canonical string")
    got = {r["path"]: r["mapped"] for r in H.inherited(nodes, metadata, ["host", "rack"], aliases).collect()}
    assert got == {"/": ["h0", None], "/j[id=1]": ["h1", None], "/j[id=1]/s[id=1]": ["h1", "r1"], "/j[id=1]/s[id=1]/t[id=1]": ["h1", "r1"], "/j[id=1]/s[id=2]/t[id=1]": ["h1", None], "/j[id=10]/s[id=1]": ["h0", None]}


def test_pairs_that_metadata_allows(spark):
    values = [None, "a", "b"]
    both = [(x, y) for x in values for y in values]
    rows = [(0.0, 1.0, "g", list(v)) for v in both]
    metrics = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "_start_time double, _end_time double, on string, mapped array<string>, i int")
    met = A.meet(metrics, metrics, ["on"], None, "mapped").select("m_i", "p_i").collect()
    agree = lambda a, b: all(x is None or y is None or x == y for x, y in zip(a, b))
    assert sorted(map(tuple, met)) == [(i, j) for i in range(9) for j in range(9) if agree(both[i], both[j])]
    assert sorted(map(tuple, A.meet(metrics, metrics, ["on"], 0.5, "mapped").select("m_i", "p_i").collect())) == sorted(map(tuple, met))


def combined(rule, statuses):
    hits = [s for s in statuses if s != "NONE"]
    holds = {"any": bool(hits), "all": len(hits) == len(statuses), "majority": bool(hits) and 2 * len(hits) >= len(statuses)}[rule]
    return ("GLOBAL" if "GLOBAL" in hits else "LOCAL") if holds and hits else "NONE"


def plain_fold(leaves, default, rules):
    """Second by second, recursively."""
    last = max(e for _, e, _, _ in leaves)
    tree = {}
    for _, _, path, _ in leaves:
        parts = path.split("/")[1:]
        for k in range(len(parts), 0, -1):
            tree.setdefault("/" + "/".join(parts[: k - 1]), set()).add("/" + "/".join(parts[:k]))

    def status(path, t):
        own = [s for a, b, p, s in leaves if p == path and a <= t < b]
        if path not in tree:
            return own[0] if own else None
        kind = "".join(c.split("[")[0] for c in path.split("/")) and "/" + "/".join(c.split("[")[0] for c in path.split("/")[1:]) or "/"
        rule = rules.get(kind, default)
        children = [(c.split("/")[-1].split("[")[0], status(c, t)) for c in sorted(tree[path])]
        children = [c for c in children if c[1] is not None]
        if not children:
            return None
        if rule.outer is None:
            return combined(rule.inner, [s for _, s in children])
        types = {}
        for k, s in children:
            types.setdefault(k, []).append(s)
        return combined(rule.outer, [combined(rule.inner, ss) for ss in types.values()])

    out = {}
    for path in tree:
        for t in range(last):
            if (s := status(path, t)) is not None:
                out[path, t] = s
    return out


@pytest.mark.parametrize("case", range(6))
def test_fold_by_brute_force(spark, case):
    rnd = random.Random(case)
    leaves = []
    for a in range(2):
        for b in range(3):
            for c in range(3):
                t = rnd.randrange(4)
                for _ in range(3):
                    e = t + rnd.randrange(1, 5)
                    path = f"/a[id={a}]/{'bx'[b % 2]}[id={b}]" + ("" if b == 2 and c else f"/c[id={c}]") if not (b == 2 and c == 1) else f"/a[id={a}]/y"
                    if not (b == 2 and c == 2):
                        leaves.append((t, e, path, rnd.choice(["NONE", "NONE", "LOCAL", "GLOBAL"])))
                    t = e + rnd.randrange(2)
    default, rules = [(H.Predicate("majority"), {}), (H.Predicate("any"), {"/": H.Predicate("all")}), (H.Predicate("any", "all"), {"/a": H.Predicate("majority", "majority"), "/": H.Predicate("any")})][case % 3]
    df = spark.createDataFrame([(float(s), float(e), p, st, "cpu") for s, e, p, st in leaves], "_start_time double, _end_time double, path string, status string, metric string")
    got = H.fold_statuses(df, ["metric"], default, rules, bucket=[None, 3.0][case // 3])
    seconds = {}
    for r in got.collect():
        for t in range(int(r["_start_time"]), int(r["_end_time"])):
            assert (r["path"], t) not in seconds
            seconds[r["path"], t] = r["status"]
    assert seconds == plain_fold(leaves, default, rules)


def test_blocked_and_active_time(spark):
    schema = "_start_time double, _end_time double, _duration double, u int, path string"
    phases = spark.createDataFrame([(0.0, 10.0, 10.0, 1, "/a/x"), (5.0, 8.0, 3.0, 1, "/a/y"), (0.0, 4.0, 4.0, 2, "/b/x")], schema)
    blocking = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 3.0, 1), (6.0, 12.0, 1), (6.5, 7.0, 1)], "_start_time double, _end_time double, u int")
    times = lambda df: sorted((r["path"], r["_start_time"], r["_end_time"]) for r in df.collect())
    for bucket in (None, 2.5, 100.0):
        assert times(H.active_time(phases, blocking, ["u"], ["path"], bucket)) == [("/a/x", 0.0, 1.0), ("/a/x", 3.0, 6.0), ("/a/y", 5.0, 6.0), ("/b/x", 0.0, 4.0)]
        blocked = H.blocked_time(phases, blocking, ["u"], ["path"], bucket)
        assert times(blocked) == [("/a/x", 1.0, 3.0), ("/a/x", 6.0, 10.0), ("/a/y", 6.0, 8.0)]
        assert times(H.blocked_above(blocked, bucket)) == [("/", 1.0, 3.0), ("/", 6.0, 10.0), ("/a", 1.0, 3.0), ("/a", 6.0, 10.0)]
    assert H.blocked_above(blocked.filter("false"), 5.0).count() == 0
    assert H.fold_statuses(blocked.withColumn("status", F.lit("NONE")).filter("false"), [], H.Predicate("any")).count() == 0
