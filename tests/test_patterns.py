import pytest
from pyspark.sql import functions as F

from spanweave.functions import paths as P
from spanweave.functions.patterns import InvalidPattern, compile_pattern
from spanweave.operators import hierarchy as H

NODES = ["/", "/a[id=1]", "/a[id=1]/b", "/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]", "/a[id=2]", "/a[id=2]/bb", "/a[id=2]/bb/c[x=1, y=1]", "/z", "/z/b", "/z/b/d"]


def plain_canonical(path):
    """By a stack."""
    out = []
    for c in filter(None, path.split("/")):
        if c == "..":
            if out and out[-1] != "..":
                out.pop()
            elif path.startswith("/"):
                return None
            else:
                out.append(c)
        elif c != ".":
            out.append(c)
    return ("/" if path.startswith("/") else "") + "/".join(out)


PATHS = ["/", "", "a", "/a/b", "//a///b/", "a/./b", "/a/../b", "/a/b/../../c", "../a", "../../a/..", "a/../../b", "/..", "/a/../../b", ".", "..", "./..", "/a/./../b/.", "a/b/../../..", "/a[x=1]/../b:m", "/a/../../a"]


def test_canonical_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r["path"]: r["c"] for r in rows.select("path", P.canonical(F.col("path")).alias("c")).collect()}
    assert got == {p: plain_canonical(p) for p in PATHS}


def test_resolve_contains_and_order(spark):
    pairs = [("/a", "b"), ("/a", "/b"), ("a", "b/c"), ("/", "x"), ("/a/", "../b"), ("/a", "/a/b"), ("/a/./b", "/a/b/c"), ("/ab", "/abc"), ("a", "/a"), ("..", "../x"), ("/a", "/a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.resolve(F.col("a"), F.col("b")).alias("r"), P.contains(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["r"] for r in rows] == ["/a/b", "/b", "a/b/c", "/x", "/a/../b", "/a/b", "/a/b/c", "/abc", "/a", "../../x", "/a"]
    assert [r["c"] for r in rows] == [False, False, False, False, False, True, True, False, False, True, True]
    order = spark.createDataFrame([(p,) for p in ("b", "/b", "/a/b", "/a", "a", "/")], "p string").orderBy(P.order_key(F.col("p")))
    assert [r["p"] for r in order.collect()] == ["/", "/a", "/a/b", "/b", "a", "b"]


FOUND = {
    "/": ["/"], "/a": ["/a[id=1]", "/a[id=2]"], "/a[id=2]": ["/a[id=2]"], "/a[*]": ["/a[id=1]", "/a[id=2]"], "/*": ["/a[id=1]", "/a[id=2]", "/z"], "/a/b*": ["/a[id=1]/b", "/a[id=2]/bb"], "/*/b": ["/a[id=1]/b", "/z/b"],
    "/a/**": ["/a[id=1]/b", "/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]", "/a[id=2]/bb", "/a[id=2]/bb/c[x=1, y=1]"], "/**/c": ["/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]", "/a[id=2]/bb/c[x=1, y=1]"],
    "/**/c[x=1*]": ["/a[id=1]/b/c[x=1, y=2]", "/a[id=2]/bb/c[x=1, y=1]"], "/**/c[*y=2]": ["/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]"], "/**/c/..": ["/a[id=1]/b", "/a[id=2]/bb"], "/**/c/../..": ["/a[id=1]", "/a[id=2]"],
    "/**/c[x=2*]/../c": ["/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]"], "/z/../a/./bb": ["/a[id=2]/bb"], "/**/b/../**": ["/a[id=1]/b", "/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]", "/z/b", "/z/b/d"], "/..": [], "/a/../..": [], "/nothing/**": [], "/a/..": ["/"],
}


@pytest.mark.parametrize("pattern", sorted(FOUND))
def test_nodes_that_a_pattern_finds(spark, pattern):
    nodes = spark.createDataFrame([(n,) for n in NODES], "path string")
    assert sorted(r["path"] for r in H.find(nodes, pattern).collect()) == FOUND[pattern]


def test_patterns_from_given_nodes(spark):
    nodes = spark.createDataFrame([(n,) for n in NODES], "path string")
    start = spark.createDataFrame([("/a[id=1]/b",), ("/z",)], "path string")
    found = lambda p: sorted(r["path"] for r in H.find(nodes, p, start).collect())
    assert found(".") == ["/a[id=1]/b", "/z"]
    assert found("..") == ["/", "/a[id=1]"]
    assert found("*") == ["/a[id=1]/b/c[x=1, y=2]", "/a[id=1]/b/c[x=2, y=2]", "/z/b"]
    assert found("../*") == ["/a[id=1]", "/a[id=1]/b", "/a[id=2]", "/z"]
    assert found("/z") == ["/z"]


def test_metrics_that_a_pattern_finds(spark):
    nodes = spark.createDataFrame([(n,) for n in NODES], "path string")
    metrics = spark.createDataFrame([(n, m) for n in NODES for m in ("cpu-user", "cpu-system", "net")], "resource string, metric string")
    assert sorted(map(tuple, H.find_metrics(metrics, "/a/b*:cpu*", nodes).collect())) == [(n, m) for n in ("/a[id=1]/b", "/a[id=2]/bb") for m in ("cpu-system", "cpu-user")]
    assert H.find_metrics(metrics, "/z:*t", nodes).collect()[0]["metric"] == "net"


@pytest.mark.parametrize("pattern", ["/a**", "/a[", "/a]b", "/a[x]y", "/a:b", "/[x=1]", "/a[]"])
def test_invalid_patterns(pattern):
    with pytest.raises(InvalidPattern):
        compile_pattern(pattern)
