import math

import pytest
from pyspark.sql import functions as F

from spanweave.functions import numeric as N
from spanweave.functions import paths as P


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


PREFIX = [("/a/b/c", 1, "/a"), ("/a/b/c", 2, "/a/b"), ("/a/b/c", 9, "/a/b/c"), ("/a/b/c", 0, "/"), ("a/b", 0, ""), ("/a/b/c", -1, "/a/b"), ("/a/b/c", -2, "/a"), ("/a/b/c", -3, "/"), ("a:b/c", -5, ""), ("", 2, ""), ("/a/b/", -1, "/a"), ("/a/b", -2.5, "/"), ("/a/b/c", 1.5, "/a/b")]
SUFFIX = [("/a/b/c", 1, "c"), ("/a/b/c", 2, "b/c"), ("/a/b/c", 3, "a/b/c"), ("/a/b/c", 4, "/a/b/c"), ("/a/b/c", 0, ""), ("/a/b/c", -1, "b/c"), ("/a/b/c", -2, "c"), ("/a/b/c", -3, ""), ("a:b", 1, "b"), ("/a/b/", 1, "b/"), ("", 1, "")]


@pytest.mark.parametrize("path, n, want", PREFIX)
def test_path_prefix(spark, path, n, want):
    assert one(spark, P.path_prefix(F.lit(path), n), P.path_prefix(F.lit(path), F.lit(float(n)))) == (want, want)


@pytest.mark.parametrize("path, n, want", SUFFIX)
def test_path_suffix(spark, path, n, want):
    assert one(spark, P.path_suffix(F.lit(path), n)) == (want,)


CHILD = [("/a/b", "/a", True, True), ("/a/b/c", "/a", False, True), ("/a/", "/a", False, False), ("/ab", "/a", False, False), ("/a", "/", True, True), ("/a/b", "/", False, True), ("", "/a", False, False), ("/a", "", False, False), ("/a:b", "/a", True, True), ("/a", "/a", False, False)]


@pytest.mark.parametrize("path, other, child, descendant", CHILD)
def test_relations(spark, path, other, child, descendant):
    a, b = F.lit(path), F.lit(other)
    assert one(spark, P.is_child_of(a, b), P.is_parent_of(b, a), P.is_descendant_of(a, b), P.is_ancestor_of(b, a)) == (child, child, descendant, descendant)


def test_parent_and_globs(spark):
    assert one(spark, P.parent_of(F.lit("/a/b:c")), P.parent_of(F.lit("/a")), P.parent_of(F.lit("a"))) == ("/a/b", "", "")
    fits = lambda path, glob: one(spark, P.matches(F.lit(path), glob))[0]
    assert fits("/a/b/c", "/a/**") and fits("/a/b.c", "/a/b.c") and not fits("/a/b/c", "/a/*") and not fits("/a/bxc", "/a/b.c") and fits("/user[id=1]/x", "/user[*]/x")


def test_numbers(spark):
    d = lambda a, b: one(spark, N.divide(F.lit(a), F.lit(b)))[0]
    assert d(1.0, 0.0) == math.inf and d(-1.0, 0.0) == -math.inf and math.isnan(d(0.0, 0.0)) and d(3.0, 2.0) == 1.5
    nan, x = F.lit(float("nan")), F.lit(1.0)
    assert one(spark, N.equal(nan, nan), N.equal(x, x), N.greater(nan, x), N.at_least(x, nan)) == (False, True, False, False)
    assert math.isnan(one(spark, N.min_of(nan, x))[0]) and one(spark, N.min_of(x, F.lit(2.0)), N.max_of(x, F.lit(2.0))) == (1.0, 2.0)


def test_aggregates(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (3.0, 0.0, 1.0), (5.0, 1.0, 2.0)], "v double, w double, t double")
    got = df.agg(N.weighted_avg(F.col("v"), F.col("w")).alias("a"), N.find_or_default(F.col("v") > 2, F.col("v"), F.lit(9.0), "t").alias("f"), N.find_or_default(F.col("v") > 8, F.col("v"), -F.col("v"), "t").alias("g"), N.count().alias("n"), N.minimum(F.col("v")).alias("m")).first()
    assert tuple(got) == (7 / 3, 3.0, -1.0, 3.0, 1.0)
    none = df.select("v", F.lit(0.0).alias("w")).agg(N.weighted_avg(F.col("v"), F.col("w"))).first()[0]
    assert math.isnan(none)
