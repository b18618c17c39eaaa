import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import intervals as I

LEFT = [(0.0, 1.0, "a", "c", "1/1"), (1.0, 2.0, "a", "c", "1/2"), (2.0, 3.0, "a", "c", "1/3"), (3.0, 4.0, "a", "c", "1/4"), (4.0, 5.0, "a", "c", "1/5"), (0.0, 1.5, "b", "d", "2/1"), (1.5, 3.0, "b", "d", "2/2"), (3.0, 4.5, "b", "d", "2/3"), (4.5, 6.0, "b", "d", "2/4")]
RIGHT = [(0.0, 1.0, "a", "c", "1/1"), (1.0, 3.0, "a", "c", "1/2"), (3.0, 5.0, "a", "c", "1/3"), (5.0, 6.0, "a", "c", "1/4"), (0.0, 10.0, "a", "d", "2/1"), (0.0, 1.0, "b", "d", "3/1"), (1.0, 2.5, "b", "d", "3/2"), (4.5, 5.0, "b", "d", "3/3"), (5.0, 5.5, "b", "d", "3/4")]
BOTH = [(0, 1, "1/1", "1/1"), (1, 2, "1/2", "1/2"), (2, 3, "1/3", "1/2"), (3, 4, "1/4", "1/3"), (4, 5, "1/5", "1/3"), (0, 1, "2/1", "3/1"), (1, 1.5, "2/1", "3/2"), (1.5, 2.5, "2/2", "3/2"), (4.5, 5, "2/4", "3/3"), (5, 5.5, "2/4", "3/4")]


@pytest.fixture(scope="module")
def sides(spark):
    return tuple(spark.createDataFrame(rows, "_start_time double, _end_time double, key1 string, key2 string, v string") for rows in (LEFT, RIGHT))


@pytest.mark.parametrize("on, bucket, n, total", [([], 2.0, 29, 28.5), (["key1"], None, 15, 13.5), (["key2"], None, 14, 14.5), (["key1", "key2"], None, 10, 8.5), (["key1"], 1.0, 15, 13.5)])
def test_overlap_join(sides, on, bucket, n, total):
    got = I.overlap_join(*sides, ("l", "r"), [(c, c) for c in on], bucket).toPandas()
    assert (len(got), got["_duration"].sum()) == (n, total)


def test_overlap_join_rows(sides):
    got = I.overlap_join(*sides, ("l", "r"), [("key1", "key1"), ("key2", "key2")])
    assert sorted(tuple(r) for r in got.select("_start_time", "_end_time", "l_v", "r_v").collect()) == sorted(BOTH)
    with pytest.raises(ValueError):
        I.overlap_join(*sides, ("l", "r"))


def made(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.randrange(0, 40)
        rows.append((float(s), float(s + rnd.randrange(1, 9)), rnd.choice("xy"), rnd.randrange(1, 5), i))
    return rows, spark.createDataFrame(rows, "_start_time double, _end_time double, k string, v long, i long")


def sweep(rows, key):
    points = sorted({t for r in rows if r[2] == key for t in r[:2]})
    out = []
    for s, e in zip(points, points[1:]):
        active = [r[3] for r in rows if r[2] == key and r[0] <= s and r[1] >= e]
        if active:
            value = (sum(active), max(active))
            if out and out[-1][1] == s and out[-1][2] == value:
                out[-1] = (out[-1][0], e, value)
            else:
                out.append((s, e, value))
    return [(key, s, e, *v) for s, e, v in out]


@pytest.mark.parametrize("bucket", [None, 7.0])
def test_temporal_aggregate(spark, bucket):
    rows, df = made(spark)
    got = I.temporal_aggregate(df, ["k"], {"total": F.sum("v"), "most": F.max("v")}, bucket)
    assert sorted(tuple(r) for r in got.select("k", "_start_time", "_end_time", "total", "most").collect()) == sorted(sweep(rows, "x") + sweep(rows, "y"))


def test_temporal_sum_keeps_the_integral(spark):
    rows, df = made(spark)
    got = I.temporal_sum(df.withColumn("v", F.col("v").cast("double")), ["k"], "v")
    assert got.agg(F.sum(F.col("v") * F.col("_duration"))).first()[0] == pytest.approx(sum((e - s) * v for s, e, _, v, _ in rows))


def test_coalesce_is_idempotent_and_keeps_time(spark):
    _, df = made(spark)
    once = I.temporal_aggregate(df, ["k"], {"m": F.max("v") > 3}, merge=False)
    merged = I.coalesce_intervals(once, ["k"], ["m"])
    again = I.coalesce_intervals(merged, ["k"], ["m"])
    key = lambda d: sorted(tuple(r) for r in d.select("k", "_start_time", "_end_time", "m").collect())
    assert key(merged) == key(again) and merged.count() < once.count()
    assert merged.agg(F.sum("_duration")).first() == once.agg(F.sum("_duration")).first()


def test_interval_minus(spark):
    rows, df = made(spark, 25)
    gone, right = made(spark, 12, seed=8)
    right = right.select("_start_time", "_end_time", "k")
    got = I.interval_minus(I.with_duration(df), right, ["k"], ["i"]).collect()
    cells = {(r["i"], t) for r in got for t in range(int(r["_start_time"]), int(r["_end_time"]))}
    want = {(i, t) for s, e, k, _, i in rows for t in range(int(s), int(e)) if not any(g[2] == k and g[0] <= t < g[1] for g in gone)}
    assert cells == want and all(r["_duration"] == r["_end_time"] - r["_start_time"] for r in got)


def test_sum_of_series_and_slices(spark):
    rows, df = made(spark)
    half = [df.filter("i < 30"), df.filter("i >= 30")]
    got = I.series_sum(half, ["k"], "v")
    assert sorted((r["k"], r["_start_time"], r["_end_time"], r["v"]) for r in got.collect()) == sorted(merge_sums(rows))
    assert I.between(df, 10, 12).count() == sum(r[0] < 12 and r[1] > 10 for r in rows)


def merge_sums(rows):
    out = []
    for k, s, e, total, _ in sorted(sweep(rows, "x") + sweep(rows, "y")):
        if out and out[-1][0] == k and out[-1][2] == s and out[-1][3] == total:
            out[-1] = (k, out[-1][1], e, total)
        else:
            out.append((k, s, e, total))
    return out


def test_buckets_change_no_result(spark):
    import random

    rnd = random.Random(8)
    rows = [(float(s), float(s + rnd.randrange(1, 30)), k, float(rnd.randrange(5))) for k in "ab" for s in (rnd.randrange(0, 90) for _ in range(40))]
    df = spark.createDataFrame(rows, "_start_time double, _end_time double, k string, v double")
    got = lambda d: sorted(tuple(r[c] for c in sorted(d.columns)) for r in d.collect())
    total = {"v": F.sum("v"), "n": F.count(F.lit(1))}
    whole = got(I.temporal_aggregate(df, ["k"], total, merge=False))
    more = df.filter("k = 'a'").withColumn("k", F.lit("b"))
    one = df.withColumn("row", F.struct("_start_time", "_end_time", "k", "v")).distinct().withColumn("_duration", F.col("_end_time") - F.col("_start_time"))
    for width in (1.0, 7.0, 64.0, 1000.0):
        assert got(I.temporal_aggregate(df, ["k"], total, width, merge=False, seams=False)) == whole
        assert got(I.temporal_sum(df, ["k"], "v", width)) == got(I.temporal_sum(df, ["k"], "v"))
        assert got(I.covered_time(df, ["k"], width)) == got(I.covered_time(df, ["k"]))
        assert got(I.interval_minus(one.drop("v"), more.filter("v > 3"), ["k"], ["row"], width)) == got(I.interval_minus(one.drop("v"), more.filter("v > 3"), ["k"], ["row"]))
        both = I.running(df.withColumn("t", F.struct("_start_time", "_end_time", "v")), ["k"], ["t"], {"s": "v"}, {"m": "v"}, F.floor(F.col("_start_time") / width))
        plain = I.running(df.withColumn("t", F.struct("_start_time", "_end_time", "v")), ["k"], ["t"], {"s": "v"}, {"m": "v"})
        agg = lambda d: got(d.groupBy("k", "_start_time", "_end_time", "v").agg(F.max("s").alias("s"), F.max("m").alias("m")))
        assert agg(both) == agg(plain)


def test_a_series_is_zero_outside_its_samples(spark):
    df = spark.createDataFrame([(2.0, 4.0, "a", 1.0), (4.0, 5.0, "a", 2.0), (8.0, 20.0, "a", 3.0)], "_start_time double, _end_time double, k string, v double")
    spans = spark.createDataFrame([(0.0, 10.0, "a"), (0.0, 1.0, "b")], "_start_time double, _end_time double, k string")
    for width in (None, 3.0):
        got = sorted((r["k"], r["_start_time"], r["_end_time"], r["v"]) for r in I.covered_from(df, ["k"], "v", spans, width).collect())
        assert got == [("a", 0.0, 2.0, 0.0), ("a", 2.0, 4.0, 1.0), ("a", 4.0, 5.0, 2.0), ("a", 5.0, 8.0, 0.0), ("a", 8.0, 10.0, 3.0), ("b", 0.0, 1.0, 0.0)]
