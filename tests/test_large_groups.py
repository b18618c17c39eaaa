"""Groups of many rows that are active at once: work grows with the rows, and however groups are dealt out the result is the same."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import attribution as A
from spanweave.operators import hierarchy as H
from spanweave.operators import intervals as I

from .work import most_rows


def got(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_a_fold_counts_children_that_overlap_in_linear_work(spark):
    """Each slice met each active child before: some 320,000 rows here."""
    n = 800
    leaves = [(float(i), float(n + i), f"/a/{i}", ["NONE", "LOCAL", "GLOBAL"][i % 3]) for i in range(n)]
    df = spark.createDataFrame(leaves, "_start_time double, _end_time double, path string, status string")
    out = []
    assert most_rows(spark, lambda: out.extend(got(H.fold_statuses(df, [], H.Predicate("majority"), bucket=64.0)))) < 5 * n
    assert {p for *_, p, _ in out} == {"/", "/a"} and max(r[1] for r in out) == 2 * n - 1


@pytest.mark.parametrize("large", [0, 30, 10_000])
def test_runs_of_state_however_groups_are_dealt_out(spark, monkeypatch, large):
    monkeypatch.setattr(I, "LARGE_GROUP", large)
    rnd = random.Random(1)
    rows = [(float(s), float(s + rnd.randrange(0, 9)), k, 1, rnd.randrange(2)) for k, n in (("a", 60), ("b", 20), ("c", 4)) for s in (rnd.randrange(0, 50) for _ in range(n))]
    df = spark.createDataFrame(rows, "_start_time double, _end_time double, k string, n int, v int")
    want = []
    for k in "abc":
        for t in range(60):
            active = [(n, v) for s, e, key, n, v in rows if key == k and s <= t < e]
            if active:
                state = len(active) % 3, sum(v for _, v in active) > 4
                if want and want[-1][2:] == (k, state) and want[-1][1] == t:
                    want[-1] = (want[-1][0], t + 1, k, state)
                else:
                    want.append((t, t + 1, k, state))
    found = I.temporal_state(df, ["k"], ["n", "v"], F.struct((F.col("n") % 3).alias("n"), (F.col("v") > 4).alias("v")), 7.0)
    assert sorted((r["_start_time"], r["_end_time"], r["k"], tuple(r["state"])) for r in found.collect()) == sorted(want)
    assert found.filter("false").count() == 0 and I.temporal_state(df.limit(0), ["k"], ["n"], F.col("n"), 7.0).count() == 0


def test_aggregates_over_rows_that_overlap_in_linear_work(spark):
    """As for folds, each slice met each active row before."""
    n = 800
    df = spark.createDataFrame([(float(i), float(n + i), float(i * 7 % 11)) for i in range(n)], "_start_time double, _end_time double, v double")
    out = []
    run = lambda: out.extend(got(I.temporal_aggregate(df, [], {"n": F.count(F.lit(1)), "most": F.max("v")}, 400.0, combine={"n": F.sum, "most": F.max})))
    assert most_rows(spark, run) < 30 * n
    assert len(out) == 2 * n - 1 and max(r[-1] for r in out) == n


@pytest.mark.parametrize("width", [3.0, 17.0, 100.0])
def test_aggregates_put_together_from_parts_equal_those_over_all_rows(spark, width):
    rnd = random.Random(2)
    rows = [(float(s), float(s + rnd.randrange(0, 30)), k, rnd.randrange(9)) for k in "ab" for s in (rnd.randrange(-20, 60) for _ in range(40))]
    df = spark.createDataFrame(rows, "_start_time double, _end_time double, k string, v long")
    asked = {"n": F.count(F.lit(1)), "least": F.min("v"), "total": F.sum("v")}
    whole = {"n": F.sum, "least": F.min, "total": F.sum}
    for keys in ([], ["k"]):
        for merge, seams in ((True, True), (False, True), (False, False)):
            assert got(I.temporal_aggregate(df, keys, asked, width, merge, seams, whole)) == got(I.temporal_aggregate(df, keys, asked, width, merge, seams))
    assert I.temporal_aggregate(df.limit(0), [], asked, width, combine=whole).count() == 0


def test_ancestors_are_blocked_in_linear_work(spark):
    """The root met all blocked phases in each slice before."""
    n = 800
    df = spark.createDataFrame([(float(i), float(n + i), f"/u{i}/x") for i in range(n)], "_start_time double, _end_time double, path string")
    out = []
    assert most_rows(spark, lambda: out.extend(got(H.blocked_above(df, 400.0)))) < 8 * n
    assert (2.0 * n - 1, 2.0 * n - 1, 0.0, "/") in out and len(out) == n + 1


def usage(spark, seed, groups=3):
    """Samples of two metrics a group, phases that may overlap, and metadata."""
    rnd = random.Random(seed)
    name = lambda: [rnd.choice([None, "x", "y"])]
    m = [(float(s), float(s + 6), 6.0, g, f"{g}:{k}", 9.0, float(rnd.randrange(10)), v) for g in range(groups) for k in "pq" for v in [name()] for s in range(0, 60, 6) if rnd.random() < 0.9]
    p = [(float(s), float(e), float(e - s), g, f"{g}/{i}", rnd.choice(["exact", "variable", "other"]), name()) for g in range(groups - 1) for i in range(25) for s in [rnd.randrange(0, 55)] for e in [s + rnd.randrange(1, 9)]]
    metrics = spark.createDataFrame(m, "_start_time double, _end_time double, _duration double, g int, metric string, capacity double, usage double, mapped array<string>")
    phases = spark.createDataFrame(p, "_start_time double, _end_time double, _duration double, g int, phase string, type string, mapped array<string>")
    return metrics, phases, spark.createDataFrame([("exact", "exact", 2.0), ("variable", "variable", 1.0), ("idle", "none", 0.0)], "type string, rule string, demand double")


@pytest.mark.parametrize("mapped", [None, "mapped"])
def test_groups_that_meet_whole_give_what_buckets_give(spark, monkeypatch, mapped):
    m, p, rules = usage(spark, 4)
    plain = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in got(d))
    curves = [A.demand_curve(m, p, rules, ["g"], width, mapped) for width in (None, 7.0)]
    assert plain(curves[0]) == plain(curves[1]) and curves[0].count() > 100
    idle = p.filter("type = 'other'").withColumn("type", F.lit("idle"))
    out = []
    for most in (10_000, 30, -1):
        monkeypatch.setattr(A, "LARGE", most)
        out.append(plain(A.attributed(m, p, rules, ["g"], 7.0, mapped, idle)))
    assert out[0] == out[1] == out[2] and len(out[0]) > 100


def test_a_demand_is_added_up_once_for_a_group(spark):
    """Each sample added up the demand in its time before: some 90,000 rows here, and 30 at a time when they met."""
    n = 200
    m = spark.createDataFrame([(float(s), float(s + n), float(n), 1, f"m{k}", 9.0, 5.0) for k in range(30) for s in (0, n)], "_start_time double, _end_time double, _duration double, g int, metric string, capacity double, usage double")
    p = spark.createDataFrame([(float(s), float(s + 20), 20.0, 1, f"p{s}", "t") for s in range(2 * n)], "_start_time double, _end_time double, _duration double, g int, phase string, type string")
    rules = spark.createDataFrame([("t", "variable", 1.0)], "type string, rule string, demand double")
    assert most_rows(spark, lambda: A.demand_curve(m, p, rules, ["g"]).count()) < 20_000


def test_composites_within_groups(spark):
    m, p, rules = usage(spark, 5)
    leaves = A.attributed(m, p, rules, ["g"], 7.0).withColumn("parent", F.explode(F.array(F.lit("/"), F.concat(F.lit("/"), F.col("g").cast("string")))))
    alone = leaves.filter("g = 0").groupBy("g", "metric", "parent", "_start_time", "_end_time").agg(F.first("usage").alias("usage"), F.first("capacity").alias("capacity"))
    spans = spark.createDataFrame([(0, "/", 3.0, 50.0), (0, "/0", 5.0, 20.0), (1, "/", 3.0, 50.0), (1, "/1", 70.0, 80.0)], "g int, parent string, _start_time double, _end_time double")
    plain = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got(d))
    for rows in (leaves, alone, alone.filter("_start_time > 30"), leaves.withColumn("_end_time", F.col("_end_time") + 1.5)):
        want = A.attribute_composite(rows, "parent", spans.drop("g").distinct(), 7.0)
        assert plain(A.attribute_composite(rows, "parent", spans, 7.0, ["g"])) == plain(want)
