import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.operators import attribution as A
from spanweave.operators import bottlenecks as B


@pytest.fixture(scope="module")
def case(spark):
    metrics = spark.createDataFrame([(0.0, 10.0, "h", "m", 8.0, 6.0), (10.0, 20.0, "h", "m", 8.0, 2.0)], "_start_time double, _end_time double, host string, metric string, capacity double, usage double")
    phases = spark.createDataFrame([(0.0, 4.0, "h", "A", "a"), (2.0, 12.0, "h", "B", "b")], "_start_time double, _end_time double, host string, phase string, type string")
    rules = spark.createDataFrame([("a", "variable", 1.0), ("b", "variable", 2.0)], "type string, rule string, demand double")
    return metrics, phases, rules


def test_upsampling_case(case):
    metrics, phases, rules = case
    curve = A.demand_curve(metrics, phases, rules, ["host"])
    demand = {(r["_start_time"], r["_end_time"]): r["variable"] for r in curve.collect()}
    assert demand == {(0, 2): 1, (2, 4): 3, (4, 10): 2, (10, 12): 2, (12, 20): 0}
    up = A.upsample(curve, ["host"])
    usage = {r["_start_time"]: r["usage"] for r in up.collect()}
    assert usage == pytest.approx({0: 3.142857, 2: 8.0, 4: 6.285714, 10: 8.0, 12: 0.5}, rel=1e-5)
    leaves = {(r["phase"], r["_start_time"]): r["usage"] for r in A.attribute(up, phases, rules, ["host"]).collect()}
    assert leaves[("A", 2.0)] == pytest.approx(8 / 3) and leaves[("B", 2.0)] == pytest.approx(16 / 3) and leaves[("A", 0.0)] == pytest.approx(3.142857, rel=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.floats(0, 4), st.floats(0, 4)), min_size=1, max_size=6), st.floats(0, 8))
def test_upsampling_keeps_the_mean(slices, value):
    part = np.array([s[0] for s in slices], dtype=float)
    part /= part.sum()
    out = A._spread(value, 8.0, part, np.array([s[1] for s in slices]), np.array([s[2] for s in slices]))
    assert (out <= 8.0 + 1e-9).all() and (out * part).sum() == pytest.approx(value, abs=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_nnls_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 4)), rng.standard_normal(12)
    x = A.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_best_fit_finds_demands(spark):
    rows, spans = [], []
    for i in range(40):
        a, b = (i * 7) % 10 / 10, (i * 3) % 10 / 10
        rows.append((float(i), i + 1.0, "h", "m", "kind", 3 * a + 0.5 * b))
        spans += [(float(i), i + p, "h", t) for p, t in ((a, "a"), (b, "b")) if p]
    metrics = spark.createDataFrame(rows, "_start_time double, _end_time double, host string, metric string, kind string, usage double")
    phases = spark.createDataFrame(spans, "_start_time double, _end_time double, host string, type string")
    got = {r["type"]: r["demand"] for r in A.best_fit_rules(metrics, phases, ["host"], "kind").collect()}
    assert got == pytest.approx({"a": 3.0, "b": 0.5}, abs=1e-6)


def test_finish_times(spark):
    phases = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 1.0), (4, 5.0)], "id long, duration double")
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 4)], "id long, after long")
    assert {r["id"]: r["finish"] for r in B.finish_times(phases, edges).collect()} == {1: 2.0, 2: 5.0, 3: 6.0, 4: 5.0}
    with pytest.raises(ValueError):
        B.finish_times(phases, spark.createDataFrame([(1, 2), (2, 1)], "id long, after long"))


def plain_fit(metrics, phases, overrides, on):
    """The dense matrix of one kind: a row for each sample, a column for each type and one for overriding variable demand."""
    types = sorted({p["type"] for p in phases})
    rows, target = [], []
    for m in metrics:
        row, exact = np.zeros(len(types) + 1), 0.0
        for p in phases:
            if p[on] != m[on]:
                continue
            part = max(0.0, min(m["_end_time"], p["_end_time"]) - max(m["_start_time"], p["_start_time"])) / (m["_end_time"] - m["_start_time"])
            rule, demand = overrides.get(p["phase"], (None, 0.0))
            if rule is None:
                row[types.index(p["type"])] += part
            elif rule == "variable":
                row[-1] += part * demand
            elif rule == "exact":
                exact += part * demand
        rows.append(row)
        target.append(max(0.0, m["usage"] - exact))
    return types, np.array(rows), np.array(target)


def test_best_fit_with_overrides_by_brute_force(spark, sf_dir):
    from spanweave.plans import catalog, models
    from spanweave.sources import views as V

    got = catalog.QUERIES["best_fit_overrides"](spark, sf_dir).collect()
    phases = V.phases(spark, sf_dir).withColumnRenamed("path", "phase")
    overrides = {r["phase"]: (r["rule"], r["demand"]) for r in models.fit_overrides(phases).collect()}
    phases, metrics = phases.collect(), V.metrics(spark, sf_dir).collect()
    assert {r for r, _ in overrides.values()} == {"exact", "variable", "none"}
    for kind in {m["type"] for m in metrics}:
        mine = [m for m in metrics if m["type"] == kind]
        types, a, b = plain_fit(mine, phases, overrides, "user_id")
        x = A.nnls(a, b)
        found = {r["type"]: r["demand"] for r in got if r["kind"] == kind and r["phase"] is None}
        assert found == pytest.approx({t: x[k] for k, t in enumerate(types) if a[:, k].any()}, abs=1e-4)
        single = {r["phase"]: (r["rule"], r["demand"]) for r in got if r["kind"] == kind and r["phase"] is not None}
        touched = {p["phase"] for p in phases if p["phase"] in overrides and any(m["user_id"] == p["user_id"] and m["_start_time"] < p["_end_time"] and p["_start_time"] < m["_end_time"] for m in mine)}
        assert set(single) == touched
        for phase, (rule, demand) in single.items():
            assert rule == overrides[phase][0] and demand == pytest.approx(overrides[phase][1] * (x[-1] if rule == "variable" else 1.0), abs=1e-4)


def test_exact_demand_over_the_usage_leaves_nothing_to_fit(spark):
    schema = "_start_time double, _end_time double, h string, "
    metrics = spark.createDataFrame([(float(i), i + 1.0, "h", "m", "k", [1.0, 9.0][i % 2]) for i in range(10)], schema + "metric string, kind string, usage double")
    phases = spark.createDataFrame([(0.0, 10.0, "h", "x", "a"), (0.0, 10.0, "h", "y", "b"), (0.0, 10.0, "h", "z", "b")], schema + "phase string, type string")
    overrides = spark.createDataFrame([("x", "exact", 3.0), ("z", "none", 0.0)], "phase string, rule string, demand double")
    got = sorted((r["type"] or "", r["phase"] or "", r["rule"], r["demand"]) for r in A.best_fit(metrics, phases, ["h"], "kind", overrides, 4.0).collect())
    assert got == [("", "x", "exact", 3.0), ("", "z", "none", 0.0), ("b", "", "variable", pytest.approx(3.0))]  # the mean of 0 and 6


def test_the_upsampled_curve_is_computed_once(spark, sf_dir):
    from spanweave.plans import catalog

    plan = catalog.QUERIES["attribute_composite"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
