from spanweave.operators import bottlenecks as B


def test_duration_issues_compare_causes_that_change_at_different_times(spark):
    rows = spark.createDataFrame(
        [("p", "cpu", 0.0, 10.0, "GLOBAL"), ("p", "net", 4.0, 6.0, "LOCAL"), ("p", "net", 12.0, 15.0, "LOCAL"), ("p", "cpu", 15.0, 99.0, "NONE"), ("q", "cpu", 0.0, 3.0, "LOCAL"), ("q", "net", 0.0, 3.0, "LOCAL")],
        "phase string, metric string, _start_time double, _end_time double, status string",
    )
    found = B.duration_issues(rows, "phase", "metric", 5.0).collect()
    assert sorted(map(tuple, found)) == [("p", "cpu", 13.0, 5.0, 8.0), ("p", "net", 13.0, 10.0, 3.0)]
    assert B.duration_issues(rows.filter("false"), "phase", "metric", 5.0).collect() == []


def test_predicates_by_type(spark):
    rows = spark.createDataFrame(
        [(1, "a", "LOCAL"), (1, "a", "NONE"), (1, "b", "GLOBAL"), (2, "a", "LOCAL"), (2, "a", "NONE"), (2, "b", "NONE"), (3, "a", "LOCAL"), (3, "b", "NONE")],
        "at int, type string, status string",
    )
    found = sorted(map(tuple, B.combine_by_type(rows, ["at"], "type").collect()))
    assert found == [(1, True, True), (2, False, False), (3, False, True)]
