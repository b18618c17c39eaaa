import struct

import pytest

from spanweave.sources import formats, logs


def trace(t0, samples):
    """A network trace: names, then counts."""
    out = struct.pack("<QB", t0, 0) + b"\x01eth0\0"
    for t, received in samples:
        out += struct.pack("<QB", t, 1) + b"\x01" + bytes([received, 0, 0, 0])
    return out


@pytest.fixture()
def runs(spark, tmp_path):
    formats.register(spark)
    for host in ("a", "b", "c"):
        (tmp_path / "traces" / host).mkdir(parents=True)
        (tmp_path / "traces" / host / f"proc-net-dev-{host}").write_bytes(trace(0, [(1_000_000_000, 10), (2_000_000_000, 20)]))
        (tmp_path / "traces" / host / f"proc-stat-{host}").write_bytes(b"")
        (tmp_path / "traces" / host / "notes.txt").write_text("no trace")
    return str(tmp_path / "traces")


def test_traces_by_name(spark, runs):
    df = spark.read.format("monitor_trace").load(runs)
    rows = sorted((r["host"], r["metric"], r["start_ns"], r["end_ns"], r["usage"]) for r in df.filter("metric LIKE '%received'").collect())
    assert rows == [(h, "network[interface=eth0]:bytes-received", t * 10**9, (t + 1) * 10**9, 10.0 * (t + 1)) for h in "abc" for t in (0, 1)]


def test_filters_on_host_and_kind_skip_files(spark, runs):
    load = lambda: spark.read.format("monitor_trace").option("taskBytes", "1").load(runs)
    assert load().rdd.getNumPartitions() == 6
    for condition, n in [("host = 'a'", 2), ("host IN ('a', 'c')", 4), ("host = 'a' AND kind = 'proc-net-dev'", 1), ("usage > 1", 6)]:
        assert load().filter(condition).rdd.getNumPartitions() == n, condition
    assert {r["host"] for r in load().filter("host IN ('a', 'c')").collect()} == {"a", "c"}
    assert load().filter("host = 'nobody'").count() == 0
    reader = formats.MonitorTrace({"path": runs}).reader(None)
    left = list(reader.pushFilters([formats.EqualTo(("host",), "a"), formats.EqualTo(("usage",), 1.0)]))
    assert [f.attribute for f in left] == [("usage",)] and [p for part in reader.partitions() for p, _ in part.files] == [f"{runs}/a/proc-net-dev-a", f"{runs}/a/proc-stat-a"]


def test_a_place_that_does_not_exist(spark, tmp_path):
    formats.register(spark)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("monitor_trace").load(str(tmp_path / "nowhere")).collect()


GIRAPH = """INFO org.apache.giraph.metrics.OperationLog: time=10, event=start, op=job
x INFO TaskAttemptImpl: TaskAttempt: [attempt_7] using containerId: [c_1 on NM: [node3.cluster:8041]
INFO org.apache.giraph.metrics.OperationLog - time=11, event=start, op=step
INFO nothing else
INFO org.apache.giraph.metrics.OperationLog: time=12, event=end, op=step
INFO org.apache.giraph.metrics.OperationLog: time=12, event=start, op=step
INFO org.apache.giraph.metrics.OperationLog: time=13, event=start, op=load
INFO org.apache.giraph.metrics.OperationLog: time=14, event=single, op=mark, size=3
INFO org.apache.giraph.metrics.OperationLog: time=15, event=end, op=load
INFO org.apache.giraph.metrics.OperationLog: time=19, event=end, op=step
INFO org.apache.giraph.metrics.OperationLog: time=20, event=end, op=job
"""


def test_operation_logs(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "w1.log").write_text(GIRAPH)
    (tmp_path / "g" / "w2.log").write_text(GIRAPH.replace("=1", "=2"))
    records = spark.read.format("operation_log").option("dialect", "giraph").load(str(tmp_path / "g"))
    assert records.filter("file = 'w1.log'").count() == 10
    placed = records.filter("timestamp = 0 and file = 'w1.log'").first()
    assert placed["tags"] == {"type": "map-taskAttempt-to-hostname", "taskAttempt": "attempt_7", "hostname": "node3"} and placed["line"] == 1
    phases = logs.nested_phases(records.filter("file = 'w1.log'"), ["file"], "op").orderBy("start_ns", "depth").collect()
    assert [(r["path"], r["start_ns"] // 10**6, r["end_ns"] // 10**6) for r in phases] == [("/job[n=1]", 10, 20), ("/job[n=1]/step[n=1]", 11, 12), ("/job[n=1]/step[n=2]", 12, 19), ("/job[n=1]/step[n=2]/load[n=1]", 13, 15)]


def test_powergraph_logs(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "p.log").write_text("[node1:123] MCW rank 4\nOperationLog: time=5, event=start, op=a\nOperationLog: time=9, event=end, op=a\nOperationLog: time=11, event=start, op=lost\n")
    records = spark.read.format("operation_log").option("dialect", "powergraph").load(str(tmp_path / "p.log"))
    assert records.filter("timestamp = 0").first()["tags"] == {"type": "map-hostname-to-worker", "hostname": "node1", "worker": "4"}
    assert [tuple(r) for r in logs.nested_phases(records, ["file"], "op").select("path", "start_ns", "end_ns").collect()] == [("/a[n=1]", 5, 9)]
    (tmp_path / "bad.log").write_text("OperationLog: event=start, op=a\n")
    with pytest.raises(Exception, match="needs a time"):
        spark.read.format("operation_log").option("dialect", "powergraph").load(str(tmp_path / "bad.log")).collect()


def test_places_that_nobody_wrote_are_not_paired(spark):
    rows = [(1, "END", "a"), (2, "START", "a"), (3, "END", "a"), (3, "START", "b"), (5, "END", "b"), (6, "END", "b")]
    df = spark.createDataFrame([("f", k, t, e, {"op": o}) for k, (t, e, o) in enumerate(rows)], "file string, line long, timestamp long, event string, tags map<string,string>")
    got = [tuple(r) for r in logs.nested_phases(df, ["file"], "op").select("path", "start_ns", "end_ns").orderBy("start_ns").collect()]
    assert got == [("/a[n=1]", 2, 3), ("/b[n=1]", 3, 5)]
