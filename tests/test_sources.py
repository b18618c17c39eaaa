import json
import struct

import pytest

from spanweave.sources import logs, monitor
from spanweave.sources.export import export_tsv


def number(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def record(t, *parts):
    return struct.pack("<Q", t) + b"".join(p if isinstance(p, bytes) else number(p) for p in parts)


def test_stat_and_gaps(spark, tmp_path):
    s = 10**9
    stat = lambda t, busy, idle: record(t, 1, busy, 0, 0, idle, *[0] * 6)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/proc-stat-node-1").write_bytes(stat(0, 0, 0) + stat(s, 300, 100) + stat(2 * s, 400, 0) + b"\1\2")
    (tmp_path / "b/proc-stat-node-1").write_bytes(stat(5 * s, 0, 0) + stat(6 * s, 0, 400))
    got = monitor.read_traces(spark, str(tmp_path)).filter("metric = 'cpu:utilization'").orderBy("start_ns").collect()
    assert [(r["start_ns"] // s, r["end_ns"] // s, r["usage"]) for r in got] == [(0, 1, 0.75), (1, 2, 1.0), (2, 5, 0.0), (5, 6, 0.0)]
    assert got[0]["path"] == "/cluster/machine[hostname=node-1]/cpu:utilization" and got[0]["type"] == "/cluster/machine/cpu:utilization"
    assert monitor.as_metrics(monitor.read_traces(spark, str(tmp_path)), 0).filter("path LIKE '%full-cores'").count() == 4


def test_devices():
    s = 10**9
    names = record(0, b"\0", 1, b"eth0\0")
    net = monitor.decode_network(names + record(2 * s, b"\1", 1, 4000, 1, 200, 1))
    assert [(r[0], r[1], r[3]) for r in net] == [(0, 2 * s, 2000.0), (0, 2 * s, 100.0)]
    disk = monitor.decode_disk(record(0, b"\0", 1, b"sda\0") + record(s, b"\1", 1, 1, 10, 5000, 1, 20, 0, 100))
    assert {r[2]: r[3] for r in disk} == {"disk[id=sda]:bytes-read": 5120.0, "disk[id=sda]:bytes-written": 10240.0, "disk[id=sda]:read-time": 1.0, "disk[id=sda]:total-time": 0.1}
    gpu = monitor.decode_gpu(record(0, b"\0", 1, b"x\0") + record(1, b"\1", 1, b"\x32\x0a", 1, 2) + record(s, b"\1", 1, b"\x32\x0a", 1, 2))
    assert [r[3] for r in gpu] == [0.5, 0.1, 1024.0, 2048.0]


def test_spark_log(spark, tmp_path):
    events = [
        {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "Timestamp": 100},
        {"Event": "SparkListenerBlockManagerAdded", "Block Manager ID": {"Executor ID": "driver", "Host": "n1"}},
        *[{"Event": "SparkListenerJobStart", "Job ID": j, "Submission Time": s, "Stage IDs": [j]} for j, s in ((0, 110), (1, 130), (2, 160))],
        *[{"Event": "SparkListenerJobEnd", "Job ID": j, "Completion Time": e} for j, e in ((0, 120), (1, 150), (2, 190))],
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 0, "Submission Time": 131, "Completion Time": 149}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Stage Attempt ID": 0, "Task Info": {"Task ID": 7, "Attempt": 0, "Launch Time": 132, "Finish Time": 140, "Host": "n2"}},
        {"Event": "SparkListenerApplicationEnd", "Timestamp": 200},
    ]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, events)))
    phases = logs.read_spark_phases(spark, str(tmp_path))
    got = {r["path"]: (r["start_ns"] // 10**6, r["end_ns"] // 10**6, r["host"]) for r in phases.collect()}
    assert got["/spark_app[id=app-1]"] == (100, 200, "n1")
    assert got["/spark_app[id=app-1]/job[id=1]/stage[attempt=0,id=1]/task[attempt=0,id=7]"] == (132, 140, "n2")
    assert len(got) == 6
    edges = {(r["after"][-2], r["path"][-2]) for r in logs.job_dependencies(phases).collect()}
    assert edges == {("0", "1"), ("1", "2")}
    (tmp_path / "air").mkdir()
    (tmp_path / "air/t.log").write_text("AIRFLOW_CTX_DAG_ID=d\nAIRFLOW_CTX_DAG_RUN_ID=r1\nAIRFLOW_CTX_TASK_ID=t1\n[2020-01-01 00:00:01,500] started\n[2020-01-01 00:00:02,000] I tensorflow/core\n[2020-01-01 00:00:03,000] <stdout>:Epoch 1/2\n[2020-01-01 00:00:05,000] <stdout>:Epoch 2/2\n[2020-01-01 00:00:09,000] spark application app-1 ended\n")
    lines = logs.read_airflow_lines(spark, str(tmp_path / "air"))
    task = logs.airflow_phases(lines).first()
    assert task["path"] == "/airflow_dag[id=d]/run[id=r1]/task[id=t1]" and (task["end_ns"] - task["start_ns"]) / 1e9 == 7.5
    moved = {r["path"] for r in logs.spark_under_airflow(phases, lines).collect()}
    assert "/airflow_dag[id=d]/run[id=r1]/task[id=t1]/spark_app[id=app-1]/job[id=2]" in moved
    epochs = [(r["path"][-2], (r["end_ns"] - r["start_ns"]) / 1e9) for r in logs.tensorflow_epochs(lines).orderBy("start_ns").collect()]
    assert epochs == [("1", 2.0), ("2", 4.0)]


def test_airflow_order_hosts_and_records(spark, tmp_path):
    (tmp_path / "d.dag").write_text("<Task(X): a>\n    <Task(X): b>\n        <Task(X): c>\n    <Task(X): d>\n")
    edges = {(r["after"], r["task"]) for r in logs.read_airflow_order(spark, str(tmp_path)).collect()}
    assert edges == {("a", "b"), ("b", "c"), ("a", "d")}
    (tmp_path / "hosts").write_text("n1 alias1 10.0.0.1 # first\n\n# none\nn2 alias2\n")
    hosts = logs.read_hosts(spark, str(tmp_path / "hosts"))
    assert {r["alias"]: r["host"] for r in hosts.collect()} == {"n1": "n1", "alias1": "n1", "10.0.0.1": "n1", "n2": "n2", "alias2": "n2"}
    (tmp_path / "twice").write_text("n1 x\nn2 x\n")
    with pytest.raises(Exception, match="two lines"):
        logs.read_hosts(spark, str(tmp_path / "twice")).collect()
    (tmp_path / "ops").write_text("timestamp=5 type=START phase=p\ntimestamp=9 type=END phase=p\ntimestamp=9 type=START phase=q\n")
    assert [tuple(r) for r in logs.records_to_phases(logs.read_operation_log(spark, str(tmp_path / "ops")), "phase").collect()] == [("p", 5, 9)]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(True, 'a "b"', 1.5), (False, "", 2.0)], "ok boolean, name string, v double").coalesce(1)
    export_tsv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.splitlines() == ["ok\tname\tv", 'TRUE\t"a "b""\t1.5', 'FALSE\t""\t2.0']
