"""Layouts of exports, time slices and memory traces."""

import struct

from spanweave.operators import timeslices as T
from spanweave.sources import export, monitor

PHASES = "_start_time double, _end_time double, path string, type string"


def test_slices_round_to_the_nearest_boundary(spark):
    rows = [(0.0, 10.0), (4.9, 15.0), (5.0, 14.9), (14.9, 15.1), (6.0, 14.0), (None, 3.0)]
    got = T.in_slices(spark.createDataFrame(rows, "_start_time double, _end_time double"), 10.0)
    assert [(r["_start_time"], r["start_slice"], r["end_slice"]) for r in got.orderBy("_start_time").collect()] == [(0.0, 0, 0), (4.9, 0, 1), (14.9, 1, 1)]
    assert T.each_slice(got.drop("start_slice", "end_slice"), 10.0).count() == 4


def test_runs_join_equal_neighbours_only(spark):
    rows = [("a", 0.0, 10.0, 1), ("a", 10.0, 12.0, 2), ("a", 12.0, 30.0, 1), ("a", 50.0, 60.0, 1), ("b", 0.0, 81920.0, 5), ("b", 81920.0, 100000.0, 5)]
    got = T.runs(spark.createDataFrame(rows, "k string, _start_time double, _end_time double, v int"), ["k"], ["v"], 10.0)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2, 1), ("a", 5, 5, 1), ("b", 0, 9999, 5)]
    assert T.runs(spark.createDataFrame([], "k string, _start_time double, _end_time double, v int"), ["k"], ["v"], 10.0).count() == 0


def test_phase_list_and_its_file(spark, tmp_path):
    phases = spark.createDataFrame([(0.0, 20.0, "/job/b[n=1]", "/job/b"), (0.0, 10.0, "/job/a[n=2]", "/job/a"), (20.0, 40.0, "/job/b[n=2]", "/job/b")], PHASES)
    listed = export.phase_list(export.with_ancestors(phases), 10.0)
    rows = {r["phase_path"]: r for r in listed.collect()}
    assert set(rows) == {"/", "/job", "/job/a[n=2]", "/job/b[n=1]", "/job/b[n=2]"}
    assert [rows[p]["canonical_index"] for p in ("/job/a[n=2]", "/job/b[n=1]", "/job/b[n=2]")] == [0, 1, 2]
    assert rows["/"]["parent_phase_id"] is None and rows["/job/b[n=1]"]["parent_phase_id"] == rows["/job"]["phase_id"]
    assert rows["/job"]["parent_phase_id"] == rows["/"]["phase_id"]
    assert tuple(rows["/job"])[4:7] == (1, 0, 3) and tuple(rows["/job/b[n=2]"])[4:7] == (2, 2, 3)
    assert "simulated_start_time_slice" in export.phase_list(export.with_ancestors(phases), 10.0, "simulated_").columns
    types = {r["phase_type_path"]: r for r in export.phase_types(export.with_ancestors(phases)).collect()}
    assert set(types) == {"/", "/job", "/job/a", "/job/b"} and types["/job/a"]["parent_phase_type_id"] == types["/job"]["phase_type_id"]
    export.export_tsv(listed, str(tmp_path / "phases"), dots=True)
    lines = [x for f in (tmp_path / "phases").glob("*.csv") for x in f.read_text().splitlines()]
    assert "phase.id\tphase.type.id\tphase.path\tparent.phase.id\tdepth\tstart.time.slice\tend.time.slice.inclusive\tcanonical.index" in lines and len({*lines}) == 6


def test_runs_of_statuses_and_of_blocked_time(spark):
    rows = [("/p", "/m", "/m", 0.0, 10.0, "NONE"), ("/p", "/m", "/m", 10.0, 20.0, "LOCAL"), ("/p", "/m", "/m", 20.0, 30.0, "GLOBAL")]
    df = spark.createDataFrame(rows, "phase string, metric string, type string, _start_time double, _end_time double, status string")
    assert sorted(tuple(r)[2:] for r in export.status_runs(df, 10.0).collect()) == [(0, 0, "N"), (1, 1, "L"), (2, 2, "G")]
    assert sorted(tuple(r)[2:] for r in export.bottleneck_runs(df, 10.0).collect()) == [(0, 0, False), (1, 2, True)]
    blocked = df.selectExpr("metric AS path", "_start_time", "_end_time", "status = 'NONE' AS held")
    assert sorted(tuple(r)[1:] for r in export.metric_runs(blocked, 10.0, "held", "is_blocked").collect()) == [(0, 0, True), (1, 2, False)]


def test_memory_traces():
    def number(n):
        out = b""
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    signed = lambda n: number(n << 1 if n > 0 else -n << 1 | 1)
    sample = lambda t, *d: struct.pack("<Q", t) + b"\1" + b"".join(map(signed, d))
    data = struct.pack("<Q", 0) + b"\0" + struct.pack("<QQ", 1000, 500) + sample(0, 300, 600, 650, 500) + sample(9, 100, -100, 0, -200) + sample(12, 0, 0, 0, 0)
    got = monitor.decode_memory(data + b"\1\2")
    assert [r[2:] for r in got[:4]] == [("memory:used", 400 * 1024.0, 1000 * 1024.0), ("memory:free", 500 * 1024.0, 1000 * 1024.0), ("memory:available", 650 * 1024.0, 1000 * 1024.0), ("swap:used", 200 * 1024.0, 500 * 1024.0)]
    assert {r[:2] for r in got} == {(0, 9), (9, 12)} and len(got) == 8 and monitor.decode_memory(b"") == []
