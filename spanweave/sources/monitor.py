"""Readers for the resource monitor's binary traces: one stream per host and kind.

A stream is a run of records: a little-endian 64-bit time in ns, then unsigned LEB128 numbers and
NUL-terminated names. Files are read as binaries and decoded on the executors, a file in a task at a
time; a record that breaks off ends its file. The rows of a metric become intervals by a window, with
a gap row of value zero between files of one host.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values: /proc/stat fields per CPU and the idle one; bytes in a sector; capacities in bytes per second.
STAT_FIELDS, IDLE, SECTOR = 10, 3, 512
NETWORK_CAPACITY, DISK_CAPACITY, PCIE_CAPACITY = 1e9, 1e8, 16 * 2.0**30
FULL = 0.95


class Stream:
    """A place in a trace's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def time(self) -> int:
        if self.at + 8 > len(self.data):
            raise EOFError
        self.at += 8
        return struct.unpack_from("<Q", self.data, self.at - 8)[0]

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        value = self.number()
        return -(value >> 1) if value & 1 else value >> 1

    def name(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise EOFError
        text, self.at = self.data[self.at : end].decode(), end + 1
        return text


def decode_stat(data: bytes) -> list[tuple]:
    """(start, end, metric, value, capacity): utilization of each core, their sum, and the cores in full use."""
    s, rows = Stream(data), []
    try:
        before, n = s.time(), s.number()
        for _ in range(n * STAT_FIELDS):
            s.number()
        while True:
            now, n = s.time(), s.number()
            use = []
            for _ in range(n):
                part = [s.number() for _ in range(STAT_FIELDS)]
                total = sum(part)
                use.append((total - part[IDLE]) / total if total else 0.0)
            rows += [(before, now, f"cpu/core[id={i}]:utilization", u, 1.0) for i, u in enumerate(use)]
            rows += [(before, now, "cpu:utilization", sum(use), float(n)), (before, now, "cpu:full-cores", float(sum(u >= FULL for u in use)), float(n))]
            before = now
    except EOFError:
        return rows


def _named(data: bytes, fields: int, measure) -> list[tuple]:
    """Rows of a stream that names its devices (type 0) and then counts for each (type 1)."""
    s, rows, names, before = Stream(data), [], [], None
    try:
        while True:
            now, kind = s.time(), s.byte()
            if kind == 0:
                names = [s.name() for _ in range(s.number())]
                before = now if before is None else before
                continue
            s.number()
            counts = [[s.number() for _ in range(fields)] for _ in names]
            if before is not None and now > before:
                for name, c in zip(names, counts):
                    rows += [(before, now, *m) for m in measure(name, c, (now - before) / 1e9)]
            before = now
    except EOFError:
        return rows


def decode_network(data: bytes) -> list[tuple]:
    """Bytes per second received and sent by each interface."""
    return _named(data, 4, lambda name, c, t: [(f"network[interface={name}]:bytes-received", c[0] / t, NETWORK_CAPACITY), (f"network[interface={name}]:bytes-sent", c[2] / t, NETWORK_CAPACITY)])


def decode_disk(data: bytes) -> list[tuple]:
    """Bytes per second and parts of time of each disk; times count up to the whole interval."""

    def measure(name, c, t):
        disk = f"disk[id={name}]"
        out = [(f"{disk}:bytes-read", c[1] * SECTOR / t, DISK_CAPACITY), (f"{disk}:bytes-written", c[4] * SECTOR / t, DISK_CAPACITY)]
        return out + [(f"{disk}:{kind}-time", min(1.0, ms / 1e3 / t), 1.0) for kind, ms in (("read", c[2]), ("write", c[5]), ("total", c[6]))]

    rows = _named(data, 7, measure)
    used = {r[2] for r in rows if r[3] > 0}
    return [r for r in rows if not r[2].endswith("-time") or r[2] in used]


def decode_gpu(data: bytes) -> list[tuple]:
    """Utilization (percent as parts) and PCIe bytes per second of each GPU; the first sample has no interval."""
    s, rows, names, before = Stream(data), [], [], None
    try:
        while True:
            now, kind = s.time(), s.byte()
            if kind == 0:
                names = [s.name() for _ in range(s.number())]
                continue
            s.number()
            for i, _ in enumerate(names):
                gpu, memory, sent, received = s.byte(), s.byte(), s.number(), s.number()
                if before is not None:
                    path = f"gpu[id={i}]"
                    rows += [(before, now, f"{path}:utilization", gpu / 100, 1.0), (before, now, f"{path}:memory-utilization", memory / 100, 1.0)]
                    rows += [(before, now, f"{path}:pcie-sent", sent * 1024.0, PCIE_CAPACITY), (before, now, f"{path}:pcie-received", received * 1024.0, PCIE_CAPACITY)]
            before = now
    except EOFError:
        return rows


def decode_memory(data: bytes) -> list[tuple]:
    """Bytes of memory in use, free and available, and of swap space in use; the first sample has no interval.

    Totals come before the samples that they hold for. Samples are differences in KiB to the sample before, the first one to zero.
    """
    s, rows, before, mem, swap = Stream(data), [], None, 0, 0
    try:
        used = free = available = swap_free = 0
        while True:
            now, kind = s.time(), s.byte()
            if kind == 0:
                if s.at + 16 > len(data):
                    raise EOFError
                mem, swap = struct.unpack_from("<QQ", data, s.at)
                s.at += 16
                continue
            used, free, available, swap_free = (x + s.signed() for x in (used, free, available, swap_free))
            if before is not None:
                values = (("memory:used", used, mem), ("memory:free", free, mem), ("memory:available", available, mem), ("swap:used", swap - swap_free, swap))
                rows += [(before, now, name, value * 1024.0, total * 1024.0) for name, value, total in values]
            before = now
    except EOFError:
        return rows


#: Kinds of trace by the prefix of their file names.
DECODERS = {"proc-stat-": decode_stat, "proc-net-dev-": decode_network, "proc-diskstats-": decode_disk, "nvml-": decode_gpu, "proc-meminfo-": decode_memory}


def read_traces(spark: SparkSession, place: str) -> DataFrame:
    """metrics of all traces under place: host, metric, path, type, capacity, usage, utilization, start_ns, end_ns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place).select("path", "content")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.col("name").rlike("^(" + "|".join(DECODERS) + ")"))

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                prefix = next(p for p in DECODERS if name.startswith(p))
                rows = DECODERS[prefix](bytes(content))
                out = pd.DataFrame(rows, columns=["start_ns", "end_ns", "metric", "usage", "capacity"])
                yield out.assign(host=name.removeprefix(prefix))[["host", "metric", "start_ns", "end_ns", "usage", "capacity"]]

    rows = files.select("name", "content").mapInPandas(decode, "host string, metric string, start_ns long, end_ns long, usage double, capacity double")
    over = Window.partitionBy("host", "metric").orderBy("start_ns")
    ahead = rows.withColumn("next_ns", F.lead("start_ns").over(over))
    gaps = ahead.filter("next_ns > end_ns").select("host", "metric", F.col("end_ns").alias("start_ns"), F.col("next_ns").alias("end_ns"), F.lit(0.0).alias("usage"), "capacity")
    path = F.concat(F.lit("/cluster/machine[hostname="), F.col("host"), F.lit("]/"), F.col("metric"))
    whole = rows.unionByName(gaps).withColumn("path", path).withColumn("type", F.regexp_replace("path", r"\[[^\]]*\]", ""))
    return whole.withColumn("utilization", F.when(F.col("capacity") == 0, 0.0).otherwise(F.col("usage") / F.col("capacity")))


def as_metrics(traces: DataFrame, first_ns: int) -> DataFrame:
    """Traces as the metrics view: seconds since first_ns."""
    seconds = lambda c: (F.col(c) - first_ns) / 1e9
    timed = traces.withColumns({"_start_time": seconds("start_ns"), "_end_time": seconds("end_ns")})
    return timed.withColumn("_duration", F.col("_end_time") - F.col("_start_time")).select("_start_time", "_end_time", "_duration", "utilization", "usage", "capacity", "path", "type", "host")
