"""Sources by name: `spark.read.format(...)` for monitor traces and for the operation logs of graph frameworks.

    register(spark)
    spark.read.format("monitor_trace").load("hdfs://host/runs")           # rows of resource usage
    spark.read.format("operation_log").option("dialect", "giraph").load("/runs")

A source lists files on the driver, and a task reads a run of files of bounded size, so tasks grow with the data.
Filters on what a file's name says (its host and kind) are pushed to the listing: the other files are not opened. Files are
opened through Arrow's file systems, which know local, HDFS, S3 and GCS addresses.

A new source is a subclass of FileSource with a schema and `rows`, which decodes one file; register it with
spark.dataSource.register.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .monitor import DECODERS

#: Bytes of files that one task reads, unless one file is larger.
TASK_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Files of one task: (path, name's parts)."""

    files: list[tuple[str, dict]]


def _file_system(place: str):
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", place):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place


class FileReader(DataSourceReader):
    """Lists, filters and reads the files of a FileSource."""

    def __init__(self, source: FileSource):
        self.source, self.wanted = source, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on the columns that come from names; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.source.from_name:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        place = self.source.options.get("path", "")
        system, root = _file_system(place)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(place)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        held, parts, size = [], [], 0
        most = int(self.source.options.get("taskbytes", TASK_BYTES))
        for f in sorted(found, key=lambda f: f.path):
            named = self.source.named(f.base_name) if f.type == fs.FileType.File else None
            if named is None or any(named[c] not in values for c, values in self.wanted.items()):
                continue
            if held and size + f.size > most:
                parts.append(Files(held))
                held, size = [], 0
            held.append((f.path, named))
            size += f.size
        return parts + [Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.source.options.get("path", ""))
        for path, named in partition.files:
            with system.open_input_stream(path) as stream:
                yield from self.source.rows(path, named, stream)


class FileSource(DataSource):
    """Rows of many files. from_name: the columns that named(), a file's name's parts, gives."""

    from_name: tuple[str, ...] = ()

    def named(self, name: str) -> dict | None:
        """The parts of a file's name, None for a file that is not the source's."""
        raise NotImplementedError

    def rows(self, path: str, named: dict, stream) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self)


class MonitorTrace(FileSource):
    """Usage of each resource over each sample, from the monitor's binary traces; host and kind are those of the file's name."""

    from_name = ("host", "kind")

    @classmethod
    def name(cls) -> str:
        return "monitor_trace"

    def schema(self) -> str:
        return "host string, kind string, metric string, start_ns long, end_ns long, usage double, capacity double"

    def named(self, name: str) -> dict | None:
        prefix = next((p for p in DECODERS if name.startswith(p)), None)
        return prefix and {"host": name.removeprefix(prefix), "kind": prefix.rstrip("-")}

    def rows(self, path, named, stream):
        for start, end, metric, usage, capacity in DECODERS[named["kind"] + "-"](stream.read()):
            yield named["host"], named["kind"], metric, start, end, float(usage), float(capacity)


#: What the frameworks write before an operation's pairs, and the lines that tell where a worker runs, by dialect.
DIALECTS = {
    "giraph": (r"org.apache.giraph.metrics.OperationLog\s*[:-]\s*(.*)", r"TaskAttemptImpl: TaskAttempt: \[([^]]*)].*on NM: \[(\w*)\..*]", ("taskAttempt", "hostname"), 1_000_000),
    "powergraph": (r"OperationLog: (.*)", r"\[(.*):\d*\] MCW rank (\d+)", ("hostname", "worker"), 1),
}
PLACED = {"giraph": "map-taskAttempt-to-hostname", "powergraph": "map-hostname-to-worker"}


class OperationLog(FileSource):
    """Event records in the logs of Giraph (times in ms) and PowerGraph (in ns): file, line, timestamp in ns, event (START, END or SINGLE), tags.

    A line without a time or with another event raises an error; lines that are no records are passed over.
    """

    from_name = ("file",)

    @classmethod
    def name(cls) -> str:
        return "operation_log"

    def schema(self) -> str:
        return "file string, line long, timestamp long, event string, tags map<string,string>"

    def named(self, name: str) -> dict | None:
        return {"file": name}

    def rows(self, path, named, stream):
        import io

        dialect = self.options.get("dialect", "giraph").lower()
        operation, placed, names, unit = DIALECTS[dialect]
        operation, placed = re.compile(operation), re.compile(placed)
        for k, text in enumerate(io.TextIOWrapper(stream, "utf-8", "replace")):
            if found := operation.search(text.rstrip("\r\n")):
                tags = {key.strip(): value.strip() for key, _, value in (pair.partition("=") for pair in found[1].split(","))}
                if "time" not in tags or tags.get("event") not in ("start", "end", "single"):
                    raise ValueError(f"{path}, line {k + 1}: an operation needs a time and an event (start, end or single)")
                yield named["file"], k, int(tags.pop("time")) * unit, tags.pop("event").upper(), tags
            elif found := placed.search(text):
                yield named["file"], k, 0, "SINGLE", {"type": PLACED[dialect], **dict(zip(names, found.groups()))}


SOURCES = (MonitorTrace, OperationLog)


def register(spark: SparkSession) -> None:
    """Make the sources known by name, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
