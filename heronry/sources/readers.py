"""Series files and span logs as data sources of Spark: ``spark.read.format("series_files")``, ``spark.readStream.format("span_log")``.

Tasks read files through the file system that the path's scheme names (local and mounted folders, HDFS, object stores);
listing and sizes are all that the driver asks for.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from heronry.sources.files import FILENAME, SPAN_SCHEMA

#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20
#: Rows that go to Spark at once.
ROWS = 100_000


_NAME = re.compile(FILENAME)


def parse_name(name: str) -> dict | None:
    """What a file's name says, as :func:`heronry.sources.files.parse_filename`; None where it doesn't follow the form."""
    m = _NAME.match(name)
    if not m:
        return None
    variant = next((v for v in ("DISTORTED", "NOISE") if m[3].startswith(v)), "plain")
    return {"num": int(m[1]), "train_end": int(m[4]), "begin": int(m[5]), "end": int(m[6]), "variant": variant, "base_name": m[3].removeprefix(variant)}


def _name_of(path: str) -> str:
    """A series' file name: what a folder ``filename=...`` says, as the library's own sink leaves it, or the path's last part."""
    *_, folder, name = ["", *path.split("/")]
    return folder.removeprefix("filename=") if folder.startswith("filename=") else name


def _listed(path: str, suffix: str | tuple[str, ...]) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder with that suffix, by name."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}" if path.startswith("/") else path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted((f for f in infos if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _opened(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0]


# --- series files


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.strict = options.get("strict", "true").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on what a file's name says choose files; others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("num", "variant", "base_name", "train_end", "filename"):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def chosen(self) -> list[fs.FileInfo]:
        out = []
        for info in _listed(self.path, ".txt")[1]:
            name = _name_of(info.path)
            meta = {**(parse_name(name) or {}), "filename": name}
            if all(meta.get(c) is not None and _TESTS[t](meta[c], v) for c, t, v in self.tests):
                out.append(info)
        return out

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their names, as many to a task as have its bytes; a large file is a task of its own."""
        out, paths, size = [], [], 0
        for info in self.chosen():
            if paths and size + info.size > self.task_bytes:
                out.append(_Files(tuple(paths)))
                paths, size = [], 0
            paths.append(info.path)
            size += info.size
        return [*out, _Files(tuple(paths))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system = _opened(self.path)
        for path in partition.paths:
            name = _name_of(path)
            meta = parse_name(name) or {}
            with system.open_input_stream(path) as f:
                tokens = f.read().split()
            try:
                values = [float(t) for t in tokens]
            except ValueError:
                if self.strict:
                    raise ValueError(f"{name} holds what is no number") from None
                continue
            for first in range(0, len(values), ROWS):
                x = values[first : first + ROWS]
                n = len(x)
                same = lambda v, t, n=n: pa.array([v] * n, t)
                yield pa.RecordBatch.from_arrays(
                    [same(name, pa.string()), same(meta.get("num"), pa.int64()), same(meta.get("variant"), pa.string()), same(meta.get("base_name"), pa.string()), same(meta.get("train_end"), pa.int64()), same(meta.get("begin"), pa.int64()), same(meta.get("end"), pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(x, pa.float64())],
                    names=["filename", "num", "variant", "base_name", "train_end", "begin", "end", "idx", "x"],
                )


class SeriesFiles(DataSource):
    """``series_files``: a row a point of every ``.txt`` file below the path, with what the file's name says.

    Options: ``strict`` (a file with a token that is no number is an error, or left out), ``taskBytes``. A file whose name
    doesn't follow the form has nulls for its parts. Conditions on num, variant, base_name, train_end and filename are
    applied to the file list when ``spark.sql.python.filterPushdown.enabled`` is set, which :func:`register` does.
    """

    @classmethod
    def name(cls) -> str:
        return "series_files"

    def schema(self) -> str:
        return "filename string, num long, variant string, base_name string, train_end long, begin long, end long, idx long, x double"

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader({k.lower(): v for k, v in self.options.items()})


# --- span logs


@dataclass
class _Stretch(InputPartition):
    path: str
    first: int
    last: int


class _SpanReader(DataSourceStreamReader):
    """Offsets name a file and the bytes read of it; files before it in the order of names are read to their ends.

    A log is appended to, and its files' names grow, so one file and one number say what was read.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def _complete(self, system: fs.FileSystem, info: fs.FileInfo) -> int:
        """Bytes up to the last line's end: a line that is being written is left for later."""
        with system.open_input_file(info.path) as f:
            end = info.size
            while end:
                begin = max(0, end - (1 << 16))
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def latestOffset(self) -> dict:
        system, files = _listed(self.path, (".json", ".jsonl"))
        return {"file": files[-1].path, "bytes": self._complete(system, files[-1])} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, files = _listed(self.path, (".json", ".jsonl"))
        out = []
        for info in files:
            if start["file"] <= info.path <= end["file"]:
                first = start["bytes"] if info.path == start["file"] else 0
                last = end["bytes"] if info.path == end["file"] else info.size
                out += [_Stretch(info.path, a, min(a + self.task_bytes, last)) for a in range(first, last, self.task_bytes)]
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the stretch."""
        lines: list[str] = []
        with io.BufferedReader(_opened(self.path).open_input_file(partition.path), 1 << 20) as f:
            at = partition.first
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":  # a line of the stretch before goes on
                    at += len(f.readline())
            f.seek(at)
            while at < partition.last:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                if line.strip():
                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(lines) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path.rsplit("/", 1)[-1]] * len(lines)), pa.array(lines)], names=["file", "line"])
                    lines = []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path.rsplit("/", 1)[-1]] * len(lines)), pa.array(lines)], names=["file", "line"])


class _SpanBatch(DataSourceReader):
    """All complete lines there are."""

    def __init__(self, options: dict) -> None:
        self.stream = _SpanReader(options)

    def partitions(self) -> list[InputPartition]:
        found = self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())
        return found or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.stream.read(partition)


class SpanLog(DataSource):
    """``span_log``: the lines (file, line) of the ``.json`` and ``.jsonl`` files below the path, as a table or as a stream.

    Lines are JSON; :func:`spans` takes them apart. A line without its end isn't read yet. Large files are cut between
    tasks of ``taskBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "span_log"

    def schema(self) -> str:
        return "file string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _SpanBatch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SpanReader({k.lower(): v for k, v in self.options.items()})


def spans(lines: DataFrame) -> DataFrame:
    """The spans of a log's lines; a line that is no JSON is an error when it is read."""
    return lines.select(F.from_json("line", SPAN_SCHEMA, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let conditions reach them."""
    spark.dataSource.register(SeriesFiles)
    spark.dataSource.register(SpanLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
