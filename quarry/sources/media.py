"""Source ``quarry_media``: files of a folder, dealt to tasks by bytes, in batches or as a stream that sees changed files.

Spark's own file sources leave out empty files, split work by the order of names, and never read a file again that
has changed under its name. This one lists with ``pyarrow.fs``: local folders and mounts, and what else that can open.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Bytes of files that one task reads, and what a file costs besides.
TASK_BYTES, FILE_BYTES = 128 << 20, 64 << 10
#: Seconds that a file must have been left alone before a stream takes it.
SETTLE = 2.0
SCHEMA = "path string, name string, ext string, length bigint, modificationTime timestamp"


def ending(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


@dataclass
class Share(InputPartition):
    """The files of one task: path, bytes, time of change in microseconds."""

    files: list[tuple[str, int, int]]


def listed(folder: str, endings: frozenset[str] | None, recursive: bool) -> list[tuple[str, int, int]]:
    """The files of a folder, in order of their paths, with such an ending in any case; hidden ones and those below hidden folders stay out."""
    system, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=recursive))
    shown = lambda path: not any(p[:1] in "._" for p in path[len(root) :].strip("/").split("/"))
    rows = [(f.path, f.size, f.mtime_ns // 1000) for f in found if f.type == pyarrow.fs.FileType.File and shown(f.path)]
    return sorted(r for r in rows if endings is None or ending(r[0]) in endings)


def dealt(files: list[tuple[str, int, int]], task_bytes: int) -> list[Share]:
    """Files in shares of about ``task_bytes``, the largest first to the share that has least."""
    cost = lambda f: f[1] + FILE_BYTES
    n = max(1, -(-sum(map(cost, files)) // task_bytes))
    shares, heap = [[] for _ in range(n)], [(0, i) for i in range(n)]
    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        load, i = heapq.heappop(heap)
        shares[i].append(f)
        heapq.heappush(heap, (load + cost(f), i))
    return [Share(sorted(s)) for s in shares if s]


class _Reading:
    """What batches and streams share."""

    def __init__(self, options: dict):
        given = lambda name, default: options.get(name.lower(), options.get(name, default))
        self.folder = given("path", "").removeprefix("file://")
        names = given("endings", "")
        self.endings = frozenset(e.strip().lower() for e in names.split(",")) if names else None
        self.recursive, self.content = given("recursive", "false") == "true", given("content", "false") == "true"
        self.task_bytes, self.settle = int(given("taskBytes", TASK_BYTES)), float(given("settle", SETTLE))

    def shares(self, files: list[tuple[str, int, int]]) -> list[Share]:
        return dealt(files, self.task_bytes if self.content else self.task_bytes + sum(n for _, n, _ in files))  # a listing alone is one share of few bytes

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        """One batch a file where contents are read, so that a task holds one at a time; a file that has gone has none."""
        files = share.files
        for part in [[f] for f in files] if self.content else [files]:
            columns = [
                pa.array([p for p, *_ in part], pa.string()), pa.array([p.rsplit("/", 1)[-1] for p, *_ in part], pa.string()), pa.array([ending(p) for p, *_ in part], pa.string()),
                pa.array([n for _, n, _ in part], pa.int64()), pa.array([t for *_, t in part], pa.timestamp("us", "UTC")),
            ]
            fields = ["path", "name", "ext", "length", "modificationTime"]
            if self.content:
                columns, fields = [*columns, pa.array([self._body(part[0][0])], pa.binary())], [*fields, "content"]
            yield pa.RecordBatch.from_arrays(columns, fields)

    def _body(self, path: str) -> bytes | None:
        system = pyarrow.fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pyarrow.fs.LocalFileSystem()
        try:
            with system.open_input_stream(path) as f:
                return f.read()
        except FileNotFoundError:
            return None


class MediaReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.shares(listed(self.folder, self.endings, self.recursive)) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition) if partition.files else ()


class FilteredReader(MediaReader):
    """For sessions that let Python sources have filters; in others Spark refuses a reader that takes any."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on ``ext`` narrow the listing; all others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("ext",):
                self.endings = frozenset(values) if self.endings is None else self.endings & values
            else:
                yield f


class MediaStream(_Reading, DataSourceStreamReader):
    """Each version of a file once: an offset is a time of change, and a batch has the files changed between two of them."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        before = int((time.time() - self.settle) * 1_000_000)
        return {"changed": max((t for *_, t in listed(self.folder, self.endings, self.recursive) if t <= before), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        new = [f for f in listed(self.folder, self.endings, self.recursive) if start["changed"] < f[2] <= end["changed"]]
        return self.shares(new) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition) if partition.files else ()

    def commit(self, end: dict) -> None: ...


class Media(DataSource):
    """Options: path, endings (with commas), recursive, content, filters, taskBytes, settle (seconds, for streams)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_media"

    def schema(self) -> str:
        content = self.options.get("content", "false") == "true"
        return SCHEMA + (", content binary" if content else "")

    def reader(self, schema) -> MediaReader:
        return (FilteredReader if self.options.get("filters") == "true" else MediaReader)(dict(self.options))

    def streamReader(self, schema) -> MediaStream:
        return MediaStream(dict(self.options))


def media(spark: SparkSession, folder: str, endings: tuple[str, ...] = (), recursive: bool = False, content: bool = False, stream: bool = False, **options) -> DataFrame:
    """``(path, name, ext, length, modificationTime[, content])`` of the files in a folder, empty ones too.

    As a stream, files that change under their name come again. Filters on ``ext`` narrow the listing where the
    session lets Python sources have filters (``spark.sql.python.filterPushdown.enabled``).
    """
    spark.dataSource.register(Media)
    reader = (spark.readStream if stream else spark.read).format("quarry_media").option("endings", ",".join(endings)).option("recursive", str(recursive).lower()).option("content", str(content).lower())
    reader = reader.option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(folder)
