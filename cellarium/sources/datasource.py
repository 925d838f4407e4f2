"""Data sources: `spreadsheet` reads folders of packages in one pass and writes packages; `package_arrivals` is a stream of new ones.

    register(spark)
    rows = spark.read.format("spreadsheet").load("/data")          # the rows of book_rows()
    cells = cells_of_books(stored(rows))
    packages.write.format("spreadsheet").mode("append").save("/out")  # path, content
    arriving = spark.readStream.format("package_arrivals").option("maxFilesPerBatch", "100").load("/in")
    contents(arriving)                                             # path, content, read by the tasks of the batch

Tasks open files themselves, by pyarrow's file systems, so a path is a folder that all executors see or a URI that pyarrow knows. For
any other store use packages(), which reads through Spark.
"""

from __future__ import annotations

import fnmatch
import os
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from cellarium.sources.books import BOOK, archive_rows
from cellarium.sources.packages import ENTRY, LIMITS, entry_rows
from cellarium.sources.sheets import arrow_schema

#: Bytes of packages that one task reads, unless the option bytesPerPartition says otherwise: a share of all by this number of tasks, within
#: bounds. A package is parsed by Python and grows tenfold, so a megabyte is some seconds of work.
PARTITION_BYTES, LEAST_BYTES, TASKS = 64 << 20, 1 << 20, 256
_PACKAGE = "path string, content binary"


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _listed(path: str, pattern: str) -> list[pafs.FileInfo]:
    """The files of a folder and those below it, or one file, in order of their paths; names with a dot or underscore in front are hidden."""
    system, base = _system(path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [info]
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f.path) and fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _values(f: Filter, column: str) -> set | None:
    """The values that a filter leaves of a column; None if it says nothing of it."""
    if getattr(f, "attribute", None) != (column,):
        return None
    return {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None


class SpreadsheetReader(DataSourceReader):
    """Reads packages: files dealt to tasks by bytes, filters on path, part and kind before anything is inflated or parsed."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*")
        self.bytes = int(options["bytesperpartition"]) if "bytesperpartition" in options else None
        self.limits = LIMITS | {k: int(options[f"limit_{k}"]) for k in LIMITS if f"limit_{k}" in options}
        self.columns = schema.names
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            for column in ("path", "part", "kind"):
                if (values := _values(f, column)) is not None:
                    self.only[column] = self.only.get(column, values) & values
            yield f  # Spark checks them again: a file system may spell paths in another way

    def partitions(self) -> Sequence[InputPartition]:
        files = [f for f in _listed(self.path, self.pattern) if "path" not in self.only or f.path in self.only["path"]]
        most = self.bytes if self.bytes is not None else min(PARTITION_BYTES, max(LEAST_BYTES, sum(f.size for f in files) // TASKS))
        out, size = [_Files([])], 0
        for f in files:
            if out[-1].paths and size + f.size > most:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read(self.limits["input"] + 1)  # one byte too many is refused
            for batch in archive_rows(path, content, self.limits, self.only.get("part"), self.only.get("kind")):
                yield batch.select(self.columns)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SpreadsheetWriter(DataSourceWriter):
    """Writes packages (path, content) as files. Each task writes to a hidden folder; only when all have ended do files get their names.

    A task that still runs when a write is given up may leave its hidden folder, which readers pass over.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.suffix = options["path"], overwrite, options.get("suffix", ".xlsx")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = _system(self.path)
        attempt, files = f"{base}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(attempt, recursive=True)
        for n, row in enumerate(iterator):
            name = row["path"].rstrip("/").rpartition("/")[2]
            name += "" if name.endswith(self.suffix) else self.suffix
            with system.open_output_stream(f"{attempt}/{n}") as out:
                out.write(bytes(row["content"]))
            files.append((f"{attempt}/{n}", name))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two packages have one name")
        if self.overwrite:
            for f in _listed(self.path, "*"):
                if f.base_name not in set(names):
                    system.delete_file(f.path)
        for staged, name in files:
            system.move(staged, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _system(self.path)
        if system.get_file_info(f"{base}/{self.staging}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


class SpreadsheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> str:
        return BOOK

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpreadsheetReader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SpreadsheetWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


class ArrivalsReader(SimpleDataSourceStreamReader):
    """Names of new files, so many in a batch at most, in the order in which they came; an offset is the time and name of the last one.

    Files should come under a hidden name and be renamed when they are whole, as SpreadsheetWriter does. A listing serves further batches
    while no folder has changed since, where the file system says when that was, and until it has nothing new.
    """

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*")
        self.most = int(options.get("maxfilesperbatch", 1000))
        self.files: list[pafs.FileInfo] = []
        self.places: list[tuple[int, str]] = []
        self.folders: dict[str, int | None] = {}

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[pafs.FileInfo]:
        place = lambda f: (f.mtime_ns, f.path)
        first, last = (start["time"], start["path"]), end and (end["time"], end["path"])
        return sorted((f for f in _listed(self.path, self.pattern) if place(f) > first and (last is None or place(f) <= last)), key=place)

    def _changed(self, folders: Iterable[str]) -> dict[str, int | None]:
        return {f.path: f.mtime_ns for f in _system(self.path)[0].get_file_info(sorted(folders))}

    def _next(self, start: dict) -> list[pafs.FileInfo]:
        """The first files after an offset."""
        place = (start["time"], start["path"])
        at = bisect_right(self.places, place)
        if at == len(self.places) or not self.folders or self._changed(self.folders) != self.folders:
            system, base = _system(self.path)
            now = time.time_ns()
            below = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
            folders = self._changed({base, *(f.path for f in below if f.type == pafs.FileType.Directory)})
            # A folder that changed just now may change again within the same tick of its clock.
            self.folders = folders if all(t and t + 1_000_000_000 < now for t in folders.values()) else {}
            self.files = self._between({"time": -1, "path": ""}, None)
            self.places = [(f.mtime_ns, f.path) for f in self.files]
            at = bisect_right(self.places, place)
        return self.files[at : at + self.most]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self._next(start)
        return iter([(f.path, f.size) for f in new]), {"time": new[-1].mtime_ns, "path": new[-1].path} if new else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(f.path, f.size) for f in self._between(start, end)])


class ArrivalsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_arrivals"

    def schema(self) -> str:
        return "path string, length long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ArrivalsReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, which may then push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpreadsheetSource)
    spark.dataSource.register(ArrivalsSource)


def contents(files: DataFrame, folder: str = "") -> DataFrame:
    """path and content of files (path), read where the rows are; null for a file that is gone. folder says what file system they are of."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _read_files(batches, folder):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(read, _PACKAGE)


def file_entries(files: DataFrame, folder: str = "") -> DataFrame:
    """entries(contents(files)) in one pass: what is in a file does not leave the task that reads it."""
    schema = arrow_schema(ENTRY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _read_files(batches, folder):
            yield pa.RecordBatch.from_pylist(entry_rows(path, content, LIMITS), schema)

    return files.select("path").mapInArrow(read, ENTRY)


def _read_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, bytes | None]]:
    system = _system(folder)[0] if folder else pafs.LocalFileSystem()
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            except FileNotFoundError:
                content = None
            yield path, content
