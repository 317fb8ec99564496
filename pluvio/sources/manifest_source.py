"""Manifests of frames as a data source of Spark, for batches and streams: ``format("pluvio_manifest")``.

Each file of a folder (and its subfolders) is a partition, so that files are read where there is room.
A stream numbers the files as they appear: what a poll finds is written to a log beside its checkpoint,
one entry a poll, and an offset is the number of entries. After a restart the same offsets stand for the
same files, so each file counts once, in whatever order names and times lie. A file that is not a
manifest gives one row that says so, and never stops the others.

Options: ``path``, ``pattern`` of file names (default ``*``), ``log`` (streams: the folder of the log).
Folders are those of any file system that pyarrow knows by its address."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "pluvio_manifest"
SCHEMA = "manifest string, kind string, place int, epoch long, path string, error string"
KINDS = ("past", "nowcast")


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def listed(address: str, pattern: str) -> list[str]:
    """Files of a folder, those of hidden names and folders left out."""
    system, root = _opened(address)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        inside = f.path[len(root.rstrip("/")) :].strip("/").split("/")
        if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in inside) and fnmatch.fnmatch(inside[-1], pattern):
            out.append(f.path)
    return sorted(out)


def rows_of(name: str, data: bytes) -> Iterator[tuple]:
    """The frames that a manifest names: those of the past, then those of the nowcast."""
    try:
        radar = json.loads(data)["radar"]
        frames = [(kind, i, int(f["time"]), str(f["path"])) for kind in KINDS for i, f in enumerate(radar.get(kind) or [])]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        yield name, None, None, None, None, f"{type(e).__name__}: {e}"[:200]
        return
    for frame in frames:
        yield name, *frame, None


class File(InputPartition):
    def __init__(self, address: str, name: str) -> None:
        super().__init__(name)
        self.address, self.name = address, name


class _Reader:
    def __init__(self, options: dict[str, str]) -> None:
        self.address, self.pattern = options["path"], options.get("pattern", "*")

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        system, _ = _opened(partition.address)
        try:
            with system.open_input_stream(partition.name) as f:
                data = f.read()
        except FileNotFoundError as e:
            yield partition.name, None, None, None, None, f"FileNotFoundError: {e}"[:200]
            return
        yield from rows_of(partition.name, data)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(self.address, x) for x in listed(self.address, self.pattern)]


class StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.system, self.log = _opened(options["log"])
        self.known: set[str] | None = None
        self.entries = 0

    def _entry(self, k: int) -> list[str]:
        with self.system.open_input_stream(f"{self.log}/{k:09d}.json") as f:
            return json.loads(f.read())

    def _restore(self) -> None:
        self.system.create_dir(self.log, recursive=True)
        names = [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.log)) if f.base_name.endswith(".json")]
        self.entries = len(names)
        self.known = {x for k in range(self.entries) for x in self._entry(k)}

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        if self.known is None:
            self._restore()
        new = [x for x in listed(self.address, self.pattern) if x not in self.known]
        if new:
            name = f"{self.log}/{self.entries:09d}.json"
            with self.system.open_output_stream(f"{name}.part") as f:
                f.write(json.dumps(new).encode())
            self.system.move(f"{name}.part", name)  # an entry is there whole or not at all
            self.known.update(new)
            self.entries += 1
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(self.address, x) for k in range(start["entries"], end["entries"]) for x in self._entry(k)]

    def commit(self, end: dict) -> None:
        """The log stays: a restart may ask for any offset that a checkpoint holds."""


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: object) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """From now on ``spark.read`` and ``spark.readStream`` know the format."""
    spark.dataSource.register(ManifestSource)
