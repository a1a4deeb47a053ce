"""Archives as a data source: members are rows, and slices of an archive are partitions.

    spark.dataSource.register(archives.ArchiveSource)
    spark.read.format("textloom_archive").option("tasks", 4).load("/shared/a.zip")

The driver reads the directory at an archive's end, and no content. Members are dealt in order to tasks of about the same
compressed size; a task seeks to its members and holds one at a time. The path may be a folder, whose .zip files are read, and any
that pyarrow opens (local, s3://, gs://, hdfs://); it must be one that all executors see.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, place long, name string, size long, content binary, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Seekable:
    """An Arrow file as zipfile wants it: a place before its start is an OSError."""

    def __init__(self, f):
        self.f, self.read, self.tell, self.seekable = f, f.read, f.tell, f.seekable

    def seek(self, place: int, whence: int = 0) -> int:
        try:
            return self.f.seek(place, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


@dataclass
class Slice(InputPartition):
    """Members first to last (last exclusive) of an archive; where its directory cannot be read, one row that says why."""

    archive: str
    first: int
    last: int
    error: str | None = None


def slices(path: str, tasks: int) -> list[Slice]:
    """At most tasks slices of an archive, about equal in compressed bytes; each member counts as one byte at least."""
    system, inner = opened(path)
    try:
        with system.open_input_file(inner) as f, zipfile.ZipFile(Seekable(f)) as z:
            sizes = [max(1, e.compress_size) for e in z.infolist()]
    except (OSError, zipfile.BadZipFile) as e:
        return [Slice(path, 0, 0, f"{type(e).__name__}: {e}")]
    out, at, done, total = [], 0, 0, sum(sizes)
    for i, size in enumerate(sizes):
        done += size
        if done * tasks >= total * (len(out) + 1):
            out.append(Slice(path, at, i + 1))
            at = i + 1
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tasks = options["path"], max(1, int(options.get("tasks", 8)))

    def partitions(self) -> list[Slice]:
        system, inner = opened(self.path)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return slices(self.path, self.tasks)
        prefix = self.path[: len(self.path) - len(inner)] if "://" in self.path else ""
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.path.lower().endswith(".zip"))
        return [s for p in found for s in slices(prefix + p, self.tasks)] or [Slice(self.path, 0, 0)]

    def read(self, part: Slice) -> Iterator[tuple]:
        if part.error:
            yield part.archive, None, None, None, None, part.error
            return
        if part.first == part.last:
            return
        system, inner = opened(part.archive)
        with system.open_input_file(inner) as f, zipfile.ZipFile(Seekable(f)) as z:
            for place, entry in list(enumerate(z.infolist()))[part.first : part.last]:
                if entry.is_dir():
                    continue
                try:
                    yield part.archive, place, entry.filename, entry.file_size, z.read(entry), None
                except (OSError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zipfile.zlib.error) as e:
                    yield part.archive, place, entry.filename, entry.file_size, None, f"{type(e).__name__}: {e}"


class ArchiveSource(DataSource):
    """Options: path (an archive, or a folder of them), tasks (slices of an archive, 8).

    Rows: archive, place (in the directory, from 0), name, size, content, error. Folders are no rows. A member that cannot be
    read, or is encrypted, is a row with its error, and an archive without a readable directory is one such row; the other rows stay.
    """

    @classmethod
    def name(cls) -> str:
        return "textloom_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
