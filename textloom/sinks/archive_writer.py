"""Results as archives, by a data source with a two-phase commit, for batches and streams.

    spark.dataSource.register(archive_writer.BundleSink)
    results.write.format("textloom_bundle").mode("append").save("/shared/out")

A task streams its rows into archives of at most per_bundle results under a hidden name, holding one row at a time. The commit
message says what it wrote and which rows failed. The commit gives the archives their names and writes the failures to
_errors; an abort deletes them. Of a stream, a batch id that was committed before leaves nothing new. The path may be any
that pyarrow opens and all executors see.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from textloom.sources.archives import opened


@dataclass
class Written(WriterCommitMessage):
    """Archives of a task under their hidden names with their counts of results, and failures as (name, error)."""

    archives: list[tuple[str, int]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


def _name(used: dict[str, int], name: str) -> str:
    """The member of a result: its last part without ending, numbered from the second of one name on."""
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    used[stem] = used.get(stem, 0) + 1
    return f"{stem}{'' if used[stem] == 1 else f'_{used[stem]}'}.md"


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.per_bundle = options["path"].rstrip("/"), max(1, int(options.get("per_bundle", 1000)))
        self.job = uuid.uuid4().hex[:12]  # made on the driver, the same in all tasks

    def write(self, rows: Iterator) -> Written:
        """Rows (name, markdown, success, error) of one task; what it wrote goes if it fails."""
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        out, at, stream, archive, used = Written(), None, None, None, {}

        def close() -> None:
            nonlocal archive, stream
            if archive is not None:
                archive.close()
                stream.close()
                out.archives.append((at, sum(used.values())))
                archive = stream = None

        try:
            for row in rows:
                if not (row["success"] and row["markdown"]):
                    out.errors.append((row["name"], row["error"] or "Conversion failed"))
                    continue
                if archive is None:
                    at, used = f"_{self.job}-{uuid.uuid4().hex}.zip.part", {}
                    stream = system.open_output_stream(f"{folder}/{at}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(_name(used, row["name"])), row["markdown"])
                if sum(used.values()) == self.per_bundle:
                    close()
            close()
        except BaseException:
            if stream is not None:
                stream.close()
                out.archives.append((at, 0))
            self._delete([out])
            raise
        return out

    def _delete(self, messages) -> None:
        system, folder = opened(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                system.delete_file(f"{folder}/{name}")

    def _publish(self, messages: list[Written], job: str) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        n = 0
        for m in messages:
            for name, _ in m.archives if m else ():
                system.move(f"{folder}/{name}", f"{folder}/bundle-{job}-{n:05d}.zip")
                n += 1
        errors = [e for m in messages if m for e in m.errors]
        if errors:
            system.create_dir(f"{folder}/_errors", recursive=True)
            with system.open_output_stream(f"{folder}/_errors/{job}.json") as f:
                for name, error in errors:
                    f.write((json.dumps({"name": name, "error": error}, ensure_ascii=False) + "\n").encode())

    def commit(self, messages: list[Written]) -> None:
        self._publish(messages, self.job)

    def abort(self, messages: list[Written]) -> None:
        """What finished tasks wrote goes, and what killed ones had begun."""
        system, folder = opened(self.path)
        for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                system.delete_file(x.path)


class BundleStreamWriter(BundleWriter, DataSourceStreamWriter):
    """Batches have names of their own; a mark in _batches, written last, says that a batch is whole."""

    def commit(self, messages: list[Written], batchId: int) -> None:  # noqa: N803  (Spark's name)
        system, folder = opened(self.path)
        mark = f"{folder}/_batches/{batchId}"
        if system.get_file_info(mark).is_file:
            self._delete(messages)
            return
        self._publish(messages, f"batch{batchId}")
        system.create_dir(f"{folder}/_batches", recursive=True)
        system.open_output_stream(mark).close()

    def abort(self, messages: list[Written], batchId: int) -> None:  # noqa: N803
        self._delete(messages)


class BundleSink(DataSource):
    """Options: path, per_bundle (1000). Rows need name, markdown, success and error; results of one name in a bundle are numbered."""

    @classmethod
    def name(cls) -> str:
        return "textloom_bundle"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("bundles are added to a folder: use mode append")
        return BundleWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> BundleStreamWriter:  # noqa: N802
        return BundleStreamWriter(self.options)
