"""Documents as files, all at once or not at all: ``df.write.format("documentfiles")``, and the same for streams.

Two-phase commit. A task writes its rows (filename, content) to a folder of its
own attempt below a hidden folder beside the target, and tells the driver its
name. When all tasks are done the driver gathers the folders of the attempts
that told it, and puts them in place with one rename; so a job that fails, a
task that is tried again and an attempt that runs beside another leave nothing
in the target, and no file twice. Aborting removes the hidden folder.

Layout: ``target/commit-<job>/<task>/<filename>``, and ``target/batch-<n>/...``
for a stream, whose batch is skipped if its folder is there already (a stream
that starts again sends its last batch again). Overwriting sets the old target
aside before the new one takes its place. Renames need a store where a folder
can be moved; that is so on local disks and HDFS.

Defined results: no rows make an empty folder; a null or unusable name, null
content and two equal names in a task are refused, and with them the whole job
(``write_documents`` deals equal names to one task, so none gets by); other
columns are not written.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.streaming import DataStreamWriter

from docframe.ship import ship
from docframe.sources.stores import store


@dataclass
class Written(ds.WriterCommitMessage):
    """What an attempt has left, and where in the hidden folder."""

    task: str
    job: str
    attempt: str
    files: int
    bytes: int


def _there(where: fs.FileSystem, path: str) -> bool:
    return where.get_file_info(path).type != fs.FileType.NotFound


class _Staged:
    """The hidden folder beside a target, which holds a folder a job; the one that writes and the one that commits may be two objects."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str, str]:
        where, target = store(self.path)
        target = target.rstrip("/")
        return where, target, posixpath.join(posixpath.dirname(target), f"._{posixpath.basename(target)}")

    def write(self, rows: Iterator[Row]) -> Written:
        where, _, hidden = self._at()
        context = TaskContext.get()
        task, attempt = f"{context.partitionId() if context else 0:06d}", uuid4().hex
        folder, names, size = f"{hidden}/{self.job}/{attempt}", set(), 0
        where.create_dir(folder, recursive=True)
        for row in rows:
            name, content = row["filename"], row["content"]
            if not name or name.strip() in (".", "..") or any(c in name for c in "/\\\0") or name[0] in "._" or len(name.encode()) > 255:
                raise ValueError(f"{name!r} can't be the name of a file")
            if content is None:
                raise ValueError(f"{name!r} has no content")
            if name in names:
                raise ValueError(f"two documents are named {name!r}")
            names.add(name)
            data = bytes(content)
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            size += len(data)
        return Written(task, self.job, attempt, len(names), size)

    def put(self, messages: list[Written | None], name: str, overwrite: bool = False) -> None:
        """The attempts' folders as ``target/name``, by one rename."""
        where, target, hidden = self._at()
        if not _there(where, f"{target}/{name}"):  # else it was put before
            ready = f"{hidden}/{self.job}-ready"
            inner = f"{ready}/{name}" if overwrite else ready
            where.create_dir(inner, recursive=True)
            for m in messages:
                if m and m.files:
                    where.move(f"{hidden}/{m.job}/{m.attempt}", f"{inner}/{m.task}")
            if overwrite:
                if _there(where, target):
                    where.move(target, f"{hidden}/{self.job}-old")
                where.move(ready, target)
            else:
                where.create_dir(target, recursive=True)
                where.move(ready, f"{target}/{name}")
        self.drop(messages)

    def drop(self, messages: list[Written | None]) -> None:
        """What the jobs of these messages and this one have left, with all their attempts."""
        where, _, hidden = self._at()
        for job in {self.job, *(m.job for m in messages if m)}:
            for folder in (job, f"{job}-ready", f"{job}-old"):
                if _there(where, f"{hidden}/{folder}"):
                    where.delete_dir(f"{hidden}/{folder}")
        if _there(where, hidden) and not where.get_file_info(fs.FileSelector(hidden)):
            where.delete_dir(hidden)


class BatchWriter(_Staged, ds.DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        self.put(messages, f"commit-{self.job}", self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class StreamWriter(_Staged, ds.DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.put(messages, f"batch-{batchId:09d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class DocumentFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documentfiles"

    def schema(self) -> str:
        return "filename string, content binary"

    def _target(self, schema) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if kinds.get("filename") != "string" or kinds.get("content") != "binary":
            raise ValueError("documents are rows of a filename (string) and content (binary)")
        return self.options["path"]

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self._target(schema), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self._target(schema))


def register(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(DocumentFiles)
    return spark


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """(filename, content) as files; equal names meet in one task, which refuses them."""
    register(df.sparkSession)
    df.select("filename", "content").repartition("filename").write.format("documentfiles").mode(mode).save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The writer of a stream of (filename, content); each batch appears at once, and once."""
    register(df.sparkSession)
    return df.select("filename", "content").writeStream.format("documentfiles").option("path", path).option("checkpointLocation", checkpoint)
