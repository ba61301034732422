"""Writing rows as files, all of them or none.

``df.write.format("corpus_files").mode("append").save(root)`` takes rows (path, text). Every
task stages its files in a folder of its own; the commit of the job is one small file that
names the folders of the tasks that count, so retried, speculative and lost tasks leave
nothing behind. ``publish`` then moves the staged files into place as a Spark job: a redo
of the log, which can be stopped and run again at any point.

Roots are paths or URIs of file systems that Arrow opens (shared local, HDFS, S3, GCS).
"""

from __future__ import annotations

import os
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG, COMMIT = ".corpus_log", "COMMIT"


def opened(root: str):
    """The file system of a root, and the root's path on it."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(root)
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def exists(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def inside(path: str | None) -> str:
    """A path that stays below the root and out of the log; others raise."""
    parts = (path or "").split("/")
    if not all(parts) or any(p in (".", "..") for p in parts) or parts[0] == LOG:
        raise ValueError(f"no relative path of a file: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n_files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # transactions sort by their begin

    def log(self):
        store, root = opened(self.root)
        return store, f"{root}/{LOG}/{self.name}"

    def write(self, iterator: Iterator) -> Staged:
        store, log = self.log()
        folder, n_files, made = uuid.uuid4().hex, 0, set()
        try:
            for row in iterator:
                target = f"{log}/{folder}/{inside(row['path'])}"
                if exists(store, target):
                    raise ValueError(f"more than one row for {row['path']}")
                parent = os.path.dirname(target)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write((row["text"] or "").encode())
                n_files += 1
        except BaseException:
            if exists(store, f"{log}/{folder}"):
                store.delete_dir(f"{log}/{folder}")
            raise
        return Staged(folder, n_files)

    def commit(self, messages: list[Staged | None]) -> None:
        """One line a task; the move of the finished list is the moment that counts."""
        store, log = self.log()
        store.create_dir(log, recursive=True)
        with store.open_output_stream(f"{log}/{COMMIT}.part") as out:
            out.write("".join(f"{m.folder} {m.n_files}\n" for m in messages if m and m.n_files).encode())
        store.move(f"{log}/{COMMIT}.part", f"{log}/{COMMIT}")

    def abort(self, messages: list[Staged | None]) -> None:
        store, log = self.log()
        if exists(store, log):
            store.delete_dir(log)


class FilesSink(DataSource):
    """Option: path. Only mode append, which replaces files of the same path, is offered."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        return FilesWriter(self.options)


def move_staged(root: str, name: str):
    """Moves the files of staged folders into place; what was moved before is passed over."""

    def run(batches):
        from pyarrow import fs

        store, base = opened(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                top, made = f"{base}/{LOG}/{name}/{folder}", set()
                for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                    if info.type != fs.FileType.File:
                        continue
                    target = base + info.path[len(top) :]
                    parent = os.path.dirname(target)
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    try:
                        store.move(info.path, target)
                    except FileNotFoundError:
                        if not exists(store, target):  # else another attempt of this task moved it
                            raise
            yield batch

    return run


def publish(spark: SparkSession, root: str) -> int:
    """Moves the files of all committed transactions into place, oldest first, a task a
    staged folder; the number of files. The driver reads a line a task, no file names."""
    from pyarrow import fs

    store, base = opened(root)
    n_files = 0
    found = store.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True))
    for log in sorted(i.path for i in found if i.type == fs.FileType.Directory):
        if not exists(store, f"{log}/{COMMIT}"):
            continue  # being written, or left by a driver that was lost before the commit
        with store.open_input_stream(f"{log}/{COMMIT}") as lines:
            staged = [line.split() for line in lines.read().decode().splitlines()]
        if staged:
            folders = spark.createDataFrame([(f,) for f, _ in staged], "folder string").repartition(len(staged))
            folders.mapInArrow(move_staged(root, os.path.basename(log)), "folder string").count()
        store.delete_dir(log)
        n_files += sum(int(n) for _, n in staged)
    return n_files


def write_files(files: DataFrame, root: str) -> int:
    """files(path, text) below ``root``, all or none; the number of files written.

    Files of the same path are replaced, others stay. A null text makes an empty file. Paths
    that are null, empty, absolute or climb, and repeated paths, fail the job, which then
    leaves nothing; rows of one path meet in one task, so a repeat is always seen. A path
    that is a folder of another one fails when published and stays in the log. What an
    earlier writer committed and did not publish is published first."""
    spark = files.sparkSession
    spark.dataSource.register(FilesSink)
    publish(spark, root)
    files.select("path", "text").repartition("path").write.format("corpus_files").mode("append").save(root)
    return publish(spark, root)
