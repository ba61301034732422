"""File trees as tables.

``spark.read.format("corpus")`` lists a tree on the driver and reads files in partitions,
hidden and underscore names included, which Spark's own file sources leave out. It needs a
file system that driver and executors share; ``from_store`` reads any Hadoop file system
with the built-in source instead, without such names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        names = lambda key: {n for n in options.get(key, "").split(",") if n}
        self.root = options["path"]
        self.excluded, self.endings = names("exclude"), names("extensions")
        self.hidden = options.get("hidden", "true") == "true"
        self.content = options.get("content", "true") == "true"
        self.size = int(options.get("partitionfiles", "256"))

    def walk(self, folder: str = "") -> Iterator[str]:
        """Relative paths below a folder; excluded directories are not entered, unreadable
        ones give nothing, symbolic links are not followed."""
        try:
            entries = sorted(os.scandir(Path(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if not self.hidden and entry.name.startswith("."):
                continue
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in self.excluded:
                    yield from self.walk(path)
            elif entry.is_file(follow_symlinks=False) and (not self.endings or os.path.splitext(entry.name)[1] in self.endings):
                yield path

    def partitions(self) -> list[InputPartition]:
        found = list(self.walk())
        return [Slice(found[i : i + self.size]) for i in range(0, len(found), self.size)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for path in partition.paths:
            raw = error = None
            if self.content:
                try:
                    raw = Path(self.root, path).read_bytes()
                except OSError as e:
                    error = str(e)
            yield path, raw, None if raw is None else raw.decode("utf-8", "replace"), error


class TreeSource(DataSource):
    """Options: path, exclude, extensions (comma lists), hidden, content, partitionFiles."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, content binary, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("corpus").options(path=root, **options).load()


def from_store(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """path, content, text of all files below ``root`` on any file system Spark reads; with
    ``below``, of that file or folder of it only. A filter on path would not do: it comes
    after the reading. A file is read whole by one task."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base + below if below else root)
    return files.select(F.regexp_replace("path", r"^.*?\Q" + base.split(":", 1)[-1].lstrip("/") + r"\E", "").alias("path"), "content", F.decode("content", "UTF-8").alias("text"))
