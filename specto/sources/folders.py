"""Source trees as a data source that looks into no folder which it skips, in batch and as a stream of changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .catalogs import SKIPPED
from .python_path import importable

ENDINGS = (".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
SCHEMA = "file string, text string, error string"


@dataclass
class Folder(InputPartition):
    """A folder below the root, and the times (in ns, after, up to) between which its files were changed."""

    path: str
    after: int
    until: int


class Tree:
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.depth = options["path"], int(options.get("maxDepth", 3))
        self.strict = options.get("strict", "true").lower() == "true"

    def opened(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def folders(self) -> list[tuple[str, list[fs.FileInfo]]]:
        """The folders that hold source files, and those; skipped ones and those too deep aren't listed."""
        system, level = (x := self.opened())[0], [x[1]]
        found = []
        for depth in range(self.depth):
            below = []
            for path in level:
                entries = system.get_file_info(fs.FileSelector(path))
                below += [e.path for e in entries if e.type == fs.FileType.Directory and e.base_name not in SKIPPED]
                if files := [e for e in entries if e.type == fs.FileType.File and e.base_name.endswith(ENDINGS)]:
                    found.append((path, files))
            level = below
        return found

    def split(self, after: int, until: int) -> list[Folder]:
        return [Folder(path, after, until) for path, files in self.folders() if any(after < f.mtime_ns <= until for f in files)]

    def rows(self, folder: Folder) -> Iterator[tuple[str, str | None, str | None]]:
        system, base = self.opened()
        for f in system.get_file_info(fs.FileSelector(folder.path, allow_not_found=True)):
            if f.type != fs.FileType.File or not f.base_name.endswith(ENDINGS) or not folder.after < f.mtime_ns <= folder.until:
                continue
            name = f.path[len(base) + 1 :]
            try:
                with system.open_input_stream(f.path) as stream:
                    data = stream.read()
                yield name, data.decode("utf-8", "strict" if self.strict else "replace"), None
            except UnicodeDecodeError:
                yield name, None, "not UTF-8"
            except OSError as e:
                yield name, None, type(e).__name__


LAST = (1 << 63) - 1


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def partitions(self) -> list[Folder]:
        return self.tree.split(-1, LAST)

    def read(self, partition: Folder) -> Iterator[tuple]:
        # an empty tree has no folder: Spark then reads with no partition at all
        return self.tree.rows(partition) if partition is not None else iter(())


class TreeStream(DataSourceStreamReader):
    def __init__(self, tree: Tree) -> None:
        self.tree = tree

    def initialOffset(self) -> dict[str, int]:
        return {"changed": -1}

    def latestOffset(self) -> dict[str, int]:
        return {"changed": max((f.mtime_ns for _, files in self.tree.folders() for f in files), default=-1)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Folder]:
        return self.tree.split(start["changed"], end["changed"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.tree.rows(partition)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(Tree(dict(self.options)))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Tree(dict(self.options)))


def _named(spark: SparkSession, reader, max_depth: int, strict: bool):
    importable(spark)
    spark.dataSource.register(SourceTree)
    return reader.format("source_tree").option("maxDepth", max_depth).option("strict", strict)


def read_tree(spark: SparkSession, root: str, max_depth: int = 3, strict: bool = True) -> DataFrame:
    """The rows of catalogs.read_sources() and those of empty files, which Spark's own reader passes over; a task a folder. `root` is a path or a URI that pyarrow knows (file, hdfs, s3, gs).

    The driver lists the folders that aren't skipped and less than `max_depth` deep, and keeps no file. A file that can't
    be read, or in strict mode isn't UTF-8, is an error row; one that is gone by then gives no row.
    """
    return _named(spark, spark.read, max_depth, strict).load(root)


def stream_tree(spark: SparkSession, root: str, max_depth: int = 3, strict: bool = True) -> DataFrame:
    """The same as a stream: first all files, then each file whose time of change is later than all that were read before.

    A file that comes later with an older time (a copy that keeps times) isn't seen; the batch reader sees it. A batch
    that is replayed reads what the files hold then; a file changed since belongs to a later batch.
    """
    return _named(spark, spark.readStream, max_depth, strict).load(root)
