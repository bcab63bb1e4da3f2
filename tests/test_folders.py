"""The data source of source trees, in batch and as a stream."""

import os

import pytest
from pyarrow import fs

from specto.sources import catalogs, folders


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, body in {"a.py": b"x = 1", "p/b.ts": b"y", "p/q/c.py": b"", "p/q/r/deep.py": b"z", "__pycache__/c.py": b"n", "p/node_modules/m.js": b"m", "n.txt": b"t", "p/bad.py": b"x = '\xff'"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    return root


def rows(df):
    return sorted((r.file, r.text, r.error) for r in df.collect())


@pytest.mark.parametrize("strict", [True, False])
def test_batch_is_what_the_file_reader_gives(spark, tree, strict):
    got = rows(folders.read_tree(spark, str(tree), strict=strict))
    # Spark's file reader passes over files without a byte
    assert got == sorted([("p/q/c.py", "", None), *rows(catalogs.read_sources(spark, str(tree), strict=strict).select("file", "text", "error"))])
    assert [f for f, *_ in got] == ["a.py", "p/b.ts", "p/bad.py", "p/q/c.py"]


def test_skipped_folders_are_never_listed(tree, monkeypatch):
    listed, selector = [], fs.FileSelector
    monkeypatch.setattr(folders.fs, "FileSelector", lambda path, **options: listed.append(os.path.relpath(path, tree)) or selector(path, **options))
    parts = folders.TreeReader(folders.Tree({"path": str(tree)})).partitions()
    assert sorted(listed) == [".", "p", "p/q"] and len(parts) == 3 and "p/node_modules" not in listed
    assert {f for p in parts for f, *_ in folders.Tree({"path": str(tree)}).rows(p)} == {"a.py", "p/b.ts", "p/bad.py", "p/q/c.py"}


def test_empty_tree(spark, tmp_path):
    assert rows(folders.read_tree(spark, str(tmp_path))) == []


def test_stream_reads_all_and_then_changes(spark, tree, tmp_path):
    def turn():
        query = folders.stream_tree(spark, str(tree)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return rows(spark.read.schema(folders.SCHEMA).parquet(str(tmp_path / "out")))

    first = turn()
    assert first == rows(folders.read_tree(spark, str(tree)))
    (tree / "p/b.ts").write_bytes(b"changed")
    (tree / "p/new.py").write_bytes(b"new")
    assert turn() == sorted([*first, ("p/b.ts", "changed", None), ("p/new.py", "new", None)])
