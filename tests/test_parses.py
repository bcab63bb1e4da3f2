"""The index of parses: what it parses, and that it says what a direct parse says."""

import pytest
from pyspark.sql import functions as F

from specto.functions.tokens import pieces
from specto.operators import code, parses
from specto.plans.catalogue import QUERIES

BODY = "import os\nLIMIT = 1\ndef f(x):\n    return os.path.join(x, g(x), LIMIT)\ndef g(y):\n    open(y, 'w')\n"
TEXTS = [("a.py", BODY), ("copy/a.py", BODY), ("b.js", "const A = 1;\nfunction f(x) { return f(x); }\n"), ("broken.py", "def broken(:"), ("none.py", None), ("deep.py", "x = " + "(" * 300 + ")" * 300), ("b.py", "const A = 1;")]


def files(spark, texts):
    return spark.createDataFrame(texts, "file string, text string")


def contents(spark, folder):
    rows = spark.read.parquet(folder)
    assert rows.count() == rows.select("hash").distinct().count()
    return rows.count()


def test_only_new_contents_are_parsed(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = {r.file: r for r in parses.indexed(files(spark, TEXTS), folder).collect()}
    assert set(first) == {f for f, _ in TEXTS}
    assert contents(spark, folder) == 6  # a.py and its copy are one
    assert first["a.py"].functions == first["copy/a.py"].functions and first["none.py"].error is None
    assert first["broken.py"].error.startswith("SyntaxError") and first["b.py"].error and first["b.js"].error is None
    changed = [("a.py", BODY + "def h(): pass\n"), *TEXTS[1:]]
    second = {r.file: [f.name for f in r.functions or []] for r in parses.indexed(files(spark, changed), folder).collect()}
    assert second["a.py"] == ["f", "g", "h"] and second["copy/a.py"] == ["f", "g"]
    assert contents(spark, folder) == 7
    written = {p.name for p in (tmp_path / "index").iterdir()}
    parses.indexed(files(spark, changed), folder).collect()
    assert {p.name for p in (tmp_path / "index").iterdir()} == written  # nothing new, nothing written


def test_unreadable_files_keep_their_error(spark, tmp_path):
    rows = files(spark, TEXTS).withColumn("error", F.when(F.col("file") == "a.py", "not UTF-8"))
    found = {r.file: r for r in parses.indexed(rows, str(tmp_path / "index")).collect()}
    assert found["a.py"].error == "not UTF-8" and found["copy/a.py"].error is None
    assert parses.indexed(files(spark, TEXTS).limit(0), str(tmp_path / "none")).count() == 0


def test_index_says_what_a_parse_says(spark, tmp_path):
    rows = files(spark, TEXTS)
    index = parses.indexed(rows, str(tmp_path / "index"))
    direct = code.modules(rows)
    for ask in (code.call_edges, code.dependencies, code.security_surface, code.security_summary, code.clean_files, code.risk_histogram, code.repo_totals, code.flat_contract, code.contract_json):
        assert sorted(map(str, ask(index).collect())) == sorted(map(str, ask(direct).collect())), ask.__name__
    assert sorted(map(str, index.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))
    short = code.compressed(rows)
    assert sorted(map(str, index.select("file", "compressed").collect())) == sorted(map(str, short.select("file", "compressed").collect()))
    assert sorted(map(str, code.health(rows, direct, short, pieces).collect())) == sorted(map(str, code.language_sums(index, pieces).collect()))
    outlines = {r.file: (r.imports, r.classes, r.functions) for r in code.outlines(rows).collect()}
    assert {r.file: tuple(r.outline) if r.outline else (None, None, None) for r in index.collect()} == outlines


@pytest.mark.parametrize("name", ["internal_calls", "dep_classify", "status_lines", "code_expand", "risk_surface", "code_costs"])
def test_plans_read_the_index(spark, name):
    """No query parses in its own plan, and a question about one file's row shuffles nothing for it."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "parses-" in plan


def test_sources_are_cut_by_bytes():
    text = "é = 1\r\ndef f():\r\n    'ü'; return '😀'\rclass K:\n    def g(self): return 'é'\n"
    module = code.Module(text)
    import ast

    for n in module.every:
        if isinstance(n, (*code.Def, ast.ClassDef)):
            assert code.Source(text).of(n) == ast.get_source_segment(text, n)


def test_versions_of_a_tree(spark, tmp_path):
    old = [("a.py", "def same(x):\n    return x\ndef body(x):\n    return 1\ndef head(x):\n    return 2\ndef gone(x):\n    return 3\ndef old_name(x):\n    return x * 7\nclass K:\n    def m(self): return 1\n    def m(self): return 2\n"), ("b.py", "def walks(x):\n    return x ** 9\n"), ("bad.py", "def f(:")]
    new = [("a.py", "# a comment\ndef same( x ):\n    'Says so.'\n    return (x)\ndef body(x):\n    return 10\ndef head(x, y):\n    return 2\ndef new_name(x):\n    return x * 7\ndef fresh(): pass\nclass K:\n    def m(self): return 1\n    def m(self): return 4\n"), ("c.py", "def walks(x):\n    return x ** 9\n"), ("bad.py", "def f(): pass")]
    got = sorted(((r.file, r.name, r.change, r.was) for r in code.tree_diff(code.modules(files(spark, old)), code.modules(files(spark, new))).collect()), key=str)
    want = [("a.py", "same", "unchanged", None), ("a.py", "body", "body_only", None), ("a.py", "head", "breaking", None), ("a.py", "gone", "removed", None), ("a.py", "new_name", "renamed", "old_name"), ("a.py", "fresh", "added", None), ("a.py", "m", "unchanged", None), ("a.py", "m", "body_only", None), ("c.py", "walks", "moved", "b.py"), ("bad.py", "f", "added", None)]
    assert got == sorted(want, key=str)
    index = str(tmp_path / "index")
    parses.indexed(files(spark, old), index)
    again = code.tree_diff(*parses.versions(files(spark, old), files(spark, new), folder=index))
    assert sorted(((r.file, r.name, r.change, r.was) for r in again.collect()), key=str) == got
    none = files(spark, old).limit(0)
    assert {r.change for r in code.tree_diff(code.modules(none), code.modules(files(spark, new))).collect()} == {"added"}


HARD = [
    "x = 1\\\ndef f(): pass\n", 'x = """\ndef f(): pass\n"""\ndef g(): pass\n', "'''\ndef f():\n'''\n", "f'''{\ndef f(): pass\n}'''", "x = (\ndef f(): pass\n", "def f(): '''\ndef g(): '''\n",
    "if x:\n  1\ndef f(): pass\nelse:\n 2\n", "try:\n pass\ndef f(): pass\n", "from __future__ import barry_as_FLUFL\ndef f(): return 1 <> 2\n", "def f(): pass\ndef f(x): pass\ndef f(): pass\n", "", "def f(): pass\n\x00",
    "@a\n@b(\n1)\nasync def f(x):\n  yield 1\n@c\nclass K: pass\nX = f(3); Y: int = 4\n", "class A:\n def f(self): return self.x\n class B:\n  def g(self): pass\nimport a.b, c\ndef h():\n import d\n def k(): raise E(1)\n",
    "'''Doc\n'''\r\ndef f(x): return g(x)\r\n# a\rdef g(x): return X\r\nclass K(f):\r\n  y = 1\r\n  def g(self): open(x)\r\nX = 1\r\n",
]


def test_pieces_say_what_the_whole_says():
    for text in HARD:
        try:
            module = code.Module(text)
            want = module.found() | {"error": None, "outline": code.outlined(module.every), "compressed": module.compress()}
        except code.TROUBLE as e:
            want = {"error": code.message(e)}
        assert parses.analyse(text, "python") == want, text


def test_a_definition_of_many_files_is_read_once():
    code.Piece.known.cache_clear()
    shared = "class Shared:\n    def m(self, x):\n        return other(x)\n"
    for i in range(50):
        found = parses.analyse(f"N = {i}\n" + "\n" * i + shared + f"def own_{i}(x): return N\n", "python")
        assert [(f["name"], f["line"]) for f in found["functions"]] == [(f"own_{i}", i + 5), ("m", i + 3)]
    assert code.Piece.known.cache_info().misses == 51


def test_the_index_is_not_broadcast(spark, tmp_path):
    """However small its files are: what they hold grows with the tree, and would go through the driver."""
    own = parses.indexed(files(spark, TEXTS), str(tmp_path / "index"))
    assert "BroadcastHashJoin" not in code.clean_files(own)._jdf.queryExecution().toString()
