"""Rules of the operators on small inputs of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from specto.functions import costs, text, tokens
from specto.operators import code, graphs, reports, routing, schemas, stats
from specto.sources import catalogs
from specto.streaming import stats as streaming


@pytest.mark.parametrize(
    ("schema", "short"),
    [
        ({"$ref": "#/$defs/Node", "description": "x"}, {"ref": "Node"}),
        ({"anyOf": [{"type": "string"}, {"type": "null"}], "description": "A. B."}, {"t": "string", "null": 1, "d": "A."}),
        ({"oneOf": [{"type": "string"}, {"$ref": "#/a/B"}], "discriminator": {"propertyName": "k", "mapping": {"b": "#/a/B"}}}, {"any": [{"t": "string"}, {"ref": "B"}], "disc": {"prop": "k", "map": {"b": "B"}}}),
        ({"type": "array", "items": {"type": "integer", "minimum": 0}}, {"t": "array", "of": {"t": "integer", "min": 0}}),
        ({"allOf": [{"$ref": "#/d/A"}, {"properties": {"x": {"type": "string"}}}]}, {"props": {"x": {"t": "string"}}, "t": "object", "all": [{"ref": "A"}]}),
        ({"type": "string", "format": "date", "default": None, "description": "Optional. The day. More."}, {"t": "string", "d": "The day.", "default": None, "fmt": "date"}),
    ],
)
def test_compress(schema, short):
    assert schemas.compress(schema) == short
    if "null" not in short and "all" not in short:
        assert schemas.compress(schemas.expand(short)) == short


def tools(spark, *rows):
    return spark.createDataFrame([(i, n, d, json.dumps(s)) for i, (n, d, s) in enumerate(rows)], "ord int, name string, description string, input_schema string")


def test_verdicts(spark):
    good = {"properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3, "enum": [1, 2]}}, "required": ["a"]}
    lost = {"properties": {"a": {"type": "string", "minLength": 2}}}
    dangling = {"properties": {"a": {"$ref": "#/$defs/None_"}}}
    found = {r.name: r for r in schemas.verdicts(tools(spark, ("g", "", good), ("l", "", lost), ("d", "", dangling))).collect()}
    assert found["g"].ok and found["l"].lost == ["unhandled:minLength"] and found["d"].unresolved == ["None_"]


def test_defs_and_cycles(spark):
    one = {"$defs": {"A": {"x": {"$ref": "#/$defs/B"}}, "B": {"x": {"$ref": "#/$defs/A"}}}}
    two = {"$defs": {"A": {"other": 1}, "C": {"x": {"$ref": "#/$defs/A"}}}}
    defs = schemas.shared_defs(tools(spark, ("t", "", one), ("u", "", two)))
    assert {r.name for r in defs.collect()} == {"A", "B", "C"}
    assert {r.node for r in graphs.on_cycles(schemas.ref_edges(defs)).collect()} == {"A", "B"}


def test_catalog_shapes(spark):
    tool = {"name": "t", "description": None, "inputSchema": {"type": "object"}}
    texts = [json.dumps(x) for x in ([tool], {"tools": [tool, tool]}, {"git": [tool], "note": "x", "web": [tool]})]
    rows = catalogs.catalog(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted(r.server for r in rows) == ["", "", "", "git", "web"] and all(r.description == "" for r in rows)


def test_sources(spark, tmp_path):
    for path, body in {"a.py": "x = 1", "p/b.py": "y", "p/q/r/deep.py": "z", "__pycache__/c.py": "n", "n.txt": "t"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    rows = {r.file: r for r in catalogs.read_sources(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "p/b.py", "bad.py"} and rows["bad.py"].error and rows["bad.py"].text is None


SOURCE = '''
import os, json
LIMIT = 3
class Worker:
    def run(self, n):
        """Runs it.

        At length."""
        helper(n)
        return os.path.join("a", LIMIT)
def helper(x):
    return x + 1
def risky(p):
    os.system(p)
    open(p)
def writer(p):
    open(p, "w")
    warnings.warn("x")
    raise ValueError("no")
'''


def test_code(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("broken.py", "def broken(:")], "file string, text string")
    parsed = code.modules(files)
    assert {(r.caller, r.callee) for r in code.call_edges(parsed).collect()} == {("run", "helper")}
    roles = {r.name: r for r in code.dependencies(parsed).collect()}
    assert roles["run"].role == "TOOL" and roles["run"].data == ["LIMIT"] and roles["run"].externe == ["os"] and roles["helper"].role == "PURE"
    risk = {r.name: (r.level, r.calls) for r in code.security_surface(parsed).collect()}
    assert risk["risky"] == ("high", ["os.system"]) and risk["writer"] == ("medium", ["open"]) and risk["helper"][0] == "clean"
    total = code.repo_totals(parsed).first()
    # only top-level names count, and only of files that parse
    assert (total.files, total.functions, total.classes, total.errors, total.imports) == (1, 3, 1, 1, 2)
    own = {r.name: r for r in code.functions(parsed).collect()}
    assert own["run"].doc == "Runs it." and own["writer"].raises == ["ValueError"] and own["writer"].warns == ["warnings.warn"]
    short = {r.file: r for r in code.compressed(files, tags=True).collect()}
    assert "return x + 1" in short["m.py"].compressed and "# needs:" in short["m.py"].compressed and short["broken.py"].error
    want = spark.createDataFrame([("m.py", "helper"), ("m.py", "none")], "file string, name string")
    assert {r.name: r.missing for r in code.expand(parsed, want).collect()} == {"helper": False, "none": True}
    health = code.health(files, parsed, code.compressed(files), tokens.pieces).first()
    assert (health.lang, health.files, health.functions) == ("python", 1, 3)


def test_closures(spark):
    random.seed(5)
    for _ in range(3):
        edges = [(random.randrange(12), random.randrange(12)) for _ in range(16)]
        df = spark.createDataFrame(edges, "src long, dst long")
        reach = {a: {a} for a in range(12)}
        for _ in range(12):
            for a, b in edges:
                reach[a] |= reach[b]
        got = {r.node for r in graphs.blast_radius(df, 3).collect()}
        assert got == {a for a in range(12) if 3 in reach[a] and a != 3}
        loops = {a for a in range(12) if any(x == a and a in reach[b] for x, b in edges)}
        assert {r.node for r in graphs.on_cycles(df).collect()} == loops


def test_routing(spark):
    vectors = [(i, [1.0 if i == j else 0.0 for j in range(4)], f"tool_{i}", ["list files", "send mail", "add event", "mail lists"][i]) for i in range(4)]
    t = spark.createDataFrame(vectors, "id long, vector array<float>, name string, description string")
    q = spark.createDataFrame([(0, [0.9, 0.4, 0.0, 0.0], ["mail"]), (1, [0.1, 0.1, 0.1, 0.1], ["send", "mail"])], "id long, vector array<float>, words array<string>")
    assert [(r.tool_id, r.rank) for r in routing.top_k(q.where("id = 0"), t, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    got = {r.query_id: (r.tool_id, r.fallback) for r in routing.route_with_fallback(q, t, 0.5).collect()}
    assert got == {0: (0, False), 1: (1, True)}


def test_nearest_tools_by_matrix_and_by_blocks(spark):
    rng = random.Random(4)
    rows = [(f"t{i:03d}", [float(rng.randint(-2, 2)) for _ in range(5)]) for i in range(90)] + [("null", None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)
    q = df.where("id < 't007'")
    score = {(a, b): sum(x * y for x, y in zip(u, v)) for a, u in rows if a < "t007" and u for b, v in rows if v}
    for itself in (True, False):
        want = set()
        for a in sorted({a for a, _ in score}):
            best = sorted((-s, b) for (x, b), s in score.items() if x == a and (itself or a != b))[:4]
            want |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(best)}
        for few in (2000, 2):
            got = routing.top_k(q, df.where("vector is not null"), 4, itself, few).select("query_id", "tool_id", "score", "rank").collect()
            assert {tuple(r) for r in got if r.query_id != "null"} == want
    assert routing.top_k(q.limit(0), df, 2).count() == 0 and routing.top_k(q, df.limit(0), 2).count() == 0


def test_routing_in_blocks_meets_every_pair_once(spark):
    tools = spark.range(50).select(F.col("id").alias("tool_id"))
    for n in (0, 3, 4, 23):
        queries = spark.range(n).select(F.col("id").alias("query_id"))
        got = routing.facing(tools, queries, few=3, slices=4)
        assert sorted((r.query_id, r.tool_id) for r in got.collect()) == [(q, t) for q in range(n) for t in range(50)]


def test_costs(spark):
    row = spark.range(1).select(*[c.alias(k) for k, c in costs.cache_estimate(F.lit(1_000_000), F.lit(2)).items()], costs.reduction_pct(F.lit(1000), F.lit(400)).alias("pct"), costs.saved(F.lit(100), F.lit(200)).alias("s")).first()
    assert (row.cost_plain, row.cost_cached, row.pct, row.s) == (6.0, 4.05, 60.0, 0)
    zero = spark.range(1).select(costs.cache_estimate(F.lit(5), F.lit(0))["saving_pct"].alias("p"), costs.reduction_pct(F.lit(0), F.lit(0)).alias("q")).first()
    assert (zero.p, zero.q) == (0.0, 0.0)
    said = spark.createDataFrame([("Optional. Required: The day. Later.",), (None,), ("requiredness stays. b",)], "t string").select(text.first_sentence(F.col("t"), 70).alias("s"))
    assert [r.s for r in said.collect()] == ["The day.", "", "requiredness stays."]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1000, 100), ("b", 2000, 200), ("a", 500, 50), ("c", 100, 200)]
    log = spark.createDataFrame(rows, "server string, raw long, short long")
    for i in range(2):
        log.where(F.col("raw") % 1000 == 500 * i).write.mode("append").parquet(str(tmp_path / "log"))
    log.where("raw = 100").write.mode("append").parquet(str(tmp_path / "log"))
    stream = streaming.read_log(spark, str(tmp_path / "log"), log.schema)
    streaming.stream_stats(stream, "server", F.col("raw"), F.col("short"), "totals", str(tmp_path / "ck")).awaitTermination()
    batch = stats.session_stats(log, "server", F.col("raw"), F.col("short"))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, batch.collect()))
    assert {r.server: r.saved for r in batch.collect()} == {"a": 1350, "b": 1800, "c": 0}
    again = streaming.read_log(spark, str(tmp_path / "log"), log.schema, files_a_turn=1)
    streaming.stream_stats_to(again, "server", F.col("raw"), F.col("short"), str(tmp_path / "totals"), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "totals")).collect())) == sorted(map(tuple, batch.collect()))


def parsed_one(spark, source, name="m.py"):
    return code.modules(spark.createDataFrame([(name, source)], "file string, text string"))


@pytest.mark.parametrize(
    ("line", "level", "calls"),
    [
        ("importlib.import_module(x)", "high", ["importlib.import_module"]),
        ("httpx.get(x)", "medium", ["httpx.get"]),
        ("httpx.stream(x)", "clean", []),
        ("urllib.parse.quote(x)", "clean", []),
        ("urllib.request.urlopen(x)", "medium", ["urllib.request.urlopen"]),
        ("pickle.loads(x)", "high", ["pickle.loads"]),
        ("pickle.Pickler(x)", "clean", []),
        ("ctypes.CDLL(x)", "high", ["ctypes.CDLL"]),
        ("shutil.rmtree(x)", "clean", []),
        ("open(x, mode)", "medium", ["open"]),
        ("open(x, 'rb')", "clean", []),
        ("paramiko.SSHClient().connect(x)", "medium", ["paramiko.SSHClient().connect", "paramiko.SSHClient"]),
    ],
)
def test_risk_sets(spark, line, level, calls):
    row = code.security_surface(parsed_one(spark, f"def f(x, mode):\n    {line}\n")).first()
    assert (row.level, row.calls) == (level, calls)


def test_risks_of_a_repository(spark):
    texts = [("a.py", "def f(x):\n    eval(x)\n    socket.socket()\ndef g(x):\n    return x"), ("b.py", "def h():\n    return 1"), ("c.py", "x = 1"), ("d.py", "def ("), ("e.js", "eval(x")]
    parsed = code.modules(spark.createDataFrame(texts, "file string, text string"))
    one = code.security_summary(parsed).first()
    assert tuple(one) == (1, 0, 3, 3, 2) and {r.file for r in code.clean_files(parsed).collect()} == {"b.py", "c.py"}
    assert {r.module: r.n for r in code.risk_histogram(parsed).collect()} == {"eval": 1, "socket": 1}
    errors = {r.file: r.error for r in parsed.where("error is not null").collect()}
    assert set(errors) == {"d.py", "e.js"} and errors["e.js"].startswith("SyntaxError")
    assert [r.error for r in code.outlines(spark.createDataFrame([("e.js", "f()")], "file string, text string")).collect()] == ["not done for javascript"]


def test_vocabulary_is_that_of_the_top_level(spark):
    source = "import os.path\nimport a.b as c\nfrom x import y as z\nfrom . import rel\nA, B = 1, 2\nC = D = 3\nE += 1\nF: int = 2\ndef f():\n    import late\n    def inner(): pass\n    inner()\n    return method, C, os, z, rel, F\nclass K:\n    def method(self): pass\n    class Inner: pass\n"
    row = parsed_one(spark, source).first()
    assert (row.imports, row.aliases, row.data) == (["os", "a", "x", "late"], ["os", "c", "z", "rel"], ["C", "D", "F"])
    assert (row.top_functions, row.top_classes, [f.name for f in row.functions]) == (["f"], ["K"], ["f", "inner", "method"])
    deps = {r.name: r for r in code.dependencies(parsed_one(spark, source)).collect()}
    assert (deps["f"].data, deps["f"].interne, deps["f"].externe, deps["f"].role) == (["C", "F"], [], ["os", "rel", "z"], "TOOL")


KEPT = "class Store:\n    SIZE = 9\n    def __init__(self, k):\n        self.k = k\n        self._m = {}\n    def add(self, a, b):\n        self._m[a] = b\n        if self._m: self._drop()\n        self.late = 1\n    def _drop(self):\n        self._m.clear()\n"


def test_self_is_resolved_on_demand():
    plain = code.compress(KEPT, tags=True)
    assert "# needs" not in plain and "self._m[a] = b" in plain
    short = code.compress(KEPT, resolve_self=True)
    assert "self.k = k" in short and "    SIZE = 9" in short and "    # attrs: SIZE, late" in short
    assert '# needs: {"data": ["self._m"], "interne": ["self._drop"]}' in short and "self._m[a] = b" not in short


def test_signature_and_tags():
    text = 'import os\nasync def f(a, /, b: int = 1, *c, d: str = "x", **e) -> int:\n    """One.\n\n    Two."""\n    raise E(os)\n    yield 1\n    log.warning("x")\n'
    assert code.compress(text, tags=True).splitlines()[1:] == ["async def f(b: int = 1, *c, d = 'x', **e) -> int:", '    """One."""', '    # needs: {"externe": ["os"], "raises": ["E"], "yields": true, "warns": ["log.warning"]}']


def test_no_file_stops_the_others(spark):
    deep = "x = " + "1 + " * 3000 + "1\ndef f(a=" + "1 + " * 3000 + "1):\n    os.x()\nimport os\n"
    files = spark.createDataFrame([("a.py", deep), ("b.py", "def g(): pass"), ("c.py", "\0"), ("d.py", None)], "file string, text string")
    for found in (code.modules(files), code.compressed(files), code.outlines(files)):
        rows = {r.file: r.error for r in found.collect()}
        assert len(rows) == 4 and rows["b.py"] is None and rows["d.py"] is None and rows["c.py"]


def test_no_schema_stops_the_others(spark):
    rows = [(0, "a", "", "{bad"), (1, "b", "", json.dumps({"properties": 3})), (2, "c", "", json.dumps({"properties": {"x": {"$ref": 5}}})), (3, "d", None, None), (4, "e", "", json.dumps({"required": ["x"], "properties": {"x": {"type": "string"}}}))]
    df = spark.createDataFrame(rows, "ord int, name string, description string, input_schema string")
    found = {r.name: r for r in schemas.verdicts(df).collect()}
    assert set(found) == set("abcde") and found["e"].ok and found["d"].ok and not found["a"].ok and not found["b"].ok and found["a"].lost[0].startswith("error:")
    nodes = schemas.schema_nodes(df).collect()
    assert {r.name for r in nodes if r.error} >= {"a", "b"} and sum(r.name == "e" for r in nodes) == 2
    assert {r.name for r in schemas.compressed_tools(df).where("error is not null").collect()} >= {"a", "b"}


def test_tools_of_one_name_are_judged_apart(spark):
    df = tools(spark, ("t", "", {"properties": {"a": {"type": "string"}}}), ("t", "", {"properties": {"a": {"type": "string", "maxItems": 1}}}))
    assert sorted((r.ok, r.lost) for r in schemas.verdicts(df).collect()) == [(False, ["unhandled:maxItems"]), (True, [])]


def test_checks_by_kind(spark):
    cases = {
        "type": ({"properties": {"a": {"allOf": [{"description": "d"}]}}}, ["typed:a"]),
        "loose": ({"properties": {"a": {"type": "array", "uniqueItems": True, "items": {"const": 1}}}}, []),
        "nested": ({"properties": {"a": {"properties": {"b": {"type": "string"}}, "required": ["b"]}}}, []),
        "disc": ({"properties": {"a": {"oneOf": [{"type": "string"}, {"type": "object"}], "discriminator": {"propertyName": "k", "mapping": {"o": "#/d/O"}}}}}, []),
        "null": ({"properties": {"a": {"anyOf": [{"type": "string", "enum": ["x"]}, {"type": "null"}]}}}, []),
        "required": ({"properties": {}, "required": ["gone"]}, ["required:gone"]),
    }
    df = tools(spark, *[(k, "", v) for k, (v, _) in cases.items()])
    assert {r.name: r.lost for r in schemas.verdicts(df).collect()} == {k: lost for k, (_, lost) in cases.items()}
    strict = {r.name: r.lost for r in schemas.verdicts(df, strict=True).collect()}
    assert strict["loose"] == ["unhandled:const", "unhandled:uniqueItems"] and strict["nested"] == ["nested required:$.properties.a.b"] and strict["disc"] == []
    assert tuple(schemas.overall(df.where("name = 'disc'")).first()) == (1, 1, 0, True)
    loop = tools(spark, ("t", "", {"$defs": {"A": {"x": {"$ref": "#/$defs/A"}}}}))
    assert tuple(schemas.overall(loop).first()) == (1, 1, 1, False)


def test_served_forms(spark):
    schema = {"properties": {"a": {"type": "string", "pattern": "x", "default": 1}, "b": {"$ref": "#/$defs/D"}}, "required": ["b"], "$defs": {"D": {"type": "integer", "maximum": 3}}}
    df = tools(spark, ("t", "Does it. More.", schema), ("u", "", {}))
    served = {r.name: r for r in schemas.served(df).collect()}
    assert served["t"].description == "Does it." and json.loads(served["t"].input_schema) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"$ref": "#/$defs/D"}}, "required": ["b"]}
    assert served["u"].description == "" and json.loads(served["u"].input_schema) == {"type": "object", "properties": {}}
    defs = {r.name: json.loads(r.definition) for r in schemas.compressed_defs(df).collect()}
    assert defs == {"D": {"t": "integer", "max": 3}}
    whole = {r.name: json.loads(r.input_schema) for r in schemas.input_schemas(df, lossless=True, definitions=json.dumps(defs)).collect()}
    assert whole["t"]["$defs"] == {"D": {"type": "integer", "maximum": 3}} and whole["t"]["properties"]["a"] == {"type": "string", "pattern": "x", "default": 1}
    assert [(r.name, r.cache_control) for r in schemas.api_form(df).orderBy("ord").collect()] == [("t", None), ("u", "ephemeral")]
    assert {r.wanted: r.message for r in schemas.find(df, spark.createDataFrame([("t",), ("x",)], "wanted string")).collect()} == {"t": None, "x": "no tool named x"}
    assert json.loads(reports.as_json(df.where("ord = 0").select("name", F.lit(None).cast("int").alias("n"))).first().result) == {"name": "t", "n": None}


def test_catalog_report_is_a_sum_of_parts(spark):
    df = tools(spark, *[(f"t{i}", f"Does {i}. " + "more " * i, {"properties": {f"p{j}": {"type": "string", "description": "D. " * 9} for j in range(i)}}) for i in range(4)]).withColumn("server", F.lit("s"))
    costed = reports.tool_costs(df).toPandas()
    report = {r.k: r for r in reports.catalog_report(reports.tool_costs(df)).collect()}
    assert set(report) == {1, 3} and report[3].tokens == costed["index"].sum() + costed["short"].nlargest(3).sum()
    assert report[1].raw == costed.raw.sum() and report[1].reduction_pct == round((1 - report[1].tokens / report[1].raw) * 100, 1)


def test_vocabulary_counts(spark, tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)) + f"{base64.b64encode(b'ab').decode()} 256\n")
    df = spark.createDataFrame([("abab c",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(tokens.vocabulary(str(path), r"[a-z]+| ")(F.col("t")).alias("n")).collect()] == [4, 0, 0]


def test_words_route_text_ids(spark):
    t = spark.createDataFrame([("b_tool", "b tool", "mail"), ("a_tool", "a tool", "mail")], "id string, name string, description string")
    q = spark.createDataFrame([("q", ["mail"]), ("r", ["nothing"])], "id string, words array<string>")
    assert {r.query_id: (r.tool_id, r.score) for r in routing.keyword_route(q, t).collect()} == {"q": ("a_tool", 1), "r": ("a_tool", 0)}
    assert {(r.query_id, r.tool_id) for r in routing.keyword_route(q, t.limit(0)).collect()} == {("q", None), ("r", None)}
    spaced = spark.createDataFrame([("Find\u00a0The\u2003the",)], "t string").select(text.distinct_words(F.col("t")).alias("w")).first().w
    assert spaced == ["find", "the"]
    assert spark.createDataFrame([("'`a\"b`'",)], "t string").select(text.unquoted(F.col("t")).alias("w")).first().w == 'a"b'


def test_catalog_order_is_that_of_files(spark, tmp_path):
    for i, names in enumerate((["x", "y"], ["x", "z"])):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"name": n, "description": f"{i}"} for n in names]))
    rows = catalogs.read_catalogs(spark, str(tmp_path)).repartition(3)
    first = {r.name: r.description for r in stats.first_wins(rows, "name", "ord", "description").collect()}
    assert first == {"x": "0", "y": "0", "z": "1"}


def test_source_kinds_and_bytes(spark, tmp_path):
    for name in ("a.cjs", "b.tsx", "c.rb"):
        (tmp_path / name).write_text("x")
    (tmp_path / "d.py").write_bytes(b"x = '\xff'")
    rows = {r.file: r.text for r in catalogs.read_sources(spark, str(tmp_path), strict=False).collect()}
    assert set(rows) == {"a.cjs", "b.tsx", "d.py"} and rows["d.py"] == "x = '\ufffd'"
    assert [r.l for r in spark.createDataFrame([("a.CJS",), ("b.tsx",), ("x/y",)], "f string").select(code.language(F.col("f")).alias("l")).collect()] == ["javascript", "tsx", "python"]


def test_deep_closures(spark):
    chain = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    hit = {r.node: r.depth for r in graphs.reach_back(chain, 60).collect()}
    assert hit == {i: 60 - i for i in range(60)}
    rings = [(i, (i + 1) % 9) for i in range(9)] + [(8, 20), (20, 21), (21, 20), (21, 30), (40, 40), (30, 31)]
    assert {r.node for r in graphs.on_cycles(spark.createDataFrame(rings, "src long, dst long")).collect()} == {*range(9), 20, 21, 40}


SCRIPT = '''// import gone from "gone";
import http from "http";
import { readFile as rf, join } from './fs';
import * as ns from "ns";
const ev = require("events");
export const CONFIG = {
  retries: 3,
  url: "a { b",
};
export async function fetchIt(url, opts = {}, { a, b } = {}, ...rest) {
  const text = `x ${url} {`;
  for (let i = 0; i < 3; i++) { await ask(url); rf(i); }
  return ns.go(/[{]/.test(url));
}
function ask(url) {
  return 1;
}
const ok = (e) => e.code === 1 || ask(e);
const single = x => {
  return x;
};
class Task extends ev {
  static count = 0;
  constructor() {
    this.id = join(1);
  }
  async run(n) {
    if (this.id) { return ask(n); }
  }
}
export default class Queue { add(t) { this.l.push(t); } }
'''

TYPED = '''import type { Logger } from "./logger";
export interface Job<T> {
  id: string;
}
export type Handler<T, R> = (payload: T) => Promise<R>;
function nextId(prefix: string, n?: Map<string, number>): string {
  return `${prefix}`;
}
export async function runHandler<T, R>(
  handler: Handler<T, R>,
  payload: T,
): Promise<Result<R>> {
  return { ok: nextId("x") };
}
const wrap = <T>(value: T): Job<T> => ({
  id: nextId("job"),
});
export abstract class Worker<T, R> extends Base {
  protected logger?: Logger;
  constructor(private logger?: Logger) {
    super();
  }
  abstract handle(job: Job<T>): Promise<R>;
  async process(payload: T): Promise<{ a: R }> {
    return runHandler((p) => this.handle(wrap(p)), payload);
  }
}
enum Color { Red, Green }
'''


def test_scripts(spark):
    files = spark.createDataFrame([("a.js", SCRIPT), ("b.ts", TYPED), ("c.cjs", "let x = {"), ("d.py", "import os\ndef f(): pass")], "file string, text string")
    parsed = code.modules(files)
    rows = {r.file: r for r in parsed.collect()}
    assert rows["a.js"].imports == ["http", "./fs", "ns", "events"] and rows["a.js"].top_classes == ["Task", "Queue"] and rows["b.ts"].imports == ["./logger"] and rows["c.cjs"].error
    params = {(r.file, f.name): f.params for r in rows.values() for f in r.functions or []}
    assert params["a.js", "fetchIt"] == ["url", "opts", "{ a, b }", "...rest"] and params["a.js", "single"] == ["x"] and params["a.js", "constructor"] == []
    assert params["b.ts", "nextId"] == ["prefix", "n"] and params["b.ts", "runHandler"] == ["handler", "payload"] and params["b.ts", "constructor"] == ["logger"] and params["b.ts", "handle"] == ["job"]
    edges = {(r.file, r.caller, r.callee) for r in code.call_edges(parsed).collect()}
    assert edges == {("a.js", "fetchIt", "ask"), ("a.js", "ok", "ask"), ("a.js", "run", "ask"), ("b.ts", "runHandler", "nextId"), ("b.ts", "wrap", "nextId"), ("b.ts", "process", "runHandler"), ("b.ts", "process", "wrap")}
    wanted = spark.createDataFrame([("a.js", "fetchIt"), ("a.js", "Task"), ("a.js", "ghost")], "file string, name string")
    found = {r.name: r for r in code.expand(parsed, wanted).collect()}
    assert (found["fetchIt"].kind, found["fetchIt"].interne, found["fetchIt"].externe, found["ghost"].missing) == ("function", ["ask"], ["ns", "rf"], True)
    assert found["Task"].kind == "class" and "async run(n)" in found["Task"].source and "for (let i" in found["fetchIt"].source
    short = {r.file: r.compressed for r in code.compressed(files).collect()}
    assert "export async function fetchIt(url, opts = {}, { a, b } = {}, ...rest) { ... }" in short["a.js"] and "retries: 3" in short["a.js"] and "const ok = (e) => { ... }" in short["a.js"] and "  async run(n) { ... }" in short["a.js"] and "join(1)" not in short["a.js"]
    assert "interface Job<T> {" in short["b.ts"] and "): Promise<Result<R>> { ... }" in short["b.ts"] and "  abstract handle(job: Job<T>): Promise<R>;" in short["b.ts"] and "  protected logger?: Logger;" in short["b.ts"] and "enum Color { Red, Green }" in short["b.ts"]
    total = code.repo_totals(parsed).first()
    assert (total.files, total.classes, total.errors, total.imports) == (3, 3, 1, 6)


def counted_cuts(monkeypatch):
    """How many tables the closures write."""
    made, real = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: (made.append(1), real(df))[1])
    return made


def test_long_chains_and_rings_take_few_jobs(spark, monkeypatch):
    n = 100_000
    made = counted_cuts(monkeypatch)
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    far = graphs.reach_back(chain, n)
    assert far.count() == n and far.agg(F.max("depth")).first()[0] == n and far.where(F.col("depth") != n - F.col("node")).isEmpty()
    assert len(made) < 40
    made.clear()
    assert graphs.on_cycles(chain).isEmpty() and len(made) < 40
    made.clear()
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    leaves = spark.range(n).selectExpr("id AS src", f"id + {n} AS dst")
    assert graphs.on_cycles(ring).count() == n and len(made) < 40
    made.clear()
    assert graphs.on_cycles(ring.unionByName(leaves)).count() == n and len(made) < 40


def test_closures_on_random_graphs_with_chains(spark):
    rng = random.Random(9)
    for size, extra in ((14, 9), (30, 20), (40, 44)):
        edges = [(rng.randrange(size), rng.randrange(size)) for _ in range(extra)]
        for _ in range(4):  # chains between random nodes, some from a node to itself
            a, b, new = rng.randrange(size), rng.randrange(size), size + 100 * rng.randrange(1, 50)
            path = [a, *range(new, new + rng.randrange(1, 6)), b]
            edges += list(zip(path, path[1:], strict=False))
        df = spark.createDataFrame(edges, "src long, dst long")
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)
        nodes = {x for e in edges for x in e}

        def depths(start, step):
            seen, front, d = {}, {start}, 0
            while front:
                d += 1
                front = {y for x in front for y in step.get(x, ())} - set(seen)
                seen |= dict.fromkeys(front, d)
            return seen

        loops = {x for x in nodes if x in depths(x, after)}
        assert {r.node for r in graphs.on_cycles(df).collect()} == loops
        back = {}
        for a, b in edges:
            back.setdefault(b, set()).add(a)
        target = edges[0][1]
        want = {x: d for x, d in depths(target, back).items() if x != target}
        assert {r.node: r.depth for r in graphs.reach_back(df, target).collect()} == want


def test_last_of_one_list_takes_no_single_task(spark):
    rows = spark.range(50).selectExpr("id % 40 AS ord", "id")
    got = stats.mark_last(rows, [], "ord")
    assert [r.ord for r in got.where("cache_control is not null").collect()] == [39]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan
    tied = spark.createDataFrame([(1, "a"), (1, "b"), (0, "c")], "ord int, x string")
    assert stats.mark_last(tied, [], "ord").where("cache_control is not null").count() == 1
    assert stats.mark_last(tied.limit(0), [], "ord").count() == 0
