"""Tool schemas and source files made of the driver's tables, as SQL expressions that Spark and DuckDB both read.

No driver table holds schemas or code, so these give the schema and code operators work that grows with the tables and
has classes, methods, aliases, unions, references, errors and risks in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_case(column: str, cases: dict[int, str], otherwise: str = "''") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


#: What the schema of a part has beside the parameters that all have, by the last digit of its key; 2 is no JSON at all.
EXTRA = {
    1: """', "link": {"$ref": "#/$defs/Gone"}'""",
    3: """', "mixed": {"allOf": [{"type": "string", "pattern": "^x"}]}'""",
    4: """', "pick": {"oneOf": [{"type": "string"}, {"$ref": "#/$defs/Price"}], "discriminator": {"propertyName": "how", "mapping": {"p": "#/$defs/Price"}}}'""",
    5: """', "maybe": {"anyOf": [{"type": "string", "format": "date"}, {"type": "null"}], "default": null}'""",
    6: """', "bare": {"allOf": [{"description": "x"}]}'""",
}
SCHEMA = f"""CASE WHEN p_partkey % 10 = 2 THEN '{{bad' ELSE concat('{{"type": "object", "properties": {{"size": {{"type": "integer", "minimum": ', p_size % 5, ', "maximum": ', p_size,
  ', "description": "Required. Size of the part. At most ', p_size, '"}}, "kind": {{"type": "string", "enum": ["', p_brand, '", "', p_type, '"]}}, "code": {{"type": "string"',
  CASE WHEN p_partkey % 10 = 0 THEN ', "minLength": 1' ELSE '' END, ', "pattern": "^[A-Z]"}}, "prices": {{"type": "array", "items": {{"$ref": "#/$defs/Price"}}}}', {by_case("p_partkey % 10", EXTRA)},
  '}}, "required": ["size"], "$defs": {{"Price": {{"type": "object", "properties": {{"amount": {{"type": "number", "maximum": ', p_retailprice, '}}}}}}}}}}') END"""


def part_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool for each part; the servers are the brands."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_brand").alias("server"), F.col("p_partkey").alias("ord"), F.expr("concat('part_', p_partkey)").alias("name"), F.expr("concat('Orders ', p_name, '. By part.')").alias("description"), F.expr(SCHEMA).alias("input_schema"))


def lines(*parts: str) -> str:
    """An expression that joins lines, each of them an expression, and leaves out those that are null."""
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


#: What the function `second` of a part's module does, by the size of the part.
BODIES = {0: "'    return importlib.import_module(x)'", 1: "'    return httpx.get(x)'", 2: "'    return urllib.parse.quote(x)'", 3: "'    os.system(x)'", 4: """'    open(x, mode="w")'""", 5: "'    open(x)'", 6: "concat('    subprocess.run(x)', chr(10), '    requests.get(x)')"}
THING = "CASE WHEN p_partkey % 2 = 0 THEN 'from pkg.mod import thing' END"
LIMIT = "CASE WHEN p_partkey % 3 = 0 THEN concat('LIMIT = ', p_size) END"
BODY = by_case("p_size % 7", BODIES)
MADE = "concat('make_', lower(p_type))"

SCRIPT_LINES = ("""'import http from "http";'""", "concat('const SIZE = ', p_size, ';')")
SCRIPT = lines(*SCRIPT_LINES, "'export function load(url, n = 1) {'", "'  return http.get(url); // load('", "'}'", "'class Box {'", "'  open(x) {'", "'    return load(x);'", "'  }'", "'}'")
CODE = f"CASE WHEN p_partkey % 10 = 9 THEN 'def broken(:' WHEN p_partkey % 10 = 8 THEN {SCRIPT} ELSE " + lines(
    "concat('\"\"\"Module ', p_partkey, '\"\"\"')", "'import os, json as js'", THING, LIMIT, "'A, B = 1, 2'",
    "'class Base_:'", "'    pass'",
    "'class Worker(Base_):'", "concat('    \"\"\"Works on ', p_brand, '.')", "''", "'    More.\"\"\"'", "concat('    rate = ', p_size)",
    "'    def __init__(self, n):'", "'        self.n = n'", "'        self.more = n'",
    "'    def run(self, x):'", "'        \"\"\"Runs it.\"\"\"'", "'        helper(x)'", "'        self._check(x)'", "'        self.last = x'", "'        return os.path.join(x, str(LIMIT))'",
    "'    def _check(self, x):'", "'        if not x: raise ValueError(\"no\")'", "'        return self.rate'",
    "'def helper(x, y=1, *rest, flag=False, **more):'", "'    return x + y'",
    f"concat('def ', {MADE}, '(x):')", BODY,
    "'def orch(x):'", f"concat('    helper(x); ', {MADE}, '(x)')", "'    return Worker'",
    "'async def fetch(url):'", "'    yield helper(url)'",
) + " END"
FILE = "concat('p', p_partkey, CASE WHEN p_partkey % 10 = 8 THEN '.js' ELSE '.py' END)"
PARSES = "p_partkey % 10 < 8"
IS_SCRIPT = "p_partkey % 10 = 8"


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part: of ten, one is JavaScript and one is broken."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(FILE).alias("file"), F.expr(CODE).alias("text"))


#: A tool for each supplier: definitions of odd nations refer to each other, and tools of every fifth one lose a constraint.
SUPPLIER_SCHEMA = """concat('{"properties": {"a": {"$ref": "#/$defs/N1"}, "b": {"type": "string"', CASE WHEN s_suppkey % 5 = 0 THEN ', "maxLength": 9' ELSE '' END, '}}, "$defs": {"N1": {"properties": {"x": {"$ref": "#/$defs/N2"}}}, "N2": {"properties": {"y": ', CASE WHEN s_nationkey % 2 = 1 THEN '{"$ref": "#/$defs/N1"}' ELSE '{"type": "integer"}' END, '}}}}')"""


def supplier_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool for each supplier; the servers are the nations."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return supplier.select(F.expr("concat('nation_', s_nationkey)").alias("server"), F.col("s_suppkey").alias("ord"), F.expr("concat('supplier_', s_suppkey)").alias("name"), F.lit("Orders from a supplier.").alias("description"), F.expr(SUPPLIER_SCHEMA).alias("input_schema"))
