"""The walk over schemas in the JVM against a plain recursive one, on random and on deep schemas."""

import json
import random

import pytest

from specto.operators import schemas, trees
from specto.plans.catalogue import QUERIES

TYPED = ("$ref", "anyOf", "oneOf", "allOf", "items", "properties")


def inside(node, maps):
    yield node
    for key in maps:
        for v in (node.get(key) or {}).values():
            if isinstance(v, dict):
                yield from inside(v, maps)
    for v in [node.get("items"), *(b for key in ("anyOf", "oneOf", "allOf") for b in node.get(key) or [])]:
        if isinstance(v, dict):
            yield from inside(v, maps)


def said(v):
    return v if isinstance(v, str) else json.dumps(v)


def plain_atoms(schema):
    props = schema.get("properties") or {}
    out = {("param", k) for k in props} | {("required", k) for k in schema.get("required") or []}
    out |= {("typed", k) for k, v in props.items() if isinstance(v, dict) and ("type" in v or "enum" in v or any(v.get(t) for t in TYPED))}
    for i, node in enumerate(inside(schema, ("properties",))):
        out |= {("unhandled", k) for k in schemas.UNHANDLED if k in node}
        if i:
            out |= {("enum", said(v)) for v in node.get("enum") or []}
            out |= {(kind, said(node[k])) for kind, k in (("pattern", "pattern"), ("min", "minimum"), ("max", "maximum")) if k in node}
            out |= {("ref", node["$ref"].rsplit("/", 1)[-1])} if "$ref" in node else set()
            out |= {("discriminator", node["discriminator"]["propertyName"])} if node.get("discriminator", {}).get("propertyName") else set()
    return out


def random_schema(rng, depth):
    node = {}
    if rng.random() < 0.15:
        node["$ref"] = f"#/$defs/D{rng.randrange(4)}"
    if rng.random() < 0.6:
        node["type"] = rng.choice(["string", "object", "array", "null", ["string", "null"]])
    for key, value in (("enum", [1, "x", True, None]), ("pattern", "^a.b$"), ("minimum", 0), ("maximum", rng.randrange(9)), ("minLength", 2), ("format", "date"), ("description", "Required. It is. More."), ("default", None)):
        if rng.random() < 0.2:
            node[key] = value
    if depth:
        some = lambda: random_schema(rng, depth - 1)
        if rng.random() < 0.5:
            node["properties"] = {rng.choice("abcde.") + str(i): some() for i in range(rng.randrange(4))}
        if rng.random() < 0.3:
            node["items"] = some()
        for key in ("anyOf", "oneOf", "allOf"):
            if rng.random() < 0.25:
                node[key] = [some() for _ in range(rng.randrange(3))] + [5] * (rng.random() < 0.2)
        if rng.random() < 0.3:
            node["discriminator"] = rng.choice([{"propertyName": "k", "mapping": {"x": "#/$defs/D1"}}, {"mapping": {}}, {"propertyName": "k"}])
    return node


def deep(n):
    node = {"type": "string", "enum": ["bottom"]}
    for i in range(n):
        node = {"type": "object", "properties": {f"p{i}": node}} if i % 2 else {"type": "array", "items": node}
    return {"properties": {"top": node}, "required": ["top"], "$defs": {"D": {"properties": {"x": node}}}}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(2)
    return [random_schema(rng, 4) for _ in range(120)] + [deep(n) for n in (1, 5, 6, 7, 20)] + [{}, {"properties": None}, {"properties": {"a": 1}}]


def tools(spark, cases):
    return spark.createDataFrame([(i, f"t{i}", "Does.", json.dumps(s)) for i, s in enumerate(cases)], "ord int, name string, description string, input_schema string")


def test_atoms(spark, cases):
    got = {}
    for r in schemas.schema_atoms(tools(spark, cases)).collect():
        got.setdefault((r.name, r.side), set()).add((r.kind, r.value))
    for i, schema in enumerate(cases):
        try:
            short = schemas.restored(schemas.compress_tool("", schema)[1])
        except schemas.TROUBLE:
            assert (f"t{i}", "error") in got
            continue
        assert got.get((f"t{i}", "raw"), set()) == plain_atoms(schema), schema
        assert got.get((f"t{i}", "compressed"), set()) == plain_atoms(short), schema


def test_nodes(spark, cases):
    got = {}
    for r in schemas.schema_nodes(tools(spark, cases)).collect():
        got.setdefault(r.name, []).append(r)
    for i, schema in enumerate(cases):
        rows = got[f"t{i}"]
        want = list(inside(schema, ("properties", "$defs")))
        assert len(rows) == len(want) == len({r.path for r in rows})
        assert sorted(said(n["type"]).replace(" ", "") if "type" in n else "" for n in want) == sorted(r.type or "" for r in rows)
        paths = {r.path: r for r in rows}
        assert all(r.parent in paths and paths[r.parent].depth == r.depth - 1 for r in rows if r.depth)
    assert max(r.depth for rows in got.values() for r in rows) > 2 * trees.LEVELS


def test_broken_schemas(spark):
    texts = ["{bad", '{"properties": 3}', '{"$defs": [1]}', '{"anyOf": "x"}', "[1]", "", None, "null", '{"properties": {"a": {"properties": true}}}']
    df = spark.createDataFrame([(i, str(i), "", t) for i, t in enumerate(texts)], "ord int, name string, description string, input_schema string")
    found = schemas.schema_nodes(df).collect()
    assert {r.name for r in found if r.error} == {"0", "1", "2", "3", "8"} and len(found) == len(texts)


@pytest.mark.parametrize("name", ["schema_nodes", "json_atoms", "lost_atoms", "contract_report"])
def test_plans_have_no_python(spark, name):
    assert "MapInArrow" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_compression_keeps_to_its_rules():
    assert schemas.compress({"items": {"type": "string"}}) == {}  # items of no array
    assert schemas.compress({"oneOf": [{"type": "string"}, {"type": "number"}], "discriminator": {"mapping": {}}}) == {"any": [{"t": "string"}, {"t": "number"}]}
    tagged = {"oneOf": [{"type": "string"}, {"type": "number"}], "discriminator": {"propertyName": "k"}}
    assert schemas.compress(tagged)["disc"] == {"prop": "k"} and schemas.expand(schemas.compress(tagged))["discriminator"] == {"propertyName": "k"}


def test_contract_check_compresses_once_and_deals_no_atoms(spark, cases, monkeypatch):
    calls, rows = [], schemas._rows
    monkeypatch.setattr(schemas, "_rows", lambda *a: calls.append(1) or rows(*a))
    flat = [c for c in cases if schemas.layers([c], schemas.IN_SCHEMA) < trees.LEVELS][:20]
    some = tools(spark, flat)
    assert schemas.contract_report(some).count() == len(flat) > 5 and len(calls) == 1
    assert "Exchange" not in schemas.schema_atoms(some)._jdf.queryExecution().toString()


def test_layers():
    assert schemas.layers([{}], schemas.IN_SCHEMA) == 1 and schemas.layers([3, None], schemas.IN_SHORT) == 0
    assert schemas.layers([deep(5)], schemas.IN_SCHEMA) == 7
    assert schemas.layers([{"properties": [{}], "items": [{}], "anyOf": {"a": {}}, "oneOf": [1, {}]}], schemas.IN_SCHEMA) == 2
