"""The registered queries over the driver's tables, each with its equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specto.functions import costs, text
from specto.functions.tokens import pieces
from specto.operators import code, counts, graphs, nearest, parses, reports, routing, schemas, stats, vectors
from specto.plans.fixtures import BODY as TASK
from specto.plans.fixtures import CODE, FILE, IS_SCRIPT, LIMIT, MADE, PARSES, SCHEMA, SCRIPT_LINES, THING, by_case, lines, part_code, part_tools, supplier_tools
from specto.operators.storage import shared_folder
from specto.sources import catalogs
from specto.streaming import totals as kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "vector_topk",
    """
    WITH s AS (
      SELECT q.vec_id AS query_id, t.vec_id AS tool_id, round(list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0)
    SELECT query_id, tool_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id)::INTEGER AS rank FROM s) WHERE rank <= 3
    """,
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return routing.top_k(vectors.where("id % 20 = 0"), vectors, 3)


@query(
    "session_stats",
    """
    SELECT event_type, n AS requests, saved, raw, CASE WHEN raw <> 0 THEN round(saved * 100.0 / raw, 1) ELSE 0 END AS pct, (saved * 300)::DOUBLE / 1e8 AS usd FROM (
      SELECT event_type, count(*) AS n, sum(greatest(0, v - 100))::BIGINT AS saved, sum(v)::BIGINT AS raw FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY 1)
    """,
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return stats.session_stats(log, "event_type", F.col("v"), F.lit(100))


@query("vector_topk_bounds", SQL["vector_topk"])
def vector_topk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.bounded_top_k(vectors.where("id % 20 = 0"), vectors, 3)[0]


@query("session_turns", SQL["session_stats"])
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace(".parquet", ".parque[t]")).select("event_type", F.floor("value").alias("v"))
    folder = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    kept.keep_stats(log, "event_type", F.col("v"), F.lit(100), f"{folder}/totals", f"{folder}/stream").awaitTermination()
    return kept.kept_stats(spark, "event_type", f"{folder}/totals")


@query("token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return counts.count_tokens(texts, ranks, public_tokenizers.PATTERN).select(F.col("id").alias("doc_id"), "tokens")


@query(
    "session_totals",
    """
    SELECT event_type, n AS requests, saved, raw, CASE WHEN raw <> 0 THEN round(saved * 100.0 / raw, 1) ELSE 0 END AS pct, (saved * 300)::DOUBLE / 1e8 AS usd FROM (
      SELECT event_type, count(*) AS n, sum(greatest(0, v - 100))::BIGINT AS saved, sum(v)::BIGINT AS raw FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY ROLLUP (event_type))
    """,
)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return stats.session_totals(log, "event_type", F.col("v"), F.lit(100))


SENTENCE = """rtrim(substring(coalesce(nullif(regexp_extract(body, '^((?s:.*?)[.!?])[ \\t\\r\\n]', 1), ''), body), 1, {n}), ' ' || chr(9) || chr(10) || chr(13))"""
BODY = """(SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '(?i)^([ \\t\\r\\n]*(optional|required|output only|deprecated|read-only)\\b[.:]?[ \\t\\r\\n]*)+', '') AS body FROM documents)"""


@query("first_sentence", f"SELECT doc_id, {SENTENCE.format(n=70)} AS s70, {SENTENCE.format(n=80)} AS s80, {SENTENCE.format(n=140)} AS s140 FROM {BODY}")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[text.first_sentence(F.col("text"), n).alias(f"s{n}") for n in (70, 80, 140)])


@query("request_cost", f"SELECT doc_id, (n_chars * 100 + 250000)::DOUBLE / 1e8 AS cost_before, (after * 100 + 250000)::DOUBLE / 1e8 AS cost_after, ((n_chars - after) * 100)::DOUBLE / 1e8 AS savings FROM (SELECT doc_id, n_chars, length({SENTENCE.format(n=140)})::BIGINT AS after FROM {BODY})")
def request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length(text.first_sentence(F.col("text"), 140)).cast("long").alias("after"))
    found = costs.request_cost(F.col("n_chars"), F.col("after"))
    return docs.select("doc_id", *[found[k].alias(k) for k in ("cost_before", "cost_after", "savings")])


@query(
    "cache_estimate",
    """
    SELECT o_orderkey, (t * 300 * n)::DOUBLE / 1e8 AS cost_plain, (t * 375 + t * 30 * greatest(0, n - 1))::DOUBLE / 1e8 AS cost_cached,
      greatest(0, t * 300 * n - (t * 375 + t * 30 * greatest(0, n - 1)))::DOUBLE / 1e8 AS saving FROM (SELECT o_orderkey, o_custkey AS t, o_orderkey % 50 AS n FROM orders)
    """,
)
def cache_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = costs.cache_estimate(F.col("o_custkey"), F.col("o_orderkey") % 50)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[found[k].alias(k) for k in ("cost_plain", "cost_cached", "saving")])


@query("url_segments", "SELECT page_id, split_part(url, '/', -1) AS last, split_part(split_part(url, '/', 3), '.', 1) AS root FROM pages")
def url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.split("url", "/"), 3)
    return table(spark, sf_dir, "pages").select("page_id", text.last_segment(F.col("url")).alias("last"), text.root_segment(host).alias("root"))


@query("first_def_wins", "SELECT source, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def first_def_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_wins(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars")


@query("first_occurrence", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_row(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query("mark_last", "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN 'ephemeral' END AS cache_control FROM conversations")
def mark_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mark_last(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(
    "topk_prefix_cost",
    """
    SELECT source, k, total, round(total / sum_all, 6) AS share FROM (
      SELECT source, row_number() OVER w::INTEGER AS k, (sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total, sum(n_chars) OVER (PARTITION BY source) AS sum_all
      FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)) WHERE k IN (1, 3, 5)
    """,
)
def topk_prefix_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.prefix_costs(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")


@query(
    "route_threshold",
    """
    WITH s AS (SELECT q.vec_id AS query_id, t.vec_id AS tool_id, round(list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id)
    SELECT query_id, CASE WHEN score >= 0.3 THEN tool_id END AS tool_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id) AS r FROM s) WHERE r = 1
    """,
)
def route_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = routing.top_k(vectors.where("id % 20 = 0"), vectors, 1, itself=False)
    return routing.above(best, 0.3)


@query(
    "keyword_route",
    """
    WITH q AS (SELECT conv_id || '-' || turn AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS words FROM conversations WHERE conv_id % 20 = 0),
    s AS (SELECT query_id, item_id AS tool_id, len(list_filter(words, lambda w: contains('item ' || item_id, w) OR contains(lower(b.text), w)))::INTEGER AS score FROM q, benchmark b)
    SELECT query_id, tool_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_id) AS r FROM s) WHERE r = 1
    """,
)
def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("conv_id % 20 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.distinct_words(F.col("text")).alias("words"))
    name = text.plain_name(F.concat(F.lit("Item_"), F.col("item_id")))
    return routing.keyword_route(q, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), name.alias("name"), F.lower("text").alias("description")))


@query(
    "text_weights",
    """
    WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower('item_' || item_id || ': ' || text), '[ \\t\\r\\n]+'), lambda x: x <> ''))) AS word FROM benchmark),
    f AS (SELECT item_id, 'w:' || word AS feature FROM w UNION SELECT item_id, 'g:' || substr('<' || word || '>', i, 3) FROM (SELECT item_id, word, unnest(range(1, length(word) + 1)) AS i FROM w))
    SELECT feature, df, round(ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1, 6) AS idf FROM (SELECT feature, count(*) AS df FROM f GROUP BY 1)
    """,
)
def text_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.tool_text(F.concat(F.lit("item_"), F.col("item_id")), F.col("text")).alias("text"))
    return vectors.weights(items).withColumn("idf", F.round("idf", 6))


@query("text_route")
def text_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items nearest to conversations, both from their texts, by keywords where no vector is near enough."""
    q = table(spark, sf_dir, "conversations").where("conv_id % 20 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("item_"), F.col("item_id")).alias("name"), F.col("text").alias("description"))
    return routing.route_texts(q, items, 0.3)


@query(
    "blast_radius",
    """
    WITH RECURSIVE e AS (SELECT p_partkey AS src, floor(p_partkey / (p_size % 3 + 2))::BIGINT AS dst FROM part WHERE p_partkey <> floor(p_partkey / (p_size % 3 + 2))),
    r AS (SELECT 1::BIGINT AS node UNION SELECT e.src FROM e JOIN r ON e.dst = r.node),
    h AS (SELECT node FROM r WHERE node <> 1)
    SELECT node, node IN (SELECT src FROM e WHERE dst = 1) AS direct, (SELECT count(*) FROM h) AS impacted,
      CASE WHEN (SELECT count(*) FROM h) > 5 THEN 'HIGH' WHEN (SELECT count(*) FROM h) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM h
    """,
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    callee = F.floor(F.col("p_partkey") / (F.col("p_size") % 3 + 2)).cast("long")
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), callee.alias("dst"))
    return graphs.blast_radius(edges, 1)


@query(
    "semantic_diff",
    """
    WITH a AS (SELECT p_partkey, p_name AS s, p_retailprice AS b FROM part WHERE p_size <= 40),
    n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END AS s, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS b FROM part WHERE p_size >= 5)
    SELECT coalesce(a.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN a.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN a.s <> n.s THEN 'breaking' WHEN a.b <> n.b THEN 'body_only' ELSE 'unchanged' END AS change
    FROM a FULL OUTER JOIN n USING (p_partkey)
    """,
)
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("s"), F.col("p_retailprice").alias("b"))
    new = part.where("p_size >= 5").withColumn("s", F.when(F.col("p_partkey") % 7 == 0, F.concat("s", F.lit("!"))).otherwise(F.col("s"))).withColumn("b", F.when(F.col("p_partkey") % 5 == 0, F.col("b") + 1).otherwise(F.col("b")))
    return stats.interface_diff(part.where("p_size <= 40"), new, "p_partkey", "s", "b")



@query("reduction_pct", f"SELECT doc_id, n_chars AS before, after, CASE WHEN n_chars <> 0 THEN round((1 - after::DOUBLE / n_chars) * 100, 1) ELSE 0 END AS pct FROM (SELECT doc_id, n_chars, length({SENTENCE.format(n=140)})::BIGINT AS after FROM {BODY})")
def reduction_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.length(text.first_sentence(F.col("text"), 140)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("before"), after.alias("after"))
    return docs.withColumn("pct", costs.reduction_pct(F.col("before"), F.col("after")))


@query("catalog_union", "SELECT CASE WHEN conv_id % 3 = 2 THEN role ELSE '' END AS server, 't' || turn AS name, text AS description, conv_id FROM conversations")
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.to_json(F.struct(F.concat(F.lit("t"), F.col("turn")).alias("name"), F.col("text").alias("description")))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.collect_list(tool), ", ").alias("tools"))
    by_role = F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("role"), F.lit('": ['), F.col("tools"), F.lit("]"))), ", ")
    flat = F.array_join(F.collect_list("tools"), ", ")
    shape = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("["), flat, F.lit("]"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"tools": ['), flat, F.lit("]}"))).otherwise(F.concat(F.lit("{"), by_role, F.lit("}")))
    texts = lists.groupBy("conv_id").agg(shape.alias("text")).select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("path"), "text")
    return catalogs.catalog(texts).select("server", "name", "description", F.split("ord", "#")[0].cast("long").alias("conv_id"))


@query(
    "ref_cycles",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT (p_partkey // 8) * 8 + p_partkey % 8 AS src, (p_partkey // 8) * 8 + (p_partkey % 8 + p_size) % 8 AS dst FROM part WHERE p_size % 3 <> 0 UNION SELECT n_nationkey - 100, n_regionkey - 100 FROM nation),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst
    """,
)
def ref_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size % 3 <> 0")
    edges = part.selectExpr("p_partkey AS src", "p_partkey DIV 8 * 8 + (p_partkey % 8 + p_size) % 8 AS dst")
    return graphs.on_cycles(edges.unionByName(table(spark, sf_dir, "nation").selectExpr("n_nationkey - 100L AS src", "n_regionkey - 100L AS dst")))


# Schemas. Of ten parts, one has a key that compression can't carry, one a reference without a definition, one a schema
# that is no JSON, one a pattern and one a type that compression loses; what each query should find is worked out per part.

BAD_JSON = "JSONDecodeError: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"
LOST = {0: "'unhandled:minLength'", 2: f"'error:{BAD_JSON}'", 3: "'pattern:^x'", 6: "'typed:bare'"}
READABLE = "p_partkey % 10 <> 2"
SHORT = {1: """', "link": {"ref": "Gone"}'""", 3: """', "mixed": {"t": "string"}'""", 4: """', "pick": {"any": [{"t": "string"}, {"ref": "Price"}], "disc": {"prop": "how", "map": {"p": "Price"}}}'""", 5: """', "maybe": {"t": "string", "fmt": "date", "null": 1, "default": null}'""", 6: """', "bare": {}'"""}
PARAMS = f"""concat('{{"size": {{"t": "integer", "min": ', p_size % 5, ', "max": ', p_size, ', "d": "Size of the part.", "req": 1}}, "kind": {{"t": "string", "enum": ["', p_brand, '", "', p_type, '"]}}, "code": {{"t": "string", "pat": "^[A-Z]"}}, "prices": {{"t": "array", "of": {{"ref": "Price"}}}}', {by_case("p_partkey % 10", SHORT)}, '}}')"""
SENT_EXTRA = {1: """', "link": {"$ref": "#/$defs/Gone"}'""", 3: """', "mixed": {"type": "string"}'""", 4: """', "pick": {"anyOf": [{"type": "string"}, {"$ref": "#/$defs/Price"}]}'""", 5: """', "maybe": {"type": "string"}'""", 6: """', "bare": {}'"""}
SENT = f"""CASE WHEN {READABLE} THEN concat('{{"type": "object", "properties": {{"size": {{"type": "integer", "minimum": ', p_size % 5, ', "maximum": ', p_size, ', "description": "Size of the part."}}, "kind": {{"type": "string", "enum": ["', p_brand, '", "', p_type, '"]}}, "code": {{"type": "string"}}, "prices": {{"type": "array", "items": {{"$ref": "#/$defs/Price"}}}}', {by_case("p_partkey % 10", SENT_EXTRA)}, '}}, "required": ["size"]}}') END"""
PRICE = """(SELECT concat('{"t": "object", "props": {"amount": {"t": "number", "max": ', min_by(p_retailprice, p_partkey), '}}}') FROM part WHERE p_partkey % 10 <> 2)"""


@query("schema_verdicts", f"SELECT name, lost, unresolved, lost = '' AND unresolved = '' AS ok FROM (SELECT 'part_' || p_partkey AS name, {by_case('p_partkey % 10', LOST)} AS lost, {by_case('p_partkey % 10', {1: chr(39) + 'Gone' + chr(39)})} AS unresolved FROM part)")
def schema_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.verdicts(part_tools(spark, sf_dir)).select("name", F.array_join("lost", ",").alias("lost"), F.array_join("unresolved", ",").alias("unresolved"), "ok")


@query("contract_verdict", "SELECT count(*) AS tools, count_if(p_partkey % 10 NOT IN (0, 1, 2, 3, 6))::BIGINT AS callable, 0::BIGINT AS cyclic_defs, FALSE AS ok FROM part")
def contract_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.overall(part_tools(spark, sf_dir))


@query(
    "server_verdicts",
    """
    SELECT 'nation_' || s_nationkey AS server, count(*) AS tools, count_if(s_suppkey % 5 <> 0)::BIGINT AS callable, CASE WHEN s_nationkey % 2 = 1 THEN 2 ELSE 0 END::BIGINT AS cyclic_defs,
      s_nationkey % 2 = 0 AND count_if(s_suppkey % 5 = 0) = 0 AS ok FROM supplier GROUP BY s_nationkey
    """,
)
def server_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.overall_by_server(supplier_tools(spark, sf_dir))


REPORT = {k: f"concat_ws('/', {kept}, {all_})" for k, (kept, all_) in {
    "params": ("4 + more", "4 + more"), "types": ("4 + more - CASE WHEN p_partkey % 10 = 6 THEN 1 ELSE 0 END", "4 + more"), "required": ("1", "1"), "enums": ("2", "2"),
    "refs": ("1 + CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END",) * 2, "patterns": ("1", "1 + CASE WHEN p_partkey % 10 = 3 THEN 1 ELSE 0 END"), "bounds": ("2", "2"), "discriminators": ("CASE WHEN p_partkey % 10 = 4 THEN 1 ELSE 0 END",) * 2,
}.items()}


@query("contract_report", "SELECT 'part_' || p_partkey AS name, " + ", ".join(f"CASE WHEN {READABLE} THEN {v} ELSE '0/0' END AS {k}" for k, v in REPORT.items()) + ", CASE WHEN p_partkey % 10 IN (0, 1, 2, 3, 6) THEN 'FLAG' ELSE 'OK' END AS verdict FROM (SELECT *, CASE WHEN p_partkey % 10 IN (1, 3, 4, 5, 6) THEN 1 ELSE 0 END AS more FROM part)")
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.contract_report(part_tools(spark, sf_dir)).drop("lost", "unresolved")


@query("tool_texts", "SELECT p_partkey AS ord, 'part_' || p_partkey || ': Orders ' || p_name || '. By part.' AS text, 'part ' || p_partkey AS plain FROM part")
def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_tools(spark, sf_dir).select("ord", text.tool_text(F.col("name"), F.col("description")).alias("text"), text.plain_name(F.col("name")).alias("plain"))


@query("lost_atoms", "SELECT 'part_' || p_partkey AS name, unnest(['unhandled']) AS kind, 'minLength' AS value FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'part_' || p_partkey, 'pattern', '^x' FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT 'part_' || p_partkey, 'typed', 'bare' FROM part WHERE p_partkey % 10 = 6")
def lost_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.lost_atoms(part_tools(spark, sf_dir))


@query("unresolved_refs", "SELECT 'part_' || p_partkey AS name, 'Gone' AS ref FROM part WHERE p_partkey % 10 = 1")
def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.unresolved_refs(part_tools(spark, sf_dir))


EXTRA_PARAM = {1: "'link'", 3: "'mixed'", 4: "'pick'", 5: "'maybe'", 6: "'bare'"}


@query(
    "json_atoms",
    f"""
    WITH p AS (SELECT *, {by_case("p_partkey % 10", EXTRA_PARAM, "NULL")} AS more FROM part WHERE {READABLE}),
    a AS (
      SELECT p_partkey, unnest(['param', 'param', 'param', 'param', 'typed', 'typed', 'typed', 'typed', 'required', 'enum', 'enum', 'pattern', 'min', 'max', 'ref']) AS kind,
        unnest(['size', 'kind', 'code', 'prices', 'size', 'kind', 'code', 'prices', 'size', p_brand, p_type, '^[A-Z]', (p_size % 5)::VARCHAR, p_size::VARCHAR, 'Price']) AS value FROM p
      UNION ALL SELECT p_partkey, unnest(['param', 'typed']), more FROM p WHERE more IS NOT NULL
      UNION ALL SELECT p_partkey, 'ref', 'Gone' FROM p WHERE more = 'link' UNION ALL SELECT p_partkey, 'discriminator', 'how' FROM p WHERE more = 'pick'
      UNION ALL SELECT p_partkey, 'pattern', '^x' FROM p WHERE more = 'mixed' UNION ALL SELECT p_partkey, 'unhandled', 'minLength' FROM p WHERE p_partkey % 10 = 0),
    s AS (SELECT *, 'raw' AS side FROM a UNION ALL SELECT *, 'compressed' FROM a WHERE kind <> 'unhandled' AND value <> '^x' AND NOT (kind = 'typed' AND value = 'bare')
      UNION ALL SELECT p_partkey, 'error', '{BAD_JSON}', 'error' FROM part WHERE p_partkey % 10 = 2)
    SELECT 'part_' || p_partkey AS name, side, kind, value FROM s
    """,
)
def json_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.schema_atoms(part_tools(spark, sf_dir)).drop("tool")


@query("schema_index", "SELECT 'part_' || p_partkey AS name, rtrim(substring(CASE WHEN regexp_matches(p_name, '[.!?] ') THEN 'Orders ' || regexp_extract(p_name, '^(.*?[.!?]) ', 1) ELSE 'Orders ' || p_name || '.' END, 1, 70)) AS short FROM part")
def schema_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.index(part_tools(spark, sf_dir))


@query("schema_whole_index", f"SELECT 'tool' AS section, 'part_' || p_partkey AS name, 'Orders ' || p_name || '.' AS text FROM part UNION ALL SELECT 'definition', 'Price', {PRICE}")
def schema_whole_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.whole_index(part_tools(spark, sf_dir))


@query(
    "schema_nodes",
    f"""
    WITH n AS (
      SELECT p_partkey, unnest(['root', 'properties', 'properties', 'properties', 'properties', 'items', '$defs', 'properties']) AS role, unnest(['object', 'integer', 'string', 'string', 'array', NULL, 'object', 'number']) AS type, FALSE AS error FROM part WHERE {READABLE}
      UNION ALL SELECT p_partkey, 'properties', NULL, FALSE FROM part WHERE p_partkey % 10 IN (1, 3, 4, 5, 6)
      UNION ALL SELECT p_partkey, 'allOf', 'string', FALSE FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey, 'allOf', NULL, FALSE FROM part WHERE p_partkey % 10 = 6
      UNION ALL SELECT p_partkey, 'oneOf', unnest(['string', NULL]), FALSE FROM part WHERE p_partkey % 10 = 4 UNION ALL SELECT p_partkey, 'anyOf', unnest(['string', 'null']), FALSE FROM part WHERE p_partkey % 10 = 5
      UNION ALL SELECT p_partkey, 'root', NULL, TRUE FROM part WHERE p_partkey % 10 = 2)
    SELECT 'part_' || p_partkey AS name, role, type, error, count(*) AS n FROM n GROUP BY ALL
    """,
)
def schema_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.schema_nodes(part_tools(spark, sf_dir)).groupBy("name", "role", "type", F.col("error").isNotNull().alias("error")).agg(F.count("*").alias("n"))


@query("schema_compress", f"SELECT 'part_' || p_partkey AS name, 'Orders ' || p_name || '.' AS description, CASE WHEN {READABLE} THEN {PARAMS} END AS params, CASE WHEN NOT {READABLE} THEN '{BAD_JSON}' END AS error FROM part")
def schema_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.compressed_tools(part_tools(spark, sf_dir))


@query("served_tools", f"SELECT 'part_' || p_partkey AS name, 'Orders ' || p_name || '.' AS description, {SENT} AS input_schema, CASE WHEN NOT {READABLE} THEN '{BAD_JSON}' END AS error FROM part")
def served_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.served(part_tools(spark, sf_dir))


@query("api_tools", f"SELECT p_partkey AS ord, p_brand AS server, 'part_' || p_partkey AS name, 'Orders ' || p_name || '.' AS description, {SENT} AS input_schema, CASE WHEN p_partkey = max(p_partkey) OVER (PARTITION BY p_brand) THEN 'ephemeral' END AS cache_control FROM part")
def api_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.api_form(part_tools(spark, sf_dir), keys=("server",))


@query(
    "index_lookup",
    f"""
    SELECT wanted, CASE WHEN p_partkey IS NOT NULL THEN 'Orders ' || p_name || '. By part.' END AS description, {SCHEMA.replace("CASE WHEN p_partkey % 10 = 2", "CASE WHEN p_partkey IS NULL THEN NULL WHEN p_partkey % 10 = 2")} AS input_schema, CASE WHEN p_partkey IS NULL THEN 'no tool named ' || wanted END AS message
    FROM (SELECT DISTINCT l_partkey * 2 AS k, 'part_' || (l_partkey * 2) AS wanted FROM lineitem) LEFT JOIN part ON p_partkey = k
    """,
)
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "lineitem").select(F.expr("concat('part_', l_partkey * 2)").alias("wanted"))
    return schemas.find(part_tools(spark, sf_dir), names)


PIECES = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]'))::BIGINT"
COSTED = f"""
  SELECT p_brand AS server, p_partkey AS ord, {PIECES.format(f"""concat('{{"name": "part_', p_partkey, '", "description": "Orders ', p_name, '. By part.", "inputSchema": ', CASE WHEN {READABLE} THEN {SCHEMA} ELSE '{{}}' END, '}}')""")} AS raw,
    {PIECES.format(f"""concat('{{"name": "part_', p_partkey, '", "d": "Orders ', p_name, '.", "params": ', CASE WHEN {READABLE} THEN {PARAMS} ELSE '{{}}' END, '}}')""")} AS short,
    {PIECES.format("""concat('{"part_', p_partkey, '": "Orders ', p_name, '."}')""")} AS index FROM part"""


@query(
    "catalog_report",
    f"""
    WITH c AS ({COSTED}), t AS (SELECT server, count(*) AS tools, sum(raw)::BIGINT AS raw, sum(index)::BIGINT AS index FROM c GROUP BY 1),
    p AS (SELECT server, row_number() OVER w AS k, sum(short) OVER (PARTITION BY server ORDER BY short DESC, ord ROWS UNBOUNDED PRECEDING) AS prefix FROM c WINDOW w AS (PARTITION BY server ORDER BY short DESC, ord))
    SELECT server, tools, raw, index, k::INTEGER AS k, (index + prefix)::BIGINT AS tokens, round((1 - (index + prefix)::DOUBLE / raw) * 100, 1) AS reduction_pct FROM p JOIN t USING (server) WHERE k IN (1, 3, 5)
    """,
)
def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalog_report(reports.tool_costs(part_tools(spark, sf_dir)))


@query("token_totals", f"SELECT server, tools, raw, short, index, round((1 - index::DOUBLE / raw) * 100, 1) AS reduction_pct FROM (SELECT server, count(*) AS tools, sum(raw)::BIGINT AS raw, sum(short)::BIGINT AS short, sum(index)::BIGINT AS index FROM ({COSTED}) GROUP BY ROLLUP (server))")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.token_totals(reports.tool_costs(part_tools(spark, sf_dir)))


QUOTED = "to_json({})::VARCHAR"


@query(
    "query_comparison",
    f"""
    WITH b AS (SELECT item_id AS ord, text, {SENTENCE.format(n=140)} AS s140, {SENTENCE.format(n=70)} AS s70 FROM {BODY.replace("documents", "benchmark")}),
    c AS (SELECT ord, 'item_' || ord AS name, {PIECES.format(f"""concat('{{"name": "item_', ord, '", "description": ', {QUOTED.format("text")}, ', "inputSchema": {{}}}}')""")} AS raw,
      {PIECES.format(f"""concat('{{"name": "item_', ord, '", "d": ', {QUOTED.format("s140")}, ', "params": {{}}}}')""")} AS short, {PIECES.format(f"""concat('{{"item_', ord, '": ', {QUOTED.format("s70")}, '}}')""")} AS index FROM b),
    t AS (SELECT sum(raw)::BIGINT AS raw, sum(index)::BIGINT AS index FROM c),
    q AS (SELECT conv_id || '-' || turn AS query_id, {PIECES.format("text")} AS n, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS words FROM conversations WHERE conv_id % 20 = 0),
    s AS (SELECT query_id, item_id AS ord, len(list_filter(words, lambda w: contains('item ' || item_id, w) OR contains(lower(b.text), w))) AS score FROM q, benchmark b),
    r AS (SELECT query_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r FROM s) WHERE r = 1)
    SELECT query_id, name, n + t.raw AS tokens_without, n + t.index + short AS tokens_with, ((n + t.raw) * 300)::DOUBLE / 1e8 AS usd_without, ((n + t.index + short) * 300)::DOUBLE / 1e8 AS usd_with,
      round_even((1 - (t.index + short)::DOUBLE / t.raw) * 100, 0)::BIGINT AS reduction_pct, ((t.raw - t.index - short) * 300)::DOUBLE / 1e8 AS usd_saved
    FROM q JOIN r USING (query_id) JOIN c USING (ord), t
    """,
)
def query_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("conv_id % 20 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("all").alias("server"), text.distinct_words(F.col("text")).alias("words"))
    items = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("server"), F.col("item_id").alias("ord"), F.concat(F.lit("item_"), F.col("item_id")).alias("name"), F.col("text").alias("description"), F.lit(None).cast("string").alias("input_schema"))
    routed = routing.keyword_route(q, items.select(F.col("ord").alias("id"), text.plain_name(F.col("name")).alias("name"), F.lower("description").alias("description")))
    return reports.query_comparison(routed, q, reports.tool_costs(items))


# Source files: see fixtures.CODE for what a part's module holds.

FUNCTIONS = f"unnest(['helper', {MADE}, 'orch', 'fetch', '__init__', 'run', '_check'])"
RISK = by_case("p_size % 7", {0: "'high'", 1: "'medium'", 3: "'high'", 4: "'medium'", 6: "'high'"}, "'clean'")
RISKY = by_case("p_size % 7", {0: "'importlib.import_module'", 1: "'httpx.get'", 3: "'os.system'", 4: "'open'", 6: "'subprocess.run'"})
OS = "CASE WHEN p_size % 7 = 3 THEN 'os' ELSE '' END"
DATA = "CASE WHEN p_partkey % 3 = 0 THEN 'LIMIT' ELSE '' END"
HARMLESS = by_case("p_size % 7", {3: "'    # needs: {\"externe\": [\"os\"]}'", 4: "concat('    open(x, mode=', chr(39), 'w', chr(39), ')')"}, TASK)
NEEDS_RUN = "concat('        # needs: {', CASE WHEN p_partkey % 3 = 0 THEN '\"data\": [\"LIMIT\"], ' ELSE '' END, '\"interne\": [\"helper\"], \"externe\": [\"os\"]}')"
COMPRESSED_CODE = f"""CASE WHEN {PARSES} THEN """ + lines(
    "'import os, json as js'", THING, LIMIT, "'A, B = (1, 2)'", "'class Base_():'", "'class Worker(Base_):'", "concat('    \"\"\"Works on ', p_brand, '.\"\"\"')",
    "'    def __init__(self, n):'", "'        self.n = n'", "'        self.more = n'", "'    def run(self, x):'", "'        \"\"\"Runs it.\"\"\"'", NEEDS_RUN,
    "'    def _check(self, x):'", "'        if not x:'", "concat('            raise ValueError(', chr(39), 'no', chr(39), ')')", "'        return self.rate'",
    "'def helper(x, y=1, *rest, flag=False, **more):'", "'    return x + y'", f"concat('def ', {MADE}, '(x):')", HARMLESS,
    "'def orch(x):'", f"concat('    # needs: {{\"type\": [\"Worker\"], \"interne\": [\"helper\", \"', {MADE}, '\"]}}')", "'async def fetch(url):'", "'    yield helper(url)'",
) + f" WHEN {IS_SCRIPT} THEN " + lines(*SCRIPT_LINES, "'export function load(url, n = 1) { ... }'", "'class Box {'", "'  open(x) { ... }'", "'}'") + " END"


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files with what the index of parses holds of them."""
    return parses.indexed(part_code(spark, sf_dir))


@query("internal_calls", f"SELECT {FILE} AS file, unnest(['run', 'orch', 'orch', 'fetch']) AS caller, unnest(['helper', 'helper', {MADE}, 'helper']) AS callee FROM part WHERE {PARSES} UNION ALL SELECT {FILE}, 'open', 'load' FROM part WHERE {IS_SCRIPT}")
def internal_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.call_edges(parsed(spark, sf_dir))


@query(
    "dep_classify",
    f"""
    SELECT {FILE} AS file, {FUNCTIONS} AS name, unnest(['', '', '', '', '', {DATA}, '']) AS data, unnest(['', '', 'Worker', '', '', '', '']) AS type,
      unnest(['', '', 'helper,' || {MADE}, 'helper', '', 'helper', '']) AS interne, unnest(['', {OS}, '', '', '', 'os', '']) AS externe, unnest(['PURE', CASE WHEN {OS} = '' THEN 'PURE' ELSE 'TOOL' END, 'ORCH', 'PURE', 'PURE', 'TOOL', 'PURE']) AS role
    FROM part WHERE {PARSES} UNION ALL SELECT {FILE}, unnest(['load', 'open']), '', '', unnest(['', 'load']), unnest(['http', '']), unnest(['TOOL', 'PURE']) FROM part WHERE {IS_SCRIPT}
    """,
)
def dep_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.dependencies(parsed(spark, sf_dir))
    return found.select("file", "name", *[F.array_join(k, ",").alias(k) for k in ("data", "type", "interne", "externe")], "role")


@query("code_self_roles", f"SELECT {FILE} AS file, {FUNCTIONS} AS name, unnest(['PURE', CASE WHEN {OS} = '' THEN 'PURE' ELSE 'TOOL' END, 'ORCH', 'PURE', 'PURE', 'ORCH', 'TOOL']) AS role, unnest(['', '', '', '', '', 'self._check', 'self.rate']) AS selfs FROM part WHERE {PARSES} UNION ALL SELECT {FILE}, unnest(['load', 'open']), unnest(['TOOL', 'PURE']), '' FROM part WHERE {IS_SCRIPT}")
def code_self_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.dependencies(parsed(spark, sf_dir), resolve_self=True)
    return found.select("file", "name", "role", F.array_join(F.filter(F.concat("interne", "data"), lambda x: x.startswith("self.")), ",").alias("selfs"))


@query("risk_surface", f"SELECT {FILE} AS file, {FUNCTIONS} AS name, unnest(['clean', {RISK}, 'clean', 'clean', 'clean', 'clean', 'clean']) AS level, unnest(['', {RISKY}, '', '', '', '', '']) AS calls FROM part WHERE {PARSES}")
def risk_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.security_surface(parsed(spark, sf_dir)).select("file", "name", "level", F.array_join("calls", ",").alias("calls"))


@query("risk_summary", f"SELECT count_if({RISK} = 'high')::BIGINT AS high_risk_count, count_if({RISK} = 'medium')::BIGINT AS medium_risk_count, count(*) * 7 AS total_functions_scanned, count(*) AS total_files_scanned, count_if({RISK} = 'clean')::BIGINT AS clean_files FROM part WHERE {PARSES}")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.security_summary(parsed(spark, sf_dir))


@query("clean_files", f"SELECT {FILE} AS file FROM part WHERE {PARSES} AND {RISK} = 'clean'")
def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.clean_files(parsed(spark, sf_dir))


HISTOGRAM = f"SELECT module, count(*) AS n FROM (SELECT split_part({RISKY}, '.', 1) AS module FROM part WHERE {PARSES} AND {RISK} <> 'clean' UNION ALL SELECT 'requests' FROM part WHERE {PARSES} AND p_size % 7 = 6) GROUP BY 1"


@query("risk_histogram", HISTOGRAM)
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.risk_histogram(parsed(spark, sf_dir))


@query("repo_totals", f"SELECT count_if({PARSES} OR {IS_SCRIPT})::BIGINT AS files, (count_if({PARSES}) * 4 + count_if({IS_SCRIPT}) * 2)::BIGINT AS functions, (count_if({PARSES}) * 2 + count_if({IS_SCRIPT}))::BIGINT AS classes, count_if(NOT {PARSES} AND NOT {IS_SCRIPT})::BIGINT AS errors, 2 + max(CASE WHEN {PARSES} AND p_partkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT + max(CASE WHEN {IS_SCRIPT} THEN 1 ELSE 0 END)::BIGINT AS imports FROM part")
def repo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.repo_totals(parsed(spark, sf_dir))


CALLS = f"unnest(['', '', 'helper,' || {MADE}, 'helper', '', 'helper', ''])"
TAKES = "unnest(['x,y', 'x', 'x', 'url', 'self,n', 'self,x', 'self,x'])"


@query("code_contract", f"SELECT {FILE} AS file, unnest(range(7))::INTEGER AS ord, {FUNCTIONS} AS name, {TAKES} AS params, {CALLS} AS calls FROM part WHERE {PARSES} UNION ALL SELECT {FILE}, unnest([0, 1])::INTEGER, unnest(['load', 'open']), unnest(['url,n', 'x']), unnest(['', 'load']) FROM part WHERE {IS_SCRIPT}")
def code_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.flat_contract(parsed(spark, sf_dir)).select("file", "ord", "name", F.array_join("params", ",").alias("params"), F.array_join("calls", ",").alias("calls"))


@query("code_compress", f"SELECT {FILE} AS file, {PARSES} OR {IS_SCRIPT} AS ok, {COMPRESSED_CODE} AS compressed FROM part")
def code_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("file", F.coalesce("error", "compress_error").isNull().alias("ok"), "compressed")


@query(
    "code_sizes",
    f"SELECT file, tokens_before, tokens_after, round((1 - tokens_after::DOUBLE / tokens_before) * 100, 1) AS reduction_pct FROM (SELECT {FILE} AS file, {PIECES.format(CODE)} AS tokens_before, {PIECES.format(COMPRESSED_CODE)} AS tokens_after FROM part WHERE {PARSES} OR {IS_SCRIPT})",
)
def code_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.sizes(parsed(spark, sf_dir), pieces).where("error is null").select("file", "tokens_before", "tokens_after", "reduction_pct")


@query(
    "code_costs",
    f"SELECT file, (b * 100 + 250000)::DOUBLE / 1e8 AS cost_before, (a * 100 + 250000)::DOUBLE / 1e8 AS cost_after, round((b - a) * 100.0 / b, 6) AS pct, ((b - a) * 100)::DOUBLE / 1e8 AS savings FROM (SELECT {FILE} AS file, {PIECES.format(CODE)} AS b, {PIECES.format(COMPRESSED_CODE)} AS a FROM part WHERE {PARSES} OR {IS_SCRIPT})",
)
def code_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.file_costs(code.sizes(parsed(spark, sf_dir), pieces).where("error is null"))


@query(
    "code_expand",
    f"""
    SELECT {FILE} AS file, unnest(['orch', 'Base_', 'absent']) AS name, unnest([CASE WHEN {PARSES} THEN 'function' END, CASE WHEN {PARSES} THEN 'class' END, NULL]) AS kind,
      unnest([CASE WHEN {PARSES} THEN concat('def orch(x):', chr(10), '    helper(x); ', {MADE}, '(x)', chr(10), '    return Worker') END, CASE WHEN {PARSES} THEN concat('class Base_:', chr(10), '    pass') END, NULL]) AS source,
      unnest([CASE WHEN {PARSES} THEN concat('helper,', {MADE}) END, NULL, NULL]) AS interne, unnest([NOT {PARSES}, NOT {PARSES}, TRUE]) AS missing FROM part
    """,
)
def code_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_code(spark, sf_dir)
    wanted = files.select("file", F.explode(F.array(*map(F.lit, ("orch", "Base_", "absent")))).alias("name"))
    return code.expand(parses.indexed(files), wanted).select("file", "name", "kind", "source", F.array_join("interne", ",").alias("interne"), "missing")


@query(
    "code_outline",
    f"""
    SELECT {FILE} AS file, CASE WHEN {PARSES} THEN concat('os,json', CASE WHEN p_partkey % 2 = 0 THEN ',pkg.mod.thing' ELSE '' END) END AS imports, CASE WHEN {PARSES} THEN 'Base_:;Worker:__init__,run,_check' END AS classes,
      CASE WHEN {PARSES} THEN concat('helper,', {MADE}, ',orch') END AS functions, CASE WHEN {PARSES} THEN 'helper,self._check,os.path.join,str' END AS run_calls, CASE WHEN {PARSES} THEN 'ValueError' END AS check_raises FROM part
    """.replace("os.path.join", "?.join"),
)
def code_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir).select("file", "outline.*")
    names = lambda c: F.array_join(F.transform(c, lambda f: f["name"]), ",")
    methods = F.col("classes")[1]["methods"]
    classes = F.array_join(F.transform("classes", lambda c: F.concat(c["name"], F.lit(":"), names(c["methods"]))), ";")
    return found.select("file", F.array_join("imports", ",").alias("imports"), classes.alias("classes"), names(F.col("functions")).alias("functions"), F.array_join(methods[1]["calls"], ",").alias("run_calls"), F.array_join(methods[2]["raises"], ",").alias("check_raises"))


HEALTH = f"SELECT 'python' AS lang, count(*) AS files, count(*) * 4 AS functions, count(*) * 2 AS classes, sum({PIECES.format(CODE)})::BIGINT AS raw, sum({PIECES.format(COMPRESSED_CODE)})::BIGINT AS compressed FROM part WHERE {PARSES}"
HEALTH += f" UNION ALL SELECT 'javascript', count(*), count(*) * 2, count(*), sum({PIECES.format(CODE)})::BIGINT, sum({PIECES.format(COMPRESSED_CODE)})::BIGINT FROM part WHERE {IS_SCRIPT}"


@query("code_health", f"SELECT lang, files, functions, classes, raw, compressed, round((1 - compressed::DOUBLE / raw) * 100, 1) AS gain_pct FROM (SELECT lang, sum(files)::BIGINT AS files, sum(functions)::BIGINT AS functions, sum(classes)::BIGINT AS classes, sum(raw)::BIGINT AS raw, sum(compressed)::BIGINT AS compressed FROM ({HEALTH}) GROUP BY ROLLUP (lang))")
def code_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.health_totals(code.language_sums(parsed(spark, sf_dir), pieces))


@query(
    "status_lines",
    f"""
    WITH h AS (SELECT lang, sum(files)::BIGINT AS files, sum(functions)::BIGINT AS functions, sum(classes)::BIGINT AS classes, sum(raw)::BIGINT AS raw, sum(compressed)::BIGINT AS compressed FROM ({HEALTH}) GROUP BY ROLLUP (lang)), n AS ({HISTOGRAM}), e AS (SELECT {FILE} AS file, 'SyntaxError: invalid syntax (<unknown>, line 1)' AS error FROM part WHERE p_partkey % 10 = 9)
    SELECT 'language' AS section, row_number() OVER (ORDER BY lang NULLS LAST)::INTEGER AS ord, coalesce(lang, 'Total') AS label, concat_ws(' ', format('{{:,}}', files), format('{{:,}}', functions), format('{{:,}}', classes), format('{{:,}}', raw), format('{{:,}}', compressed), round((1 - compressed::DOUBLE / raw) * 100, 1)::VARCHAR || '%') AS value FROM h
    UNION ALL SELECT 'security', row_number() OVER (ORDER BY n DESC, module)::INTEGER, module, format('{{:,}}', n) FROM n
    UNION ALL (SELECT 'errors', row_number() OVER (ORDER BY file)::INTEGER, file, error FROM e ORDER BY file LIMIT 5)
    UNION ALL SELECT 'errors', 6, 'more', format('{{:,}}', count(*) - 5) FROM e
    """,
)
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir)
    return code.status_lines(code.language_sums(found, pieces), code.risk_histogram(found), found)


@query("status_json")
def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir)
    return code.status_json(code.language_sums(found, pieces), code.risk_histogram(found), found)


@query("contract_json")
def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.contract_json(parsed(spark, sf_dir))


def conversation_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module for each conversation: a function for each turn, which calls that of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 7 == 3, "    os.system(x)").when(F.col("turn") % 7 == 5, "    open(x, 'w')").otherwise(F.concat(F.lit("    return x + "), F.col("turn")))
    call = F.when(F.col("turn") > 0, F.concat(F.lit("    f"), F.col("turn") - 1, F.lit("(x)\n"))).otherwise(F.lit(""))
    line = F.concat(F.lit("def f"), F.col("turn"), F.lit("(x):\n"), call, body)
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    code = F.concat(F.lit("import os\n"), F.array_join(F.transform(lines, lambda s: s["line"]), "\n"))
    return turns.groupBy("conv_id").agg(code.alias("text")).select(F.concat(F.lit("c"), F.col("conv_id"), F.lit(".py")).alias("file"), "text")


@query("code_calls", "SELECT 'c' || conv_id || '.py' AS file, 'f' || turn AS caller, 'f' || (turn - 1) AS callee FROM conversations a WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)")
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.call_edges(parses.indexed(conversation_code(spark, sf_dir)))


@query("code_risks", "SELECT 'c' || conv_id || '.py' AS file, 'f' || turn AS name, CASE turn % 7 WHEN 3 THEN 'high' WHEN 5 THEN 'medium' ELSE 'clean' END AS level, CASE turn % 7 WHEN 3 THEN 'os.system' WHEN 5 THEN 'open' ELSE '' END AS calls FROM conversations")
def code_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.security_surface(parses.indexed(conversation_code(spark, sf_dir))).select("file", "name", "level", F.array_join("calls", ",").alias("calls"))


@query("code_roles", "SELECT 'c' || conv_id || '.py' AS file, 'f' || turn AS name, CASE WHEN turn % 7 = 3 THEN 'TOOL' ELSE 'PURE' END AS role FROM conversations")
def code_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.dependencies(parses.indexed(conversation_code(spark, sf_dir))).select("file", "name", "role")


@query("code_totals", "SELECT count(DISTINCT conv_id) AS files, count(*) AS functions, 0::BIGINT AS classes, 0::BIGINT AS errors, 1::BIGINT AS imports FROM conversations")
def code_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.repo_totals(parses.indexed(conversation_code(spark, sf_dir)))


# Two versions of a source tree: the new one lacks the smallest parts, has larger ones, and differs in format, bodies, heads and a name.
NEW_CODE = f"""CASE WHEN {PARSES} THEN replace(replace(replace({CODE}, 'return x + y', CASE WHEN p_partkey % 5 = 0 THEN 'return x - y' ELSE concat('return (x  +  y)  # sum', chr(10)) END), 'y=1', CASE WHEN p_partkey % 7 = 0 THEN 'y=2' ELSE 'y = 1' END), 'async def fetch(', CASE WHEN p_partkey % 11 = 0 THEN 'async def fetched(' ELSE 'async def fetch(' END) ELSE {CODE} END"""
LISTED = f"""
  SELECT {FILE} AS file, unnest(['', '', '', '', 'Worker', 'Worker', 'Worker']) AS owner, unnest(['helper', {MADE}, 'orch', {{fetch}}, '__init__', 'run', '_check']) AS name, unnest([{{head}}, '', '', '', '', '', '']) AS head,
    unnest([{{body}}, 'm' || p_size % 7, 'o' || {MADE}, 'f', 'i', 'r', 'c']) AS shape FROM part WHERE {PARSES} AND {{kept}}
  UNION ALL SELECT {FILE}, '', unnest(['load', 'open']), '', unnest(['load', 'open']) FROM part WHERE {IS_SCRIPT} AND {{kept}}"""
ONE_EACH = "count_if(change = 'removed') = 1 AND count_if(change = 'added') = 1"


@query(
    "code_diff",
    f"""
    WITH o AS ({LISTED.format(fetch="'fetch'", head="'1'", body="'h'", kept="p_size <= 40")}),
    n AS ({LISTED.format(fetch="CASE WHEN p_partkey % 11 = 0 THEN 'fetched' ELSE 'fetch' END", head="CASE WHEN p_partkey % 7 = 0 THEN '2' ELSE '1' END", body="CASE WHEN p_partkey % 5 = 0 THEN 'h-' ELSE 'h' END", kept="p_size >= 5")}),
    b AS (SELECT file, owner, name, o.head AS oh, n.head AS nh, o.shape AS os, n.shape AS ns FROM o FULL JOIN n USING (file, owner, name)),
    a AS (SELECT file, owner, name, CASE WHEN oh IS NULL THEN 'added' ELSE 'removed' END AS change, coalesce(os, ns) AS shape FROM b WHERE oh IS NULL OR nh IS NULL),
    r AS (SELECT file, owner, shape, max(name) FILTER (change = 'added') AS name, max(name) FILTER (change = 'removed') AS was FROM a GROUP BY 1, 2, 3 HAVING {ONE_EACH}),
    c AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file = a.file AND r.owner = a.owner AND r.shape = a.shape)),
    m AS (SELECT name, shape, max(file) FILTER (change = 'added') AS file, max(file) FILTER (change = 'removed') AS was FROM c GROUP BY 1, 2 HAVING {ONE_EACH})
    SELECT file, name, CASE WHEN oh <> nh THEN 'breaking' WHEN os <> ns THEN 'body_only' ELSE 'unchanged' END AS change, NULL::VARCHAR AS was FROM b WHERE oh IS NOT NULL AND nh IS NOT NULL
    UNION ALL SELECT file, name, 'renamed', was FROM r UNION ALL SELECT file, name, 'moved', was FROM m
    UNION ALL SELECT file, name, change, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.name = c.name AND m.shape = c.shape)
    """,
)
def code_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where("p_size <= 40").select(F.expr(FILE).alias("file"), F.expr(CODE).alias("text"))
    new = part.where("p_size >= 5").select(F.expr(FILE).alias("file"), F.expr(NEW_CODE).alias("text"))
    return code.tree_diff(*parses.versions(old, new))
