"""Linking tool calls with their results for chat training data, with DataFrame functions only.

- Calls and results are joined by (conv_id, call_id). Results are counted per identifier before the join, so a repeated identifier multiplies
  nothing; the first result by turn and content is linked.
- Order: a call comes after all it depends on. Its key is (turn, depth); a dependency that stands later or at the same place lifts the key to
  just behind it. Only calls whose key still rises are looked at again, so calls that are in order cost no round, whatever the length of a
  conversation. A call that meets itself on the way is on a cycle; all calls of the cycles it is on are reported. Sorting by (order_turn, order_depth, call_id) is a
  topological order; no rank is made that would need a conversation in one task.
- Arguments are parsed as JSON and checked against the tool's parameters: unknown, missing and mistyped ones are named.
- Each linked call is one canonical JSON record: sorted keys, no white space, null fields left out.

Edge cases: a null conv_id is a conversation of its own kind (nulls match nulls); a call with a null call_id links nothing and is reported;
repeated rows are each returned and reported as repeated; arguments that are no JSON object are reported; results without a call are
returned as rows without a name; empty tables give empty results; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import drop, keep, table

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def _kind(value):
    """JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (F.when(value.isNull() | (name == "VOID"), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(name.rlike(r"^DECIMAL\(\d+,0\)"), "integer").otherwise("number"))


def _same(a: str, b: str, *columns: str):
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return condition


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_depth, cycle) per distinct identifier that is lifted behind a dependency."""
    nodes = keep(calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("depends_on")))).alias("depends_on")), "nodes")
    edges = nodes.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("dep")).alias("e").join(
        nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn")).alias("d"), _same("e", "d", "conv_id", "dep")).select("e.*", "d.dep_turn")
    edges = keep(edges, "edges")
    # key: (turn, depth); the path holds the calls that the lift came through
    late = edges.where("dep_turn >= turn").groupBy("conv_id", "call_id").agg(
        F.max(F.struct(F.col("dep_turn").alias("turn"), F.lit(1).alias("depth"), F.array("dep").alias("path"))).alias("key"))
    late = late.withColumn("cycle", F.array_contains("key.path", F.col("call_id")))
    state = keep(late, "order")
    changed = state
    while not changed.isEmpty():
        moved = changed.where("not cycle").select("conv_id", F.col("call_id").alias("dep"), "key")
        lifted = edges.alias("e").join(moved.alias("m"), _same("e", "m", "conv_id", "dep")).select(
            "e.conv_id", "e.call_id", "e.turn", F.struct(F.col("m.key.turn").alias("turn"), (F.col("m.key.depth") + 1).alias("depth"), F.array_append("m.key.path", F.col("m.dep")).alias("path")).alias("key"))
        lifted = lifted.where((F.col("key.turn") >= F.col("turn"))).groupBy("conv_id", "call_id").agg(F.max("key").alias("key"))
        lifted = lifted.withColumn("cycle", F.array_contains("key.path", F.col("call_id")))
        newer = lifted.alias("n").join(state.alias("s"), _same("n", "s", "conv_id", "call_id"), "left").where(
            F.col("s.key").isNull() | (~F.col("s.cycle") & (F.struct("n.key.turn", "n.key.depth") > F.struct("s.key.turn", "s.key.depth")))).select("n.*")
        changed = keep(newer, "lifted")
        following = keep(state.alias("s").join(changed.alias("n"), _same("s", "n", "conv_id", "call_id"), "left_anti").unionByName(changed), "order")
        drop(state)
        state = following
    lifted = state.select("conv_id", "call_id", F.col("key.turn").alias("order_turn"), F.col("key.depth").alias("order_depth"), "cycle")
    met = lifted.where("cycle")
    if met.isEmpty():
        return lifted
    # a call is on a cycle if some call that met itself depends on it and is a dependency of it, over any number of links
    rounds = _linked(met, edges, "dep", "call_id").alias("a").join(_linked(met, edges, "call_id", "dep").alias("b"), _same("a", "b", "conv_id", "call_id", "start"))
    on = rounds.select("a.conv_id", "a.call_id").distinct().withColumn("on", F.lit(True))
    whole = on.alias("o").join(lifted.alias("l"), _same("o", "l", "conv_id", "call_id"), "full")
    either = lambda c: F.when(F.col("o.on"), F.col(f"o.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    return whole.select(either("conv_id"), either("call_id"), "l.order_turn", "l.order_depth", F.coalesce("o.on", F.lit(False)).alias("cycle"))


def _linked(starts: DataFrame, edges: DataFrame, at: str, to: str) -> DataFrame:
    """(conv_id, start, call_id): what can be reached from each start over edges from column ``at`` to column ``to``, the start included."""
    found = keep(starts.select("conv_id", F.col("call_id").alias("start"), "call_id"), "reached")
    fresh = found
    while not fresh.isEmpty():
        steps = edges.select("conv_id", F.col(at).alias("call_id"), F.col(to).alias("next")).distinct().alias("e").join(fresh.alias("f"), _same("e", "f", "conv_id", "call_id")).select(
            "f.conv_id", "f.start", F.col("e.next").alias("call_id")).distinct()
        fresh = keep(steps.alias("n").join(found.alias("s"), _same("n", "s", "conv_id", "start", "call_id"), "left_anti"), "reached")
        found = keep(found.unionByName(fresh), "reached")
    return found


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row per call (and per identifier that only results have): conv_id, call_id, name, order_turn, order_depth, n_results, valid, errors, record.

    ``parameters``: name, parameter, type (a JSON type, ``number`` takes integers), required; one row per parameter of a tool.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    tools = parameters.groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("parameter", "type"))).alias("types"),
                                           F.sort_array(F.collect_set(F.when(F.col("required"), F.col("parameter")))).alias("required"))
    first = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("result"))
    known = calls.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_calls"))
    lifted = order_keys(calls)
    asked = calls.select("conv_id", F.explode(F.array_distinct("depends_on")).alias("call_id")).distinct().alias("a").join(known.alias("k"), _same("a", "k", "conv_id", "call_id"), "left_anti")
    users = calls.select("conv_id", F.col("call_id").alias("user"), F.explode("depends_on").alias("call_id")).distinct()
    unknown = users.alias("u").join(asked.alias("a"), _same("u", "a", "conv_id", "call_id")).groupBy("u.conv_id", F.col("u.user").alias("call_id")).agg(F.sort_array(F.collect_set("u.call_id")).alias("unknown"))
    row = calls.alias("c").join(first.alias("r"), _same("c", "r", "conv_id", "call_id") & F.col("c.call_id").isNotNull(), "left").select("c.*", "r.n_results", "r.result")
    row = row.alias("c").join(known.alias("k"), _same("c", "k", "conv_id", "call_id"), "left").select("c.*", "k.n_calls")
    row = row.alias("c").join(lifted.alias("l"), _same("c", "l", "conv_id", "call_id"), "left").select("c.*", "l.order_turn", "l.order_depth", "l.cycle")
    row = row.alias("c").join(unknown.alias("u"), _same("c", "u", "conv_id", "call_id"), "left").select("c.*", "u.unknown")
    row = row.alias("c").join(tools.alias("t"), F.col("c.name") == F.col("t.name"), "left").select("c.*", "t.types", "t.required")
    row = row.withColumn("parsed", F.try_parse_json("arguments")).withColumn("is_object", F.coalesce(_kind(F.col("parsed")) == "object", F.lit(False)))
    row = row.withColumn("given", F.when(F.col("is_object"), F.col("parsed").cast("map<string,variant>"))).withColumn(
        "given_types", F.transform_values("given", lambda k, v: _kind(v))).withColumn("names", F.sort_array(F.map_keys("given_types")))
    none = F.array().cast("array<string>")

    def named(text: str, items):
        return F.coalesce(F.transform(items, lambda x: F.concat(F.lit(text + " "), x)), none)

    def when(condition, text: str):
        return F.when(condition, F.array(F.lit(text))).otherwise(none)

    wrong = F.filter("names", lambda k: F.map_contains_key("types", k) & (F.col("given_types")[k] != F.col("types")[k]) & ~((F.col("types")[k] == "number") & (F.col("given_types")[k] == "integer")))
    errors = F.concat(
        when(F.col("call_id").isNull(), "no identifier"), when((F.col("n_calls") > 1) & F.col("call_id").isNotNull(), "repeated identifier"), when(F.col("n_results").isNull(), "no result"),
        when(F.col("n_results") > 1, "several results"), when(F.coalesce("cycle", F.lit(False)), "cycle"), named("unknown dependency", F.col("unknown")),
        when(F.col("types").isNull(), "unknown tool"), when(~F.col("is_object"), "arguments are no object"),
        named("unknown parameter", F.filter("names", lambda k: ~F.map_contains_key("types", k))), named("missing parameter", F.array_except("required", F.coalesce("names", none))), named("wrong type", wrong))
    row = row.withColumn("errors", errors).withColumn("n_results", F.coalesce("n_results", F.lit(0))).withColumn("order_turn", F.coalesce("order_turn", "turn")).withColumn(
        "order_depth", F.coalesce("order_depth", F.lit(0)))
    record = F.to_json(F.struct(
        F.when(F.col("is_object"), F.col("parsed")).alias("arguments"), "call_id", "conv_id", F.array_sort(F.array_distinct("depends_on")).alias("depends_on"), "errors", "name",
        F.array("order_turn", F.col("order_depth").cast("long")).alias("order"), F.col("result.content").alias("result")))
    linked = row.select("conv_id", "call_id", "name", "order_turn", "order_depth", "n_results", (F.size("errors") == 0).alias("valid"), "errors", record.alias("record"))
    orphans = first.alias("r").join(known.where("call_id is not null").alias("k"), _same("r", "k", "conv_id", "call_id"), "left_anti").withColumn("errors", F.array(F.lit("result without a call")))
    orphans = orphans.select("conv_id", "call_id", F.lit(None).cast("string").alias("name"), F.col("result.turn").alias("order_turn"), F.lit(0).alias("order_depth"), "n_results", F.lit(False).alias("valid"), "errors",
                             F.to_json(F.struct("call_id", "conv_id", "errors", F.array(F.col("result.turn"), F.lit(0).cast("long")).alias("order"), F.col("result.content").alias("result"))).alias("record"))
    return linked.unionByName(orphans)


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of chat messages: assistant texts {"tool_calls": [{"id", "name", "arguments", "depends_on"}]} and tool texts
    {"tool_call_id", "content"}. Texts that are no such JSON hold none."""
    said = messages.select("conv_id", "turn", "role", F.try_parse_json("text").alias("v"))
    made = said.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("c"))
    calls = made.select("conv_id", F.try_variant_get("c", "$.id", "string").alias("call_id"), "turn", F.try_variant_get("c", "$.name", "string").alias("name"),
                        F.to_json(F.try_variant_get("c", "$.arguments", "variant")).alias("arguments"), F.try_variant_get("c", "$.depends_on", "array<string>").alias("depends_on"))
    results = said.where("role = 'tool'").select("conv_id", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), "turn", F.try_variant_get("v", "$.content", "string").alias("content"))
    return calls, results


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call of a tool and every assistant turn as the result of the turn before it, for tables without tool messages.

    The identifier is a hash of conversation and turn; a call depends on the call two turns before.
    """
    def identifier(back: int):
        return F.concat(F.lit("call_"), F.substring(F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string")).cast("binary")), 1, 24))

    size = F.coalesce(F.length("text"), F.lit(0))
    name = F.element_at(F.array(F.lit("lookup"), F.lit("summarise"), F.lit("translate")), (size % 3 + 1).cast("int"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", identifier(0).alias("call_id"), "turn", name.alias("name"), F.to_json(F.struct(size.cast("long").alias("chars"), F.col("text").alias("query"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(identifier(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    return calls, conversations.where("role = 'assistant'").select("conv_id", identifier(1).alias("call_id"), "turn", F.col("text").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    calls, results = exchanges(said)
    real_calls, real_results = from_messages(said)
    # one row per tool and parameter: what the tools of the table's exchanges take
    tools = spark.sql("""SELECT * FROM VALUES ('lookup', 'chars', 'integer', true), ('lookup', 'query', 'string', true), ('summarise', 'chars', 'integer', true),
        ('summarise', 'query', 'string', true), ('translate', 'chars', 'integer', true), ('translate', 'query', 'string', true) AS t(name, parameter, type, required)""")
    linked = link(calls.unionByName(real_calls), results.unionByName(real_results), tools)
    return linked.withColumn("errors", F.array_join("errors", "; "))


ORACLE = """
WITH ids AS (SELECT *, 'call_' || substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 24) AS own,
    'call_' || substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR)), 1, 24) AS asked,
    'call_' || substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 2 AS VARCHAR)), 1, 24) AS dep FROM conversations),
calls AS (SELECT conv_id, turn, own AS call_id, ['lookup', 'summarise', 'translate'][coalesce(len(text), 0) % 3 + 1] AS name, coalesce(len(text), 0) AS chars, text,
    CASE WHEN turn >= 2 THEN dep END AS dep, count(*) OVER (PARTITION BY conv_id, own) AS n_calls FROM ids WHERE role = 'user'),
results AS (SELECT conv_id, asked AS call_id, count(*) AS n_results, min(turn) AS turn, min((turn, text)) AS first FROM ids WHERE role = 'assistant' GROUP BY ALL),
linked AS (SELECT c.*, coalesce(n_results, 0) AS n_results, r.first[2] AS content, c.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls k WHERE k.conv_id = c.conv_id AND k.call_id = c.dep) AS lost
    FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id),
judged AS (SELECT *, list_filter([CASE WHEN n_calls > 1 THEN 'repeated identifier' END, CASE WHEN n_results = 0 THEN 'no result' END, CASE WHEN n_results > 1 THEN 'several results' END,
    CASE WHEN lost THEN 'unknown dependency ' || dep END, CASE WHEN text IS NULL THEN 'missing parameter query' END], lambda x: x IS NOT NULL) AS e FROM linked)
SELECT conv_id, call_id, name, turn AS order_turn, CAST(0 AS INTEGER) AS order_depth, n_results, len(e) = 0 AS valid, array_to_string(e, '; ') AS errors,
    '{"arguments":{"chars":' || chars || CASE WHEN text IS NULL THEN '' ELSE ',"query":' || to_json(text) END || '},"call_id":"' || call_id || '","conv_id":' || conv_id || ',"depends_on":'
    || CASE WHEN dep IS NULL THEN '[]' ELSE '["' || dep || '"]' END || ',"errors":' || to_json(e) || ',"name":"' || name || '","order":[' || turn || ',0]'
    || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' AS record FROM judged
UNION ALL
SELECT conv_id, call_id, NULL, turn, CAST(0 AS INTEGER), n_results, false, 'result without a call',
    '{"call_id":"' || call_id || '","conv_id":' || conv_id || ',"errors":["result without a call"],"order":[' || turn || ',0]' || CASE WHEN first[2] IS NULL THEN '' ELSE ',"result":' || to_json(first[2]) END || '}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
