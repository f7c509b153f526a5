"""Tool-call linking for chat training data, in DataFrame operations.

A conversation is a set of messages (conv_id, turn, role, text). Three kinds of text are JSON objects:

    declaration   role system:     {"tools": [{"name", "parameters": {"properties": {p: {"type"}}, "required": [p]}}]}
    calls         role assistant:  {"content"?, "tool_calls": [{"id", "name", "arguments", "depends_on"?: [id]}]}
    result        role tool:       {"tool_call_id", "content"}

All others are plain. Calls and results are hash-joined by conversation and identifier; a call gets the first result after
it in turn order. Calls are ordered topologically: a call's level is one more than the highest level of the calls of the
same conversation that it depends on. Arguments are validated against the tool's schema: an object, all required parameters
there, every declared one of its type. Every item - message, call, result - becomes one row with canonical JSON (keys
sorted, no white space), range-sorted into training order; a result follows its call. Nothing gathers a conversation in one
task.

``problem`` names what is wrong with an item, null if nothing: call - invalid_arguments, unknown_tool, no_result,
duplicate_id, cyclic; result - no_call, duplicate_result.

Defined results: null texts are plain messages with null content; null conv_id or turn is a value of its own, first in
order; malformed JSON is a plain message; a result without identifier is linked to nothing; repeated rows are items each,
treated alike if they share a turn, else marked as duplicates where they repeat an identifier; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm.shared import columns, stored, table

CALLS = "struct<content string, tool_calls array<struct<id string, name string, arguments string, depends_on array<string>>>>"
RESULT = "struct<tool_call_id string, content string>"
TOOLS = ("struct<tools array<struct<name string, parameters struct<properties map<string, struct<type string>>, "
         "required array<string>>>>>")
KEY = ["conv_id", "id"]


def canonical(json: Column) -> Column:
    """The same JSON value with sorted keys and without white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _object(role: str, schema: str, needed: str) -> Column:
    """The text parsed as the given form, null unless the role and the form are right."""
    text = F.col("text")
    parsed = F.from_json(text, schema)
    json = (F.col("role") == role) & F.ltrim(text).startswith("{")
    return F.when(json, F.when(F.get_json_object(text, f"$.{needed}").isNotNull(), parsed))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for n in names:
        on &= a[n].eqNullSafe(b[n])
    return on


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level for every call that depends on others; null where the dependencies run in a circle."""
    edges = stored(calls.select("conv_id", "id", F.explode("depends_on").alias("on")).distinct())
    known = calls.select("conv_id", F.col("id").alias("on")).distinct()
    edges = stored(edges.join(known, _same(edges, known, "conv_id", "on"), "left_semi"))
    left = edges.count()
    levels = stored(edges.select("conv_id", "id").distinct().limit(0).withColumn("level", F.lit(0)))
    depth = 0
    while left:
        depth += 1
        # ready: none of the calls that it waits for waits itself
        waiting = edges.select("conv_id", F.col("id").alias("on")).distinct()
        blocked = edges.join(waiting, _same(edges, waiting, "conv_id", "on"), "left_semi").select("conv_id", "id").distinct()
        ready = edges.join(blocked, _same(edges, blocked, *KEY), "left_anti").select("conv_id", "id").distinct()
        levels = stored(levels.union(ready.withColumn("level", F.lit(depth))))
        edges = stored(edges.join(blocked, _same(edges, blocked, *KEY), "left_semi"))
        rest = edges.count()
        if rest == left:
            levels = levels.union(edges.select("conv_id", "id").distinct().withColumn("level", F.lit(None).cast("int")))
            break
        left = rest
    return levels


def _type_ok(value: Column, kind: Column) -> Column:
    """value: a JSON value's text, as it is written."""
    number = value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return (F.when(kind == "string", value.startswith('"')).when(kind == "integer", value.rlike(r"^-?[0-9]+$"))
            .when(kind == "number", number).when(kind == "boolean", value.isin("true", "false"))
            .when(kind == "array", value.startswith("[")).when(kind == "object", value.startswith("{"))
            .when(kind == "null", value == "null").otherwise(F.lit(True)))


def _checked(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds ``known`` (a tool of that name is declared) and ``valid`` to calls. The first declaration of a name counts."""
    tools = (messages.filter("declared IS NOT NULL").select("conv_id", "turn", F.explode("declared.tools").alias("tool"))
             .groupBy("conv_id", F.col("tool.name").alias("name"))
             .agg(F.min_by(F.to_json("tool.parameters"), F.struct("turn", F.to_json("tool.parameters"))).alias("schema")))
    joined = calls.join(tools, _same(calls, tools, "conv_id", "name"), "left").select(calls["*"], "schema", tools["name"].isNotNull().alias("known"))
    schema = F.from_json("schema", "struct<properties map<string, struct<type string>>, required array<string>>")
    # each value's own text: a map of variants keeps what kind of value it is
    values = F.transform_values(F.from_json("arguments", "map<string, variant>"), lambda _, v: F.to_json(v))
    names = F.coalesce(F.map_keys(values), F.array().cast("array<string>"))
    required = F.coalesce(F.col("s.required"), F.array().cast("array<string>"))
    typed = F.forall(F.coalesce(F.map_entries("s.properties"), F.array().cast("array<struct<key string, value struct<type string>>>")),
                     lambda e: ~F.array_contains(names, e["key"]) | F.coalesce(_type_ok(F.element_at(values, e["key"]), e["value"]["type"]), F.lit(True)))
    return joined.withColumn("s", schema).withColumn(
        "valid", F.coalesce(F.col("canonical").startswith("{"), F.lit(False)) & (F.size(F.array_except(required, names)) == 0) & typed).drop("s", "schema")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (the item's own), at_turn, level, number, kind (message, call, result), id, problem, json.

    Sorted by conv_id, at_turn, level, number and kind.
    """
    messages = (columns(conversations, "conv_id", "turn", "role", "text")
                .withColumn("asked", _object("assistant", CALLS, "tool_calls")).withColumn("answered", _object("tool", RESULT, "tool_call_id"))
                .withColumn("declared", _object("system", TOOLS, "tools")))
    plain = messages.filter("answered IS NULL").select(
        "conv_id", "turn", F.col("turn").alias("at_turn"), F.lit(0).alias("level"), F.lit(0).alias("number"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("problem"),
        canonical(F.to_json(F.struct(F.when(F.col("asked").isNull(), F.col("text")).otherwise(F.col("asked.content")).alias("content"), "role"),
                            {"ignoreNullFields": "false"})).alias("json"))
    calls = stored(messages.filter("asked IS NOT NULL").select("conv_id", "turn", F.posexplode("asked.tool_calls").alias("number", "c"))
                   .select("conv_id", "turn", (F.col("number") + 1).alias("number"), "c.*")
                   .withColumn("canonical", canonical(F.col("arguments"))))
    results = stored(messages.filter("answered IS NOT NULL").select("conv_id", "turn", F.col("answered.tool_call_id").alias("id"), F.col("answered.content").alias("content")))
    # the first call with an identifier, and its first result after it
    first = calls.groupBy(*KEY).agg(F.min(F.struct("turn", "number")).alias("call"))
    levels = _levels(calls)
    first = first.join(levels, _same(first, levels, *KEY), "left").select(
        first["*"], F.coalesce("level", F.lit(0)).alias("level"), (levels["conv_id"].isNotNull() | levels["id"].isNotNull()).alias("waits"), levels["level"].isNull().alias("unset"))
    first = first.withColumn("cyclic", F.col("waits") & F.col("unset")).drop("waits", "unset")
    later = results.join(first.hint("shuffle_hash"), _same(results, first, *KEY)).filter(results["turn"] > F.col("call.turn"))
    answer = later.groupBy(results["conv_id"], results["id"]).agg(F.min("turn").alias("answer"))
    linked = stored(first.join(answer, _same(first, answer, *KEY), "left").select(first["*"], "answer"))

    checked = _checked(calls, messages)
    own = checked.join(linked.hint("shuffle_hash"), _same(checked, linked, *KEY), "left").select(checked["*"], "call", "answer", "level", "cyclic")
    called = own.select(
        "conv_id", "turn", F.col("turn").alias("at_turn"), (F.col("level") + 1).alias("level"), "number", F.lit("call").alias("kind"), "id",
        F.when(~F.col("call").eqNullSafe(F.struct("turn", "number")), "duplicate_id").when(F.col("cyclic"), "cyclic").when(~F.col("known"), "unknown_tool")
        .when(~F.col("valid"), "invalid_arguments").when(F.col("answer").isNull(), "no_result").alias("problem"),
        canonical(F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.to_json(F.struct(F.col("arguments").alias("x")))), F.lit(","),
                           F.substring(F.to_json(F.struct("id", "name"), {"ignoreNullFields": "false"}), 2, 1 << 30))).alias("json"))
    got = results.join(linked.hint("shuffle_hash"), _same(results, linked, *KEY), "left").select(results["*"], "call", "answer", "level")
    fits = F.col("answer").eqNullSafe(F.col("turn")) & F.col("id").isNotNull()
    answered = got.select(
        "conv_id", "turn", F.when(fits, F.col("call.turn")).otherwise(F.col("turn")).alias("at_turn"),
        F.when(fits, F.col("level") + 1).otherwise(0).alias("level"), F.when(fits, F.col("call.number")).otherwise(0).alias("number"), F.lit("result").alias("kind"), "id",
        F.when(~fits, F.when(F.col("answer").isNotNull() & (F.col("turn") > F.col("answer")), "duplicate_result").otherwise("no_call")).alias("problem"),
        canonical(F.to_json(F.struct("content", "id", F.lit("tool").alias("role")), {"ignoreNullFields": "false"})).alias("json"))
    return plain.union(called).union(answered).orderBy("conv_id", "at_turn", "level", "number", "kind", "turn", "json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
