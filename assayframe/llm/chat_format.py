"""Tool calls linked to results, ordered, validated and written as canonical JSON;
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.sources.scratch import materialize

CALL, RESULT = "call", "result"
# Places below and above every turn.
FIRST, NOWHERE = -(1 << 62), (1 << 63) - 1
MESSAGE = ["conv_id", "turn", "role", "text", "kind", "call_id", "name", "arguments", "after"]
# Names of JSON Schema types and how Spark calls the type of such a value.
KINDS = {
    "string": "^STRING$",
    "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
    "null": "^VOID$",
}


def canonical(json: Column) -> Column:
    """JSON without white space, keys in order; null if it can't be read."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """A JSON string, ``null`` for null."""
    wrapped = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2), F.lit("null"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``arguments`` made canonical and ``problem``: null, ``not json``,
    ``not an object``, ``unknown tool``, ``missing <field>``, ``unexpected <field>`` or
    ``type of <field>``; of several fields the first by name.

    ``schemas`` hold ``name, field, kind, required``, a row per field; a tool without
    fields has one row with a null field. Equal rows count once.
    """
    known = (
        schemas.where("name IS NOT NULL")
        .groupBy("name")
        .agg(
            F.map_from_entries(
                F.sort_array(
                    F.filter(
                        F.collect_set(F.struct("field", F.struct("kind", "required").alias("rule"))),
                        lambda e: e["field"].isNotNull(),
                    )
                )
            ).alias("fields")
        )
    )
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments")).withColumn(
        "is_object", F.schema_of_variant("parsed").startswith("OBJECT")
    )
    values = F.when(F.col("is_object"), F.col("parsed").cast("map<string,variant>"))
    joined = parsed.withColumn("values", F.map_entries(values)).join(known, "name", "left")
    given = F.transform("values", lambda e: e["key"])
    required = F.map_keys(F.map_filter("fields", lambda _, rule: rule["required"]))
    missing = F.sort_array(F.array_except(required, given))
    unexpected = F.sort_array(F.array_except(given, F.map_keys("fields")))

    def wrong_kind(entry: Column) -> Column:
        kind = F.try_element_at("fields", entry["key"])["kind"]
        found = F.schema_of_variant(entry["value"])
        fits = F.lit(False)
        for name, pattern in KINDS.items():
            fits = F.when(kind == name, found.rlike(pattern)).otherwise(fits)
        return ~fits

    mistyped = F.sort_array(F.transform(F.filter("values", wrong_kind), lambda e: e["key"]))
    problem = (
        F.when(F.col("parsed").isNull(), "not json")
        .when(~F.col("is_object"), "not an object")
        .when(F.col("fields").isNull(), "unknown tool")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.get(missing, F.lit(0))))
        .when(F.size(unexpected) > 0, F.concat(F.lit("unexpected "), F.get(unexpected, F.lit(0))))
        .when(F.size(mistyped) > 0, F.concat(F.lit("type of "), F.get(mistyped, F.lit(0))))
    )
    return joined.select(
        *[c for c in calls.columns if c != "arguments"],
        F.to_json("parsed").alias("arguments"),
        problem.alias("problem"),
    )


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, node, place, level`` of ``nodes`` (``conv_id, node, turn``): sorted by
    place and level, every node comes after those before it.

    A node's place is its turn, or the highest place before it if that isn't lower;
    ``level`` counts the steps since. So nodes whose order agrees with their turns keep
    them, and there are as many rounds as nodes in the longest chain against the
    turns, however long a conversation is. Nodes on a cycle and behind one have no
    place: a chain comes back to where it took its place, or outgrows its
    conversation.

    ``edges`` hold ``conv_id, before, after``; those of unknown nodes don't count. Of
    rows with one node the lowest turn counts, null turns come first.
    """
    named = ["conv_id", "node"]
    keys = nodes.groupBy(*named).agg(F.min(F.coalesce("turn", F.lit(FIRST))).alias("place"))
    keys = keys.withColumns({"level": F.lit(0), "origin": F.col("node")})
    keys = materialize(keys, "chat-places")
    sizes = keys.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ends = keys.select(*named)
    known = (
        edges.join(ends.withColumnRenamed("node", "before"), ["conv_id", "before"], "left_semi")
        .join(ends.withColumnRenamed("node", "after"), ["conv_id", "after"], "left_semi")
        .join(sizes, "conv_id")
        .select("conv_id", "before", "after", "n")
        .distinct()
    )
    known = materialize(known, "chat-edges")
    moved = keys
    while True:
        level = F.when(F.col("place") == NOWHERE, 0).otherwise(F.col("level") + 1)
        told = (
            known.join(moved.withColumnRenamed("node", "before"), ["conv_id", "before"])
            .select("conv_id", F.col("after").alias("node"), "n", "place", level.alias("level"), "origin")
            .groupBy(*named)
            .agg(F.max(F.struct("place", "level", "origin")).alias("told"), F.max("n").alias("n"))
        )
        own = F.struct("place", "level")
        closed = (F.col("told.origin") == F.col("node")) | (F.col("told.level") > F.col("n"))
        moved = materialize(
            told.join(keys, named)
            .where(F.struct("told.place", "told.level") > own)
            .select(
                *named,
                F.when(closed, F.lit(NOWHERE)).otherwise(F.col("told.place")).alias("place"),
                F.when(closed, F.lit(0)).otherwise(F.col("told.level")).alias("level"),
                F.col("told.origin").alias("origin"),
            ),
            "chat-moved",
        )
        if moved.isEmpty():
            return keys.select(
                *named,
                F.nullif("place", F.lit(NOWHERE)).alias("place"),
                F.when(F.col("place") != NOWHERE, F.col("level")).alias("level"),
            )
        keys = materialize(keys.join(moved, named, "left_anti").unionByName(moved), "chat-places")


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per message: ``conv_id, turn, call_id, kind, place, level, linked, problem,
    json``.

    ``messages`` hold ``conv_id, turn, role, text``, and for tool use ``kind`` (``call``
    or ``result``), ``call_id``, ``name``, ``arguments`` (JSON) and ``after`` (call ids
    in the conversation whose results the call uses). A result is linked to the call
    with its id in the conversation, by a hash join; of several calls with one id the
    first turn counts, and the others and their messages are not linked. Results
    inherit the call's name. ``place``, ``level`` and ``turn`` order a conversation so
    that calls come before their results and after the results they use; calls and
    results on a cycle, or behind one, have no place. Other messages are at their turn.

    ``json`` is canonical: fixed keys in order, no white space; arguments with sorted
    keys, and null where they can't be read. Rows stay single messages, as a
    conversation may be of any length. Null roles, texts and ids are JSON nulls; a
    call or result without an id is not linked.
    """
    keys = ["conv_id", "call_id"]
    messages = messages.select(*MESSAGE)
    calls = messages.where((F.col("kind") == CALL) & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    first = calls.groupBy(*keys).agg(
        F.min("turn").alias("call_turn"), F.min_by("name", "turn").alias("call_name")
    )
    answered = messages.where(F.col("kind") == RESULT).select(*keys).distinct().withColumn("answered", F.lit(True))
    first = materialize(first.join(answered, keys, "left"), "chat-calls")
    used = calls.select(
        "conv_id",
        F.explode(F.transform("after", lambda c: F.concat(F.lit("result:"), c))).alias("before"),
        F.concat(F.lit("call:"), "call_id").alias("after"),
    )
    own = first.where("answered").select(
        "conv_id",
        F.concat(F.lit("call:"), "call_id").alias("before"),
        F.concat(F.lit("result:"), "call_id").alias("after"),
    )
    node = F.concat("kind", F.lit(":"), "call_id")
    nodes = messages.where("kind IS NOT NULL AND call_id IS NOT NULL AND conv_id IS NOT NULL").select(
        "conv_id", node.alias("node"), "turn"
    )
    ordered = materialize(places(nodes, used.union(own)), "chat-order")
    is_call = F.col("kind") == CALL
    checked = validated(
        messages.withColumn("kind", F.coalesce("kind", F.lit("text"))).withColumn(
            "arguments", F.when(F.col("kind") == CALL, F.col("arguments"))
        ),
        schemas,
    )
    linked = (
        checked.join(first, keys, "left")
        .withColumn("node", F.concat("kind", F.lit(":"), "call_id"))
        .join(ordered, ["conv_id", "node"], "left")
    )
    matched = F.col("call_turn").isNotNull() & F.when(
        is_call, (F.col("turn") == F.col("call_turn")) & F.col("answered")
    ).otherwise(F.col("kind") == RESULT)
    name = F.when(is_call, F.col("name")).when(F.col("kind") == RESULT, F.col("call_name"))
    used_tool = F.col("kind").isin(CALL, RESULT)
    # Keys in order.
    body = [
        F.lit("{"),
        F.when(
            is_call, F.concat(F.lit('"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(","))
        ).otherwise(""),
        F.lit('"content":'),
        quoted(F.col("text")),
        F.when(used_tool, F.concat(F.lit(',"id":'), quoted(F.col("call_id")))).otherwise(""),
        F.when(used_tool, F.concat(F.lit(',"name":'), quoted(name))).otherwise(""),
        F.lit(',"role":'),
        quoted(F.col("role")),
        F.lit("}"),
    ]
    return linked.select(
        "conv_id",
        "turn",
        "call_id",
        "kind",
        F.when(F.col("node").isNotNull() & used_tool, F.col("place")).otherwise(F.col("turn")).alias("place"),
        F.when(F.col("node").isNotNull() & used_tool, F.col("level")).otherwise(0).alias("level"),
        F.coalesce(matched, F.lit(False)).alias("linked"),
        F.when(is_call, F.col("problem")).alias("problem"),
        F.concat(*body).alias("json"),
    )
