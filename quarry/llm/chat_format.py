"""Chat formatting: tool calls and their results are linked by identifier, ordered, validated and written as canonical JSON.

DataFrame functions only. A conversation is never gathered into one row, so a very long one is no task of its own: each message,
call and result is a row with its place.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

#: Tools known by default: argument schemas in the usual JSON Schema subset (required, properties.type, enum, additionalProperties).
SCHEMAS: dict[str, dict[str, Any]] = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculator": {"required": ["expression"], "properties": {"expression": {"type": "string"}}},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def validation_error(name: Column, arguments: Column, schemas: dict[str, dict[str, Any]]) -> Column:
    """The first thing wrong with a call's arguments (a variant), or null: unknown tool, no object, missing, wrong type, not allowed, unknown."""
    out = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")).when(arguments.isNull() | ~F.schema_of_variant(arguments).rlike("^OBJECT"), F.lit("arguments are no object"))
    for tool, schema in schemas.items():
        own = name == tool
        for arg in schema.get("required", []):
            out = out.when(own & _field(arguments, arg, "variant").isNull(), F.lit(f"missing: {arg}"))
        for arg, rule in schema.get("properties", {}).items():
            value = _field(arguments, arg, "variant")
            if "type" in rule:
                kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
                fits = F.schema_of_variant(value).rlike("^(" + "|".join(_KINDS[k] for k in kinds) + ")$")
                out = out.when(own & value.isNotNull() & ~fits, F.lit(f"wrong type: {arg}"))
            if "enum" in rule:
                allowed = _field(arguments, arg, "string").isin(*[str(x) for x in rule["enum"]])
                out = out.when(own & value.isNotNull() & ~F.coalesce(allowed, F.lit(False)), F.lit(f"not allowed: {arg}"))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>"))
            out = out.when(own & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_min(extra)))
    return out


def canonical(v: Column) -> Column:
    """A variant as JSON with sorted keys and no blanks."""
    return F.to_json(v)


def _levels(calls: DataFrame) -> DataFrame:
    """calls with ``level`` and ``at_turn``: after everything they depend on. Rounds of joins on dependency edges, until none is left.

    A call on a cycle, or that depends on an unknown call, keeps its own turn, level 0 and ``ordered`` false.
    """
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).where("call_id is not null").distinct()
    edges = stage(edges, "call-edges")
    base = calls.withColumn("level", F.lit(0)).withColumn("at_turn", F.col("turn"))
    if edges.isEmpty():
        return base.withColumn("ordered", F.lit(True))
    nodes = stage(calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn")), "call-nodes")
    waiting = edges.select("conv_id", "call_id").distinct()
    done = stage(nodes.join(waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("turn").alias("at_turn"), F.lit(0).alias("level")), "call-done")
    while True:
        open_ = nodes.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        on = done.select("conv_id", F.col("call_id").alias("on"), F.col("at_turn").alias("t"), F.col("level").alias("l"))
        met = edges.join(open_, ["conv_id", "call_id"]).join(on, ["conv_id", "on"], "left").groupBy("conv_id", "call_id").agg(
            F.min("turn").alias("turn"), F.max("t").alias("t"), F.max("l").alias("l"), F.min(F.col("l").isNotNull()).alias("all")
        )
        new = stage(met.where("all").select("conv_id", "call_id", F.greatest("turn", "t").alias("at_turn"), (F.col("l") + 1).alias("level")), "call-new")
        if new.isEmpty():
            break
        done = stage(done.unionByName(new), "call-done")
    return base.drop("level", "at_turn").join(done, ["conv_id", "call_id"], "left").withColumn("ordered", F.col("level").isNotNull() | F.col("call_id").isNull()).withColumn(
        "level", F.coalesce("level", F.lit(0))
    ).withColumn("at_turn", F.coalesce("at_turn", "turn"))


def format_chats(conversations: DataFrame, schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """op5: one row for each message, tool call and tool result, with its place and canonical JSON.

    A call stands in a message whose text is a JSON object with ``tool_calls``: a list of {id, name, arguments, depends_on}, where
    arguments are an object or a string that holds one. A result is a message of role ``tool`` whose text is a JSON object with
    ``tool_call_id``. Any other text, JSON or not, is a message. What an object with calls holds beside them (content and other
    fields) is a message too, of item -1, that keeps those fields; its role is added where none is among them.

    Result columns: conv_id, turn, item (the call's place in its message), kind, role, call_id, linked (a result: its call is
    there; a call: a result is there), valid and error (calls), ordered, at_turn and level: rows sorted by (at_turn, level,
    kind = result, turn, item) have each call after what it depends on and each result after its call. Of calls with one
    identifier in a conversation, the earliest is linked.

    Nulls: a null text or role gives null in the JSON; rows with a null conv_id or identifier are never linked. Repeated rows come
    out repeated. Tables without tool calls give messages only. Columns other than conv_id, turn, role and text are not read.
    """
    known = SCHEMAS if schemas is None else schemas
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("v", F.when(F.ltrim(F.col("text")).startswith("{"), F.try_parse_json("text")))
    rows = rows.withColumn("calls", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    result_id = F.when(F.col("role") == "tool", _field(F.col("v"), "tool_call_id", "string"))
    rows = rows.withColumn("result_id", result_id)
    is_call, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("result_id").isNotNull()

    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    none = F.lit(None)
    message = lambda item, json: [
        "conv_id", "turn", F.lit(item).alias("item"), F.lit("message").alias("kind"), "role", none.cast("string").alias("call_id"), none.cast("boolean").alias("linked"),
        none.cast("boolean").alias("valid"), none.cast("string").alias("error"), F.lit(True).alias("ordered"), F.col("turn").alias("at_turn"), F.lit(0).alias("level"), json.alias("json"),
    ]
    messages = rows.where(~is_call & ~is_result).select(*message(0, plain))
    beside = F.map_filter(F.from_json(F.to_json("v"), "map<string, variant>"), lambda k, _: k != "tool_calls")
    besides = rows.where(is_call & ~is_result).withColumn("beside", beside).where(F.size("beside") > 0)
    own, role = F.to_json("beside"), F.to_json(F.struct("role"), {"ignoreNullFields": "false"})
    with_role = canonical(F.parse_json(F.concat(F.left(role, F.length(role) - 1), F.lit(","), F.substr(own, F.lit(2)))))
    messages = messages.unionByName(besides.select(*message(-1, F.when(F.map_contains_key("beside", "role"), own).otherwise(with_role))))

    calls = rows.where(is_call).select("conv_id", "turn", "role", F.posexplode("calls").alias("item", "c"))
    given = _field(F.col("c"), "arguments", "variant")
    inner = F.try_parse_json(_field(F.col("c"), "arguments", "string"))
    calls = calls.select(
        "conv_id", "turn", "role", "item", _field(F.col("c"), "id", "string").alias("call_id"), _field(F.col("c"), "name", "string").alias("name"),
        F.when(F.schema_of_variant(given) == "STRING", inner).otherwise(given).alias("arguments"),
        F.coalesce(_field(F.col("c"), "depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    calls = _levels(calls.withColumn("error", validation_error(F.col("name"), F.col("arguments"), known)))
    body = F.struct(canonical(F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("role").alias("role"))
    results = rows.where(is_result).select("conv_id", "turn", "role", F.col("result_id").alias("call_id"), canonical(F.col("v")).alias("body"))
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("at_turn", "level"), F.struct("turn", "item")).alias("to"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    called = calls.join(answered, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", "item", F.lit("call").alias("kind"), "role", "call_id", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("error").isNull().alias("valid"), "error",
        "ordered", "at_turn", "level", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )
    linked = results.join(first, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit(0).alias("item"), F.lit("result").alias("kind"), "role", "call_id", F.col("to").isNotNull().alias("linked"), none.cast("boolean").alias("valid"),
        none.cast("string").alias("error"), F.lit(True).alias("ordered"), F.coalesce(F.greatest("turn", "to.at_turn"), "turn").alias("at_turn"),
        F.when(F.col("to.at_turn") >= F.col("turn"), F.col("to.level")).otherwise(F.lit(0)).alias("level"), F.col("body").alias("json"),
    )
    return messages.unionByName(called).unionByName(linked)


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """The rows of plain conversations with tool calls and results made of them by rule: for tables that hold none.

    An assistant's turn becomes a message with its text and one call, ``c<turn>``, that depends on the call of the turn at half its
    number; arguments and names follow from conv_id + turn, so that each kind of error comes up. A user's turn becomes the result
    of the call of the turn before. Other turns stay. Nulls: a null text is left out of arguments, a null conv_id or turn counts
    as 0 in the rule and gives a null identifier.
    """
    turn, text = F.col("turn"), F.col("text")
    k = F.coalesce("conv_id", F.lit(0)) + F.coalesce(turn, F.lit(0))
    id_of = lambda t: F.concat(F.lit("c"), t.cast("string"))
    limit = F.when(k % 4 == 0, F.length(text).cast("string")).when(k % 4 == 2, F.lit('"many"')).when(k % 4 == 3, F.lit("3"))
    fields = F.array_compact(F.array(F.concat(F.lit('"limit":'), limit), F.when(k % 4 != 3, F.concat(F.lit('"query":'), _quoted(text)))))
    depends = F.when(turn >= 2, F.concat(F.lit('"'), id_of(F.expr("turn div 2")), F.lit('"'))).otherwise(F.lit(""))
    call = F.concat(
        F.lit('{"arguments":{'), F.array_join(fields, ","), F.lit('},"depends_on":['), depends, F.lit('],"id":'), F.coalesce(_quoted(id_of(turn)), F.lit("null")),
        F.lit(',"name":"'), F.when(k % 7 == 0, F.lit("lookup")).otherwise(F.lit("search")), F.lit('"}'),
    )
    calls = F.concat(F.lit('{"content":'), F.coalesce(_quoted(text), F.lit("null")), F.lit(',"tool_calls":['), call, F.lit("]}"))
    result = F.concat(F.lit('{"content":'), F.coalesce(_quoted(text), F.lit("null")), F.lit(',"tool_call_id":'), _quoted(id_of(turn - 1)), F.lit("}"))
    asked = (F.col("role") == "user") & (turn >= 1)
    return conversations.select(
        "conv_id", "turn", F.when(asked, F.lit("tool")).otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", calls).when(asked, result).otherwise(text).alias("text")
    )


def _quoted(text: Column) -> Column:
    """A string as JSON; null for null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, 6, 2147483647).substr(F.lit(1), F.length(whole) - 6))


#: format_chats(tool_conversations(...)) in SQL, with the default schemas; for whole (conv_id, turn) without nulls or repeats.
SQL = """with recursive said as (select *, conv_id + turn as k from conversations),
calls as (select *, case when k % 4 = 3 then null else text end as query, case k % 4 when 0 then length(text)::varchar when 2 then '"many"' when 3 then '3' end as lim,
  case when k % 7 = 0 then 'lookup' else 'search' end as name, case when turn >= 2 then turn // 2 end as dep from said where role = 'assistant'),
placed(conv_id, turn, level) as (select conv_id, turn, 0 from calls where dep is null
  union all select c.conv_id, c.turn, p.level + 1 from calls c join placed p on c.conv_id = p.conv_id and c.dep = p.turn),
results as (select *, 'c' || (turn - 1) as id, exists (select 1 from calls c where c.conv_id = said.conv_id and c.turn = said.turn - 1) as linked from said where role = 'user' and turn >= 1)
select conv_id, turn, 0 as item, 'message' as kind, role, null::varchar as call_id, null::boolean as linked, null::boolean as valid, null::varchar as error, true as ordered, turn as at_turn, 0 as level,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' as json
from said where not (role = 'assistant' or (role = 'user' and turn >= 1))
union all select conv_id, turn, -1, 'message', role, null, null, null, null, true, turn, 0, '{"content":' || to_json(text)::varchar || ',"role":"assistant"}' from calls
union all select c.conv_id, c.turn, 0, 'call', c.role, 'c' || c.turn, exists (select 1 from results r where r.conv_id = c.conv_id and r.turn = c.turn + 1), e.error is null, e.error, p.level is not null, c.turn, coalesce(p.level, 0),
  '{"arguments":' || to_json('{' || concat_ws(',', '"limit":' || lim, '"query":' || to_json(query)::varchar) || '}')::varchar || ',"id":"c' || c.turn || '","name":"' || name || '","role":"assistant"}'
from calls c left join placed p using (conv_id, turn),
  lateral (select case when name = 'lookup' then 'unknown tool' when k % 4 = 3 then 'missing: query' when k % 4 = 2 then 'wrong type: limit' end as error) e
union all select conv_id, turn, 0, 'result', 'tool', id, linked, null, null, true, turn, 0, '{"content":' || to_json(text)::varchar || ',"tool_call_id":"' || id || '"}' from results"""
