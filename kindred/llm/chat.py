"""Tool-call linking in conversations, in DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier), so a conversation with a third of
all rows is spread over tasks by its identifiers; rows without an identifier link nothing and don't
take part. Arguments are parsed to variants, checked against schemas compiled to column expressions,
and written as canonical JSON: keys sorted, no white space, decimals without trailing zeros. A number
written with an exponent keeps one, as Java writes it. What isn't JSON is kept as a JSON string.

Items (messages, calls, results) are ordered topologically: a result comes after its call, a call
after the results of the calls it depends on (after the calls themselves where these are
unanswered). Where all of a conversation's dependencies point back in the transcript, the
transcript's order is such an order and is kept. Only the other conversations are ordered by
``rounds``: an item's round, the longest chain of dependencies before it, is then the first part of
its place, and items in or behind a cycle come last.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, table

#: Turns that are ranked together within a conversation.
CHUNK = 256
#: The tool that plain conversations are read as calls of, and its arguments' schema.
REPLY = {
    "reply": {
        "text": {"type": "string", "required": True, "minLength": 1, "maxLength": 400},
        "turn": {"type": "integer", "required": True, "minimum": 0},
        "n_chars": {"type": "integer", "required": True, "minimum": 1},
    }
}
#: JSON schema types, as the types of variants; an integer is a number without a fraction.
TYPES = {
    "string": "^STRING$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*",
    "object": "^OBJECT.*",
    "null": "^VOID$",
}

Schemas = dict[str, dict[str, dict]]


def _is_type(name: str, kind: Column, text: Column, number: Column) -> Column:
    if name != "integer":
        return kind.rlike(TYPES[name])
    whole = kind.startswith("DECIMAL") & text.rlike("^-?[0-9]+$")
    return (kind == "BIGINT") | whole | ((kind == "DOUBLE") & (number == F.floor(number)))


def _equals(option, value: Column, kind: Column, text: Column, number: Column) -> Column:
    """Whether a variant is a JSON value: numbers by value, whatever their spelling."""
    if isinstance(option, str):
        return (kind == "STRING") & (text == option)
    if isinstance(option, (int, float)) and not isinstance(option, bool):
        return kind.rlike(TYPES["number"]) & (number == float(option))
    return F.to_json(value) == json.dumps(option, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _field_errors(arguments: Column, name: str, rule: dict) -> list[Column]:
    """For one argument, a column for each rule: its message, or null if the rule holds."""
    path = "$['" + name.replace("'", "\\'") + "']"
    value = F.try_variant_get(arguments, path, "variant")
    kind = F.schema_of_variant(value)
    there = value.isNotNull()
    out = [F.when(~there, F.lit(f"{name}: missing"))] if rule.get("required") else []
    text, number = F.try_variant_get(arguments, path, "string"), F.try_variant_get(arguments, path, "double")
    if "type" in rule:
        out.append(F.when(there & ~_is_type(rule["type"], kind, text, number), F.lit(f"{name}: not {rule['type']}")))
    is_text, is_number = there & (kind == "STRING"), there & kind.rlike(TYPES["number"])
    for key, wrong, message in (
        ("minLength", lambda x: is_text & (F.length(text) < x), "shorter than"),
        ("maxLength", lambda x: is_text & (F.length(text) > x), "longer than"),
        ("pattern", lambda x: is_text & ~text.rlike(x), "not like"),
        ("minimum", lambda x: is_number & (number < x), "below"),
        ("maximum", lambda x: is_number & (number > x), "above"),
    ):
        if key in rule:
            out.append(F.when(wrong(rule[key]), F.lit(f"{name}: {message} {rule[key]}")))
    if "enum" in rule:
        allowed = reduce(Column.__or__, [_equals(x, value, kind, text, number) for x in rule["enum"]], F.lit(False))
        out.append(F.when(there & ~F.coalesce(allowed, F.lit(False)), F.lit(f"{name}: not allowed")))
    return out


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """The messages of all broken rules, in the schema's order, joined by "; " (empty if there are none)."""
    keys = F.json_object_keys(F.to_json(arguments))
    found = F.when(arguments.isNull(), F.array(F.lit("not JSON")))
    for tool, rules in schemas.items():
        checks = [e for field, rule in rules.items() for e in _field_errors(arguments, field, rule)]
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(keys, F.array()), F.array(*map(F.lit, rules)))), lambda k: F.concat(k, F.lit(": unknown")))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*checks, F.lit(None).cast("string"))), extra))
    return F.array_join(found.otherwise(F.array(F.lit("unknown tool"))), "; ")


def _members(v: Column, without: str) -> tuple[Column, Column]:
    """An object's keys but one, in order, and the JSON of the object without it. Variants hold their keys sorted."""
    left = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != without)
    return F.map_keys(left), F.to_json(left)


def _has_calls(v: Column) -> Column:
    calls = F.try_variant_get(v, "$.tool_calls", "array<variant>")
    return (F.col("role") == "assistant") & (F.coalesce(F.size(calls), F.lit(0)) > 0)


def _only_content(keys: Column) -> Column:
    return keys == F.array(F.lit("content"))


def calls_of(messages: DataFrame) -> DataFrame:
    """The tool calls in assistant messages whose text is a JSON object with ``tool_calls``.

    Of each call: id, name (or function.name), arguments (an object, or JSON in a string),
    depends_on. A call without arguments and name is kept whole as its arguments.
    """
    v = F.try_parse_json("text")
    calls = F.try_variant_get(v, "$.tool_calls", "array<variant>")
    each = messages.where(_has_calls(v)).select("conv_id", "turn", F.posexplode(calls).alias("place", "c"))
    get = lambda path, kind="string": F.try_variant_get("c", path, kind)
    name = F.coalesce(get("$.name"), get("$.function.name"))
    raw = F.coalesce(get("$.arguments", "variant"), get("$.function.arguments", "variant"), F.when(name.isNull(), F.col("c")))
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")).otherwise(F.to_json(raw))
    return each.select(
        "conv_id", "turn", (F.col("place") + 1).alias("place"), get("$.id").alias("call_id"),
        name.alias("name"), text.alias("arguments"), get("$.depends_on", "array<string>").alias("depends_on"),
    )


def results_of(messages: DataFrame) -> DataFrame:
    """The tool messages as results; content is JSON text.

    A JSON object's ``tool_call_id`` names the call and its ``content`` is the content, or what else
    it holds if that isn't all; any other text is the content, as a JSON string, of no call.
    """
    v = F.try_parse_json("text")
    keys, left = _members(v, "tool_call_id")
    inner = F.to_json(F.try_variant_get(v, "$.content", "variant"))
    content = F.when(_only_content(keys), inner).when(F.size(keys) >= 0, left).otherwise(F.to_json(F.coalesce(v, F.col("text").cast("variant"))))
    call_id = F.try_variant_get(v, "$.tool_call_id", "string")
    return messages.where(F.col("role") == "tool").select("conv_id", "turn", F.lit(0).alias("place"), call_id.alias("call_id"), content.alias("content"))


def others_of(messages: DataFrame) -> DataFrame:
    """What ``calls_of`` and ``results_of`` don't take: other messages, and what a message holds beside its calls."""
    v = F.try_parse_json("text")
    keys, left = _members(v, "tool_calls")
    inner = F.try_variant_get(v, "$.content", "variant")
    spoken = F.try_variant_get(inner, "$", "string")
    plain = _only_content(keys) & F.schema_of_variant(inner).isin("STRING", "VOID")
    beside = F.when(plain, F.nullif(spoken, F.lit(""))).when(F.size(keys) > 0, left)
    calling, role = F.coalesce(_has_calls(v), F.lit(False)), F.coalesce(F.col("role"), F.lit(""))
    rows = messages.withColumn("calling", calling).withColumn("beside", F.when(calling, beside)).where(role != "tool")
    said = F.when(F.col("calling"), F.col("beside")).otherwise(F.col("text"))
    return rows.where(~F.col("calling") | F.col("beside").isNotNull()).select("conv_id", "turn", F.lit(0).alias("place"), "role", said.alias("text"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations as calls, results and messages.

    A user's turn calls ``reply`` and depends on the turn two before it, if there can be one; an
    assistant's turn is the result for the turn before it.
    """
    key = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = F.to_json(F.struct(text.alias("text"), F.col("turn").alias("turn"), F.length(text).alias("n_chars")), {"ignoreNullFields": "false"})
    depends = F.when(F.col("turn") >= 2, F.array(key(2))).otherwise(F.array().cast("array<string>"))
    calls = messages.where(F.col("role") == "user").select("conv_id", "turn", F.lit(0).alias("place"), key(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.lit(0).alias("place"), key(1).alias("call_id"), F.col("text").alias("content"))
    rest = messages.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select("conv_id", "turn", F.lit(0).alias("place"), "role", "text")
    return calls, results, rest


ITEM = ["conv_id", "item"]


def _first(rows: DataFrame, by: str) -> DataFrame:
    """The place of the first row of each (conversation, identifier), as the side that a hash join is built of."""
    return rows.groupBy("conv_id", "call_id").agg(F.min("at").alias(by)).hint("shuffle_hash")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can link, and those that can't since they have no conversation or identifier."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    return rows.where(known), rows.where(~known)


def _jumped(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, item, to) -> the end of each item's chain, with the steps to it; and the items that have no end.

    Every item has one dependency here. Each pass doubles the steps, so a chain of n items takes log2(n) passes.
    """
    chains = materialize(single.withColumn("steps", F.lit(1).cast("long")), "chat-chains")
    for _ in range(chains.count().bit_length() + 1):
        inside = chains.select("conv_id", F.col("item").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = chains.join(inside, ["conv_id", "to"], "left")
        end, steps = F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        moved = materialize(moved.select(*ITEM, end, steps, F.col("next").isNull().alias("done")), "chat-chains")
        chains = moved.drop("done")
        if not moved.where("NOT done").limit(1).count():
            break
    return moved.where("done").drop("done"), moved.where("NOT done").select(*ITEM)


def rounds(items: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, item -> with round: the longest chain of items before it; null in or behind a cycle.

    items (conv_id, item), edges (conv_id, item, before). Chains of items with one dependency each
    are followed by doubling; the others are peeled, in as many steps as such others follow each other.
    """
    items, edges = materialize(items.distinct(), "chat-items"), materialize(edges.distinct(), "chat-edges")
    counted = edges.groupBy(*ITEM).agg(F.count("*").alias("n"), F.min("before").alias("to"))
    chains, endless = _jumped(counted.where("n = 1").select(*ITEM, "to"))
    many = edges.join(counted.where("n > 1").select(*ITEM), ITEM, "left_semi")
    ends = chains.select("conv_id", F.col("item").alias("before"), "to", "steps")
    lost = endless.select("conv_id", F.col("item").alias("before"), F.lit(True).alias("lost"))
    # a dependency counts from the end of its chain; one without an end is never resolved
    waits = many.join(ends, ["conv_id", "before"], "left").join(lost, ["conv_id", "before"], "left").select(
        *ITEM, F.when(F.col("lost"), F.lit(None)).otherwise(F.coalesce("to", "before")).alias("to"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(None).cast("long").alias("level")
    )
    waits = materialize(waits, "chat-waits")
    found = [materialize(items.join(counted.select(*ITEM), ITEM, "left_anti").withColumn("round", F.lit(0).cast("long")), "chat-levels")]
    while found[-1].limit(1).count():
        news = found[-1].select("conv_id", F.col("item").alias("to"), "round")
        met = waits.join(news, ["conv_id", "to"], "left").withColumn("level", F.coalesce("level", F.col("round") + F.col("steps") + 1)).drop("round")
        met = materialize(met, "chat-waits")
        whole = met.groupBy(*ITEM).agg(F.count("*").alias("n"), F.count("level").alias("known"), F.max("level").alias("round")).where("n = known")
        found.append(materialize(whole.select(*ITEM, "round"), "chat-levels"))
        waits = met.join(found[-1].select(*ITEM), ITEM, "left_anti")
    ended = reduce(DataFrame.unionByName, found)
    on_chains = chains.join(ended.select("conv_id", F.col("item").alias("to"), "round"), ["conv_id", "to"]).select(*ITEM, (F.col("round") + F.col("steps")).alias("round"))
    return items.join(ended.unionByName(on_chains), ITEM, "left")


def link(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, kind, call_id, position, status, errors, json for every call, result and message.

    status: of a call ``answered``, ``open``, ``duplicate`` (an earlier call has its id) or
    ``no id``, and with ``+dangling`` if it depends on an id that no call has, or ``+cycle``; of a
    result ``linked``, ``orphan``, ``duplicate`` or ``no id``; of a message ``plain``.
    position counts the conversation's items from 0. Rows that tie in conversation, turn and place
    are ordered by kind and content; equal ones are interchangeable. Rows of a null conversation are
    of none: they link nothing and have no position. Null turns come last. Texts of any length are
    taken whole; what is too long for a variant, or repeats a key, isn't JSON here. Empty tables give no rows.
    """
    at = F.struct(F.col("turn").isNull().alias("z"), "turn", "place")
    (calls, no_calls), (results, no_results) = _named(calls.withColumn("at", at)), _named(results.withColumn("at", at))
    first_call, first_result = _first(calls, "call_at"), _first(results, "result_at")
    key = ["conv_id", "call_id"]
    linked = calls.join(first_call, key, "left").join(first_result, key, "left")
    single = F.col("at") == F.col("call_at")
    state = F.when(~single, "duplicate").when(F.col("result_at").isNotNull(), "answered").otherwise("open")
    wanted = F.explode(F.array_distinct("depends_on")).alias("needs")
    needs = linked.select("conv_id", "call_id", "at", wanted).where(F.col("needs").isNotNull())
    there = first_call.join(first_result, key, "left").select("conv_id", F.col("call_id").alias("needs"), F.coalesce("result_at", "call_at").alias("before"), F.col("result_at").isNotNull().alias("by_result"))
    needs = needs.join(there.hint("shuffle_hash"), ["conv_id", "needs"], "left")
    bad = needs.where(F.col("before").isNull()).select("conv_id", "call_id").distinct().withColumn("dangling", F.lit(True))
    none = F.lit(None).cast("string")
    linked = linked.join(bad.hint("shuffle_hash"), key, "left").withColumn("state", F.concat(state, F.when(F.col("dangling"), "+dangling").otherwise("")))
    told = ["conv_id", "turn", "place", "call_id", "name", "arguments", "depends_on", "state"]
    linked = linked.select(*told).unionByName(no_calls.withColumn("state", F.lit("no id")).select(*told))

    answered = results.join(first_call, key, "left").join(first_result, key, "left")
    of_result = F.when(F.col("call_at").isNull(), "orphan").when(F.col("at") != F.col("result_at"), "duplicate").otherwise("linked")

    v = F.try_parse_json("arguments")
    shown = F.coalesce(v, F.col("arguments").cast("variant"))
    nulls = {"ignoreNullFields": "false"}
    call_json = F.to_json(F.struct(shown.alias("arguments"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.col("call_id").alias("id"), F.col("name"), F.lit("call").alias("type")), nulls)
    result_json = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")), nulls)
    message_json = F.to_json(F.struct(F.col("text").alias("content"), F.col("role"), F.lit("message").alias("type")), nulls)
    place = ["conv_id", "turn", "place"]
    no_errors = F.lit("").alias("errors")
    items = linked.select(*place, F.lit("call").alias("kind"), "call_id", F.col("state").alias("status"), argument_errors(F.col("name"), v, schemas).alias("errors"), call_json.alias("json"))
    of_results = lambda rows, status: rows.select(*place, F.lit("result").alias("kind"), "call_id", status.alias("status"), no_errors, result_json.alias("json"))
    items = items.unionByName(of_results(answered, of_result)).unionByName(of_results(no_results, F.lit("no id")))
    items = items.unionByName(messages.select(*place, F.lit("message").alias("kind"), none.alias("call_id"), F.lit("plain").alias("status"), no_errors, message_json.alias("json")))
    items = materialize(items, "chat-linked")

    # dependencies that don't point back in the transcript, and their conversations
    needs = materialize(needs.where(F.col("before").isNotNull()).select("conv_id", "call_id", "at", "needs", "before", "by_result"), "chat-needs")
    early = answered.where((F.col("at") == F.col("result_at")) & ~(F.col("call_at") < F.col("at"))).select("conv_id")
    odd = needs.where(~(F.col("before") < F.col("at"))).select("conv_id").union(early).distinct()
    odd = materialize(odd, "chat-odd")
    if odd.limit(1).count():
        name = lambda kind, column="call_id": F.concat(F.lit(f"{kind} "), F.col(column))
        in_odd = lambda rows: rows.join(odd, "conv_id", "left_semi")
        own = in_odd(items.where("kind <> 'message' AND call_id IS NOT NULL")).select("conv_id", F.concat_ws(" ", "kind", "call_id").alias("item"))
        by_needs = in_odd(needs).select("conv_id", name("call").alias("item"), F.when(F.col("by_result"), name("result", "needs")).otherwise(name("call", "needs")).alias("before"))
        by_call = in_odd(items.where("kind = 'result' AND status IN ('linked', 'duplicate')")).select("conv_id", name("result").alias("item"), name("call").alias("before"))
        found = rounds(own, by_needs.union(by_call)).withColumn("cycle", F.col("round").isNull()).withColumnRenamed("round", "peeled")
        items = items.withColumn("item", F.concat_ws(" ", "kind", "call_id")).join(found, ITEM, "left").drop("item")
        # items without dependencies are in round 0, those of a cycle behind all others
        items = items.withColumn("round", F.when(F.col("cycle"), 2**62).otherwise(F.coalesce("peeled", F.lit(0))))
        items = items.withColumn("status", F.when(F.col("cycle"), F.concat("status", F.lit("+cycle"))).otherwise(F.col("status"))).drop("cycle", "peeled")
        items = materialize(items, "chat-rounds")
    else:
        items = items.withColumn("round", F.lit(0).cast("long"))

    # two steps, so that one long conversation isn't ranked by one task
    items = items.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(2**62)).cast("long"))
    group = ["conv_id", "round", "chunk"]
    of_one = items.where(F.col("conv_id").isNotNull())
    before = Window.partitionBy("conv_id").orderBy("round", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = of_one.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_last(), "place", "kind", "call_id", "json")) - 1
    ranked = of_one.withColumn("rank", rank).join(counts, group)
    out = ["conv_id", "turn", "kind", "call_id"]
    placed = ranked.select(*out, (F.col("skip") + F.col("rank")).cast("long").alias("position"), "status", "errors", "json")
    return placed.unionByName(items.where(F.col("conv_id").isNull()).select(*out, F.lit(None).cast("long").alias("position"), "status", "errors", "json"))


def op1_chat_link(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a linked, checked and ordered item."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(*turns_as_calls(messages), REPLY)


OP1_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
u AS (SELECT conv_id, turn FROM m WHERE role = 'user'),
a AS (SELECT conv_id, turn FROM m WHERE role = 'assistant'),
items AS (
  SELECT m.conv_id, m.turn,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN m.conv_id || ':' || m.turn WHEN 'assistant' THEN m.conv_id || ':' || (m.turn - 1) END AS call_id,
    CASE role
      WHEN 'user' THEN CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.conv_id = m.conv_id AND a.turn = m.turn + 1) THEN 'answered' ELSE 'open' END
        || CASE WHEN m.turn >= 2 AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = m.conv_id AND u.turn = m.turn - 2) THEN '+dangling' ELSE '' END
      WHEN 'assistant' THEN CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.conv_id = m.conv_id AND u.turn = m.turn - 1) THEN 'linked' ELSE 'orphan' END
      ELSE 'plain' END AS status,
    CASE WHEN role = 'user' THEN concat_ws('; ',
      CASE WHEN length(coalesce(text, '')) < 1 THEN 'text: shorter than 1' END,
      CASE WHEN length(text) > 400 THEN 'text: longer than 400' END,
      CASE WHEN m.turn < 0 THEN 'turn: below 0' END,
      CASE WHEN length(coalesce(text, '')) < 1 THEN 'n_chars: below 1' END) ELSE '' END AS errors,
    CASE role
      WHEN 'user' THEN json_object('arguments', json_object('n_chars', length(coalesce(text, '')), 'text', coalesce(text, ''), 'turn', m.turn),
        'depends_on', CASE WHEN m.turn >= 2 THEN [m.conv_id || ':' || (m.turn - 2)] ELSE []::VARCHAR[] END, 'id', m.conv_id || ':' || m.turn, 'name', 'reply', 'type', 'call')
      WHEN 'assistant' THEN json_object('content', text, 'id', m.conv_id || ':' || (m.turn - 1), 'type', 'result')
      ELSE json_object('content', text, 'role', role, 'type', 'message') END::VARCHAR AS json
  FROM m
)
SELECT conv_id, turn, kind, call_id, CASE WHEN conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, kind, call_id, json) - 1 END AS position, status, errors, json FROM items
"""
