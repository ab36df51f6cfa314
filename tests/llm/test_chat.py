"""Tool calls in JSON messages: links, order, schemas, canonical JSON."""

import json
import random

from pyspark.sql import functions as F

from kindred.llm import chat

SCHEMAS = {"find": {"q": {"type": "string", "required": True, "maxLength": 5}, "n": {"type": "integer", "minimum": 1}, "mode": {"enum": ["a", "b"]}, "level": {"enum": [1, None, {"a": 1, "b": 2}]}}}
MESSAGES = "conv_id long, turn long, role string, text string"


def linked(spark, rows, schemas=SCHEMAS):
    messages = spark.createDataFrame(rows, MESSAGES)
    found = chat.link(chat.calls_of(messages), chat.results_of(messages), chat.others_of(messages), schemas)
    return found.orderBy("conv_id", "position").collect()


def call(key, args, **more):
    return json.dumps({"tool_calls": [{"id": key, "name": "find", "arguments": args, **more}]})


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call("c1", {"q": "x"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"b": 1, "a": [2]}})),
        (1, 3, "assistant", call("c2", '{"q":"y","n":2}', depends_on=["c1"])),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": "z"})),
        (1, 5, "assistant", call("c2", {"q": "again"})),
        (1, 6, "assistant", call(None, {"q": "y"}, depends_on=["gone"])),
    ]
    found = linked(spark, rows)
    assert [(r.kind, r.status) for r in found] == [("message", "plain"), ("call", "answered"), ("result", "linked"), ("call", "open"), ("result", "orphan"), ("call", "duplicate"), ("call", "no id")]
    assert [r.position for r in found] == list(range(7))
    assert found[2].json == '{"content":"{\\"a\\":[2],\\"b\\":1}","id":"c1","type":"result"}'
    assert found[3].json == '{"arguments":{"n":2,"q":"y"},"depends_on":["c1"],"id":"c2","name":"find","type":"call"}'


def test_forward_dependencies_and_cycles(spark):
    rows = [
        (1, 0, "assistant", call("late", {"q": "x"}, depends_on=["early"])),
        (1, 1, "tool", json.dumps({"tool_call_id": "early", "content": 1})),
        (1, 2, "assistant", call("early", {"q": "x"})),
        (1, 3, "assistant", call("p", {"q": "x"}, depends_on=["r"])),
        (1, 4, "assistant", call("r", {"q": "x"}, depends_on=["p"])),
        (2, 0, "assistant", call("a", {"q": "x"}, depends_on=["lost"])),
    ]
    found = linked(spark, rows)
    place = {(r.conv_id, r.kind, r.call_id): (r.position, r.status) for r in found}
    assert place[1, "call", "early"][0] < place[1, "result", "early"][0] < place[1, "call", "late"][0]
    assert place[1, "call", "p"][1] == place[1, "call", "r"][1] == "open+cycle"
    assert sorted(x for (c, *_), (x, _) in place.items() if c == 1) == list(range(5))
    assert place[2, "call", "a"] == (0, "open+dangling")


def test_schemas(spark):
    cases = {
        '{"q":"abc"}': "", '{"q":"abc","n":0}': "n: below 1", '{"n":1}': "q: missing", '{"q":3}': "q: not string", '{"q":"toolong"}': "q: longer than 5",
        '{"q":"a","z":1,"b":2}': "b: unknown; z: unknown", "not json": "not JSON", '{"q":"a","n":1.5}': "n: not integer", '{"q":"a","mode":"c"}': "mode: not allowed", '{"q":"a","mode":"b"}': "",
        '{"q":"a","n":1.0}': "", '{"q":"a","n":1e2}': "", '{"q":"a","n":123456789012345678901234567890}': "", '{"q":"a","n":1.5e0}': "n: not integer", '{"q":"a","n":"1"}': "n: not integer",
        '{"q":"a","mode":1}': "mode: not allowed", '{"q":"a","level":1}': "", '{"q":"a","level":1.0}': "", '{"q":"a","level":"1"}': "level: not allowed", '{"q":"a","level":{"b":2,"a":1}}': "", '{"q":"a","level":null}': "", '{"q":"a","level":false}': "level: not allowed",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "a string")
    errors = chat.argument_errors(F.lit("find"), F.try_parse_json("a"), SCHEMAS)
    assert {r.a: r.e for r in frame.select("a", errors.alias("e")).collect()} == cases
    assert frame.limit(1).select(chat.argument_errors(F.lit("other"), F.try_parse_json("a"), SCHEMAS).alias("e")).first().e == "unknown tool"


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, None, None), (1, None, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", None), (1, 3, "system", "é \"")]
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("at", F.lit(1)).withColumn("json", F.lit(2)).select("conv_id", "turn", "role", "text")
    found = chat.link(*chat.turns_as_calls(messages), chat.REPLY).collect()
    assert len(found) == len(rows)
    assert sorted(r.position for r in found if r.conv_id == 1) == list(range(5))
    assert {r.position for r in found if r.conv_id is None} == {None}
    assert not chat.link(*chat.turns_as_calls(messages.limit(0)), chat.REPLY).count()


def test_long_conversation_is_ordered(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1500)]
    found = chat.link(*chat.turns_as_calls(spark.createDataFrame(rows, MESSAGES)), chat.REPLY).orderBy("position").collect()
    assert [r.turn for r in found] == list(range(1500)) and {r.status for r in found} == {"answered", "linked"}


def test_no_message_is_lost(spark):
    texts = [
        ("assistant", '{"tool_calls": []}', "plain"),
        ("assistant", '{"tool_calls": {"id": 1}}', "plain"),
        ("assistant", "just text", "plain"),
        ("assistant", None, "plain"),
        (None, "who", "plain"),
        ("tool", "no JSON", "no id"),
        ("tool", None, "no id"),
        ("tool", "[1, 2]", "no id"),
        ("tool", '{"tool_call_id": "zz", "content": "c", "is_error": true}', "orphan"),
    ]
    rows = [(1, i, role, text) for i, (role, text, _) in enumerate(texts)]
    found = linked(spark, rows)
    assert [r.turn for r in found] == list(range(len(texts))) and [r.status for r in found] == [x for *_, x in texts]
    said = [json.loads(r.json).get("content") for r in found]
    assert said[:5] == [t for _, t, _ in texts[:5]]
    assert [json.loads(x) if x is not None else None for x in said[5:]] == ["no JSON", None, [1, 2], {"content": "c", "is_error": True}]

    both = json.dumps({"content": "let me look", "tool_calls": [{"id": "a", "name": "find", "arguments": "not {JSON"}, {"id": "b", "function": {"name": "find", "arguments": '{"q": "x"}'}}, "odd"]})
    found = linked(spark, [(1, 0, "assistant", both), (1, 1, "assistant", '{"content": "", "tool_calls": [{"id": "c"}]}'), (1, 2, "assistant", '{"why": [1], "tool_calls": [{"id": "d"}]}')])
    assert [(r.turn, r.kind, r.call_id) for r in found] == [(0, "message", None), (0, "call", "a"), (0, "call", "b"), (0, "call", None), (1, "call", "c"), (2, "message", None), (2, "call", "d")]
    shown = [json.loads(r.json) for r in found]
    assert shown[0]["content"] == "let me look" and shown[1]["arguments"] == "not {JSON" and shown[2]["arguments"] == {"q": "x"}
    assert shown[3]["arguments"] == "odd" and json.loads(shown[5]["content"]) == {"why": [1]} and found[1].errors == "not JSON"


def layers(nodes, before):
    """Each node's longest chain of dependencies by plain recursion over a topological peel; None in or behind a cycle."""
    level, left = {}, set(nodes)
    while ready := {n for n in left if before[n] <= set(level)}:
        level |= {n: 1 + max((level[b] for b in before[n]), default=-1) for n in ready}
        left -= ready
    return level | dict.fromkeys(left)


def test_rounds_are_longest_chains(spark):
    rng = random.Random(11)
    nodes = [(c, f"i{i:03d}") for c in range(4) for i in range(60)]
    edges = [(c, f"i{i:03d}", f"i{j:03d}") for c in range(4) for i in range(60) for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))]
    nodes += [(9, f"i{i}") for i in range(400)]
    edges += [(9, f"i{i}", f"i{i - 1}") for i in range(1, 400)]  # a chain, and cycles with what hangs on them
    edges += [(2, "i005", "i050"), (2, "i050", "i005"), (3, "i000", "i000")]
    before = {n: {(c, b) for c, i, b in edges if (c, i) == n} for n in nodes}
    found = chat.rounds(spark.createDataFrame(nodes, "conv_id long, item string"), spark.createDataFrame(edges, "conv_id long, item string, before string"))
    assert {(r.conv_id, r.item): r.round for r in found.collect()} == layers(nodes, before)


def test_dependencies_that_point_forward_are_peeled(spark):
    rng = random.Random(12)
    rows, needs, key = [], {}, lambda c, i: f"c{c}-{i}"
    for c in range(6):
        order = list(range(30))
        rng.shuffle(order)
        for turn, i in enumerate(order):
            needs[c, i] = [j for j in range(i) if rng.random() < 0.08]
            rows += [(c, 2 * turn, "assistant", call(key(c, i), {"q": "x"}, depends_on=[key(c, j) for j in needs[c, i]])), (c, 2 * turn + 1, "tool", json.dumps({"tool_call_id": key(c, i), "content": i}))]
    found = linked(spark, rows)
    at = {(r.conv_id, r.kind, r.call_id): r.position for r in found}
    assert len(found) == len(rows) and all(sorted(p for (x, *_), p in at.items() if x == c) == list(range(60)) for c in range(6))
    for (c, i), others in needs.items():
        assert at[c, "call", key(c, i)] < at[c, "result", key(c, i)]
        assert all(at[c, "result", key(c, j)] < at[c, "call", key(c, i)] for j in others)
