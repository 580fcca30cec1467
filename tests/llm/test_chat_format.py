import json

from assayframe.llm.chat_format import canonical, format_chats, places, quoted

SCHEMA = (
    "conv_id long, turn long, role string, text string, kind string, call_id string, "
    "name string, arguments string, after array<string>, level int"
)
FIELDS = [
    ("f", "a", "integer", True),
    ("f", "b", "string", False),
    ("f", "c", "array", False),
    ("g", None, None, None),
]


def run(spark, rows):
    messages = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    fields = spark.createDataFrame(FIELDS, "name string, field string, kind string, required boolean")
    return format_chats(messages, fields)


def call(turn, call_id, name="f", arguments='{"a":1}', after=None, conv=1):
    return (conv, turn, "assistant", None, "call", call_id, name, arguments, after)


def result(turn, call_id, conv=1, text="r"):
    return (conv, turn, "tool", text, "result", call_id, None, None, None)


def test_problems(spark):
    cases = {
        '{"a":1}': None,
        '{ "b" : "x\\n", "a" : 2 }': None,
        '{"a":1,"c":[1,{"z":1,"y":null}]}': None,
        '{"a":"1"}': "type of a",
        '{"a":1.5}': "type of a",
        '{"b":"x"}': "missing a",
        '{"a":1,"z":0,"d":0}': "unexpected d",
        '{"a":null}': "type of a",
        "[1]": "not an object",
        "{a": "not json",
        None: "not json",
    }
    rows = [call(i, f"k{i}", arguments=a) for i, a in enumerate(cases)]
    rows += [call(100, "u", "unknown"), call(101, "g", "g", "{}"), call(102, "n", None)]
    got = {r["turn"]: r for r in run(spark, rows).collect()}
    assert [got[i]["problem"] for i in range(len(cases))] == list(cases.values())
    assert [got[i]["problem"] for i in (100, 101, 102)] == ["unknown tool", None, "unknown tool"]
    for i, text in enumerate(cases):
        message = json.loads(got[i]["json"])
        assert message["arguments"] == (None if got[i]["problem"] == "not json" else json.loads(text))
        assert got[i]["json"] == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n', None, None, None, None, None),
        result(1, "late"),
        call(2, "late", after=["early"]),
        call(3, "early"),
        result(4, "early"),
        call(5, "early"),
        result(6, "orphan"),
        call(7, "alone"),
        result(8, None),
        result(1, "late", conv=2),
        (None, None, None, None, None, None, None, None, None),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, rows).collect()}
    linked = {k for k, r in got.items() if r["linked"]}
    assert linked == {(1, 1), (1, 2), (1, 3), (1, 4)}
    at = {k: (r["place"], r["level"]) for k, r in got.items()}
    assert at[1, 0] < at[1, 3] < at[1, 4] < at[1, 2] < at[1, 1] < at[1, 6] < at[1, 7]
    assert at[1, 0] == (0, 0) and at[1, 4] == (4, 0) and at[1, 2] == (4, 1) and at[1, 1] == (4, 2)
    assert json.loads(got[1, 0]["json"]) == {"content": 'say "hi"\n', "role": "user"}
    assert json.loads(got[1, 4]["json"]) == {"content": "r", "id": "early", "name": "f", "role": "tool"}
    assert json.loads(got[1, 6]["json"])["name"] is None
    assert json.loads(got[None, None]["json"]) == {"content": None, "role": None}


def test_cycles_have_no_place(spark):
    rows = [call(1, "a", after=["b"]), result(2, "a"), call(3, "b", after=["a", "late"]), result(4, "b")]
    rows += [call(5, "c", after=["x"]), call(0, "d", after=["b"]), call(8, "late"), result(9, "late"), call(7, "s", after=["s"]), result(7, "s")]
    got = {(r["turn"], r["kind"]): r["place"] for r in run(spark, rows).collect()}
    assert {k for k, v in got.items() if v is None} == {
        (1, "call"), (2, "result"), (3, "call"), (4, "result"), (0, "call"), (7, "call"), (7, "result")
    }
    assert got[5, "call"] == 5 and got[8, "call"] == 8


def test_order_keeps_every_edge(spark):
    import random

    r = random.Random(1)
    edges = [(0, str(a), str(b)) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.08]
    turns = {str(i): r.choice([i, i, 30 - i]) for i in range(30)}
    nodes = spark.createDataFrame([(0, i, t) for i, t in turns.items()], "conv_id long, node string, turn long")
    got = places(nodes, spark.createDataFrame(edges, "conv_id long, before string, after string"))
    at = {x["node"]: (x["place"], x["level"]) for x in got.collect()}
    assert all(at[a] < at[b] for _, a, b in edges)
    kept = {i for i in turns if all(b != i for _, _, b in edges)}
    assert all(at[i] == (turns[i], 0) for i in kept)


def test_a_long_conversation_in_order_takes_one_round(spark):
    n = 3000
    nodes = spark.createDataFrame([(0, str(i), i) for i in range(n)], "conv_id long, node string, turn long")
    edges = spark.createDataFrame([(0, str(i), str(i + 1)) for i in range(n - 1)], "conv_id long, before string, after string")
    assert places(nodes, edges).where("place = int(node) AND level = 0").count() == n


def test_repeated_rows_long_texts_and_none(spark):
    rows = [call(1, "a"), call(1, "a"), result(2, "a", text="é" * 200_000)]
    got = run(spark, rows).collect()
    assert len(got) == 3 and all(r["linked"] for r in got)
    assert run(spark, []).count() == 0


def test_json_helpers(spark):
    frame = spark.createDataFrame([('{ "b":1, "a" : [ ] }', 'x"\\/'), ("{", None)], "j string, t string")
    got = frame.select(canonical(frame["j"]), quoted(frame["t"])).collect()
    assert [tuple(r) for r in got] == [('{"a":[],"b":1}', '"x\\"\\\\/"'), (None, "null")]
