import json

from echoframe.llm import chat
from tests.llm.conftest import ODD_ROWS

SCHEMAS = {"search": {"q": {"type": "string", "required": True, "min_length": 2, "max_length": 9}, "n": {"type": "integer", "minimum": 1, "maximum": 5},
                      "kind": {"type": "string", "enum": ["a", "b"]}},
           "merge": {"left": {"type": "reference", "required": True}, "right": {"type": "reference"}, "flags": {"type": "object"},
                     "list": {"type": "array"}, "x": {"type": "number"}, "on": {"type": "boolean"}}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv long, turn long, text string")
    return {(r["conv"], r["id"]): r for r in chat.link_tool_calls(df, "conv", "turn", "text", SCHEMAS).collect()}


def test_links_order_and_json(spark):
    got = linked(spark, [
        (1, 0, "hello"), (1, 1, call(("b", "search", {"q": "xy", "n": 2}), ("a", "search", '{"q":"é \\"z","kind":"a"}'))),
        (1, 2, result("a", {"z": 1, "a": [1.50, None]})), (1, 3, call(("m", "merge", {"left": "a", "right": "b", "x": 1.5, "on": True, "list": [], "flags": {}}))),
        (1, 4, result("b", "text\nline")), (1, 5, result("lost", 3))])
    assert [got[1, i]["position"] for i in "bam"] == [0, 1, 2] and all(got[1, i]["valid"] for i in "bam")
    assert [got[1, i]["answered"] for i in "bam"] == [True, True, False]
    assert got[1, "a"]["record"] == '{"arguments":{"kind":"a","q":"é \\"z"},"id":"a","name":"search","result":{"a":[1.5,null],"z":1}}'
    assert got[1, "b"]["record"] == '{"arguments":{"n":2,"q":"xy"},"id":"b","name":"search","result":"text\\nline"}'
    assert got[1, "lost"]["problems"] == ["result without a call"] and got[1, "lost"]["position"] is None
    assert json.loads(got[1, "m"]["record"])["result"] is None


def test_arguments(spark):
    cases = {"ok": ("search", {"q": "abc"}), "missing": ("search", {}), "null": ("search", {"q": None}), "type": ("search", {"q": 5}),
             "short": ("search", {"q": "a"}), "long": ("search", {"q": "a" * 10}), "n": ("search", {"q": "ab", "n": 0}), "n2": ("search", {"q": "ab", "n": 6}),
             "n3": ("search", {"q": "ab", "n": 1.5}), "kind": ("search", {"q": "ab", "kind": "c"}), "none": ("search", None), "text": ("search", "no json"),
             "tool": ("other", {}), "ref": ("merge", {"left": "nowhere"}), "flags": ("merge", {"left": "ok", "flags": 1, "list": {}, "x": "1", "on": 0})}
    got = linked(spark, [(1, n, call((i, *c))) for n, (i, c) in enumerate(cases.items())])
    problems = {i: got[1, i]["problems"] for i in cases}
    assert problems["ok"] == [] and problems["missing"] == problems["null"] == ["q: missing"] and problems["type"][0] == "q: no string"
    assert problems["short"] == ["q: too short"] and problems["long"] == ["q: too long"]
    assert problems["n"] == ["n: too small"] and problems["n2"] == ["n: too large"] and problems["n3"] == ["n: no integer"]
    assert problems["kind"] == ["kind: not allowed"] and "arguments: no object" in problems["none"] and "arguments: no object" in problems["text"]
    assert problems["tool"] == ["unknown tool"] and problems["ref"] == ["names an unknown call"]
    assert problems["flags"] == ["flags: no object", "list: no array", "x: no number", "on: no boolean"]


def test_calls_that_name_later_ones(spark):
    got = linked(spark, [
        (1, 0, call(("a", "merge", {"left": "c"}))), (1, 1, call(("b", "merge", {"left": "a"}))), (1, 2, call(("c", "search", {"q": "xx"}))),
        (2, 0, call(("x", "merge", {"left": "y"}))), (2, 1, call(("y", "merge", {"left": "x"}), ("z", "search", {"q": "xx"}))),
        (3, 0, call(("s", "merge", {"left": "s"}))), (4, 0, call(("p", "search", {"q": "xx"})))])
    assert [got[1, i]["position"] for i in "cab"] == [0, 1, 2] and got[1, "a"]["valid"]
    assert got[2, "x"]["position"] is None and "in a cycle" in got[2, "y"]["problems"] and got[2, "z"]["position"] == 0
    assert "in a cycle" in got[3, "s"]["problems"] and got[4, "p"]["position"] == 0


def test_repeated_and_early(spark):
    got = linked(spark, [(1, 5, call(("a", "search", {"q": "xx"}))), (1, 5, call(("a", "search", {"q": "xx"}))), (1, 2, result("a", "early")),
                         (1, 7, result("b", 1)), (1, 8, result("b", 2)), (1, 6, call(("b", "search", {"q": "yy"})))])
    assert set(got[1, "a"]["problems"]) == {"identifier repeated", "result before its call"}
    assert got[1, "b"]["problems"] == ["several results"] and json.loads(got[1, "b"]["record"])["result"] == 1


def test_contents_of_repeated_identifiers_stay(spark):
    got = linked(spark, [(1, 0, call(("a", "search", {"q": "xx"}))), (1, 1, call(("a", "search", {"q": "yy"}))), (1, 2, result("a", "r1")),
                         (1, 3, result("a", None)), (1, 4, result("a", {"z": 1}))])
    record = json.loads(got[1, "a"]["record"])
    assert record["arguments"] == {"q": "xx"} and record["further_calls"] == [{"arguments": {"q": "yy"}, "name": "search"}]
    assert record["result"] == "r1" and record["further_results"] == [None, {"z": 1}]


def test_every_message_has_a_row(spark):
    rows = [(1, 0, '{"tool_calls": [null, {"name": "search", "arguments": {"q": "xx"}}]}'), (1, 1, '{"role": "tool", "content": 5}'), (1, 2, "plain"),
            (1, 3, None), (None, 4, result("r", 1)), (1, None, call(("c", "search", {"q": "xx"}))), (1, 6, call(("ok", "search", {"q": "xx"})))]
    df = spark.createDataFrame(rows, "conv long, turn long, text string")
    got = sorted((r["turn"] if r["turn"] is not None else 99, r["id"] or "", r["problems"], json.loads(r["record"]))
                 for r in chat.link_tool_calls(df, "conv", "turn", "text", SCHEMAS, every=True).collect() if r["turn"] != 0)
    assert [g[:3] for g in got] == [(1, "", ["no identifier"]), (2, "", []), (3, "", []), (4, "r", ["no conversation or turn"]), (6, "ok", []),
                                    (99, "c", ["no conversation or turn"])]
    assert got[0][3]["content"] == 5 and got[1][3]["content"] == "plain" and got[3][3]["content"] == 1 and got[5][3]["arguments"] == {"q": "xx"}
    both = chat.link_tool_calls(df.where("turn = 0"), "conv", "turn", "text", SCHEMAS, every=True).collect()
    assert len(both) == 2 and all("no identifier" in r["problems"] and not r["valid"] for r in both)


def test_every_turn_of_a_dialogue(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    messages = chat.as_protocol(turns, "conv_id", "turn", "role", "text")
    every = chat.link_tool_calls(messages, "conv", "turn", "text", chat.REPLY, every=True)
    got = sorted((r["conv"], r["turn"], json.loads(r["record"])["content"]) for r in every.collect() if r["id"] is None)
    want = sorted(tuple(r) for r in turns.where("role not in ('user', 'assistant')").select("conv_id", "turn", "text").collect())
    assert got == want and len(want) == 24


def test_long_conversation_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 10)
    got = linked(spark, [(1, t, call((f"c{t}", "search", {"q": "xx"}))) for t in range(0, 200, 3)])
    assert [got[1, f"c{t}"]["position"] for t in range(0, 200, 3)] == list(range(67))


def test_odd_rows(spark, odd, none):
    protocol = chat.as_protocol(odd.withColumnRenamed("lang", "role"), "doc_id", "n_chars", "role", "text")
    assert chat.link_tool_calls(protocol, "conv", "turn", "text", chat.REPLY).collect() == []
    assert protocol.count() == len(ODD_ROWS)
    assert chat.link_tool_calls(none, "doc_id", "n_chars", "text", chat.REPLY).collect() == []
    rows = [(None, 1, call(("a", "search", {"q": "xx"}))), (1, None, call(("a", "search", {"q": "xx"}))), (1, 1, None), (1, 2, ""), (1, 3, "[1]"),
            (1, 4, '{"tool_calls": 5}'), (1, 5, '{"tool_calls": [null, {"name": "search"}]}'), (1, 6, call(("ok", None, {"q": "y" * 200_000})))]
    got = linked(spark, rows)
    assert set(got) == {(1, "ok")} and got[1, "ok"]["problems"] == ["no name"] and len(got[1, "ok"]["record"]) > 200_000


def test_no_python_on_executors(spark):
    messages = chat.as_protocol(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), "conv_id", "turn", "role", "text")
    plan = chat.link_tool_calls(messages, "conv", "turn", "text", chat.REPLY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
