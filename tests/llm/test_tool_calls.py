import json

from treatlens.llm.tool_calls import REPLY_SCHEMA, calls_of_turns, link_tool_calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}}
CALL = "conv_id long, call_id string, parent_id string, position long, name string, arguments string, depth string"
RESULT = "conv_id long, call_id string, position long, content string, line string"


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALL)
    r = spark.createDataFrame([(*x, "clash") for x in results], RESULT)
    return link_tool_calls(c, r, SCHEMAS).collect()


def test_links_orders_validates_and_serialises(spark):
    calls = [
        (1, "c2", "c1", 3, "add", '{"b": 1.5, "a": 2, "note": "x\\n\\"y"}'),
        (1, "c1", None, 1, "add", '{"a": 1}'),
        (1, "c3", "c2", 5, "add", '{"b": "no", "z": {"q": 1, "p": [2, 1]}}'),
        (1, "c4", "c9", 7, "mul", "{}"), (1, "c5", None, 8, "add", "not json"), (1, "c6", None, 9, "add", "[1]"),
        (1, "c7", None, 10, "add", None), (1, "c8", None, 11, "add", '{"a": 1, "a": 2}'),
        (2, "x", "y", 1, "add", '{"a": 1}'), (2, "y", "x", 2, "add", '{"a": 1}'), (2, "z", "x", 3, "add", '{"a": 1}'),
        (3, "d", None, 5, "add", '{"a": 7}'), (3, "d", None, 4, "add", '{"a": 6}'),
        (None, "n", None, 1, "add", '{"a": 1}'), (4, None, None, 1, "add", '{"a": 1}'),
    ]
    results = [(1, "c1", 2, "one"), (1, "c2", 4, None), (1, "zz", 6, "lost"), (3, "d", 9, "late"), (3, "d", 6, "early"), (None, "n", 2, "r")]
    got = run(spark, calls, results)
    by = {(r.conv_id, r.call_id, r.status == "orphan"): r for r in got}
    repeated = sorted((r.conv_id, r.call_id, r.position, r.depth) for r in got if r.status == "duplicate")
    assert repeated == [(3, "d", 5, None), (3, "d", 9, None)] and len(got) == 18
    got = [r for r in got if r.status != "duplicate"]
    by = {(r.conv_id, r.call_id, r.status == "orphan"): r for r in got}
    assert len(got) == len(by) == 16
    status = {k[:2]: r.status for k, r in by.items() if not k[2]}
    assert status[1, "c1"] == status[1, "c2"] == status[3, "d"] == "ok"
    assert [status[1, f"c{i}"] for i in (3, 4, 5, 6, 7, 8)] == ["invalid"] * 6
    assert status[2, "x"] == status[2, "y"] == status[2, "z"] == "cycle"
    assert status[None, "n"] == status[4, None] == "no_id"
    assert (1, "zz", True) in by and (None, "n", True) in by
    assert [by[1, c, False].depth for c in ("c1", "c2", "c3", "c4")] == [0, 1, 2, 0]
    line = by[1, "c2", False].line
    assert line.startswith('{"arguments":{"a":2,"b":1.5,"note":"x\\n\\"y"},"call_id":"c2"') and json.loads(line)["result"] is None
    assert json.loads(by[1, "c3", False].line)["errors"] == ["missing a", "b is not number"]
    assert '"z":{"p":[2,1],"q":1}' in by[1, "c3", False].line
    assert json.loads(by[3, "d", False].line)["arguments"] == {"a": 6} and json.loads(by[3, "d", False].line)["result"] == "early"


def test_long_chains_and_empty_tables(spark):
    n = 300
    calls = [(1, str(i), str(i - 1), i, "add", '{"a": 1}') for i in range(n)]
    got = run(spark, calls, [])
    assert {int(r.call_id): r.depth for r in got} == {i: i for i in range(n)}
    assert {r.status for r in got} == {"unanswered"}
    assert run(spark, [], []) == []
    assert [r.status for r in run(spark, [], [(1, "a", 1, "x")])] == ["orphan"]


def test_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", None), (None, 1, "user", "x")],
        "conv_id long, turn int, role string, text string",
    )
    calls, results, messages = calls_of_turns(turns)
    assert {(r.call_id, r.parent_id) for r in calls.filter("conv_id = 1").collect()} == {("1:1", "1:-1"), ("1:3", "1:1")}
    assert [r.call_id for r in results.collect()] == ["1:1"]
    assert [tuple(r) for r in messages.collect()] == [(1, 0, "system", "s")]


def test_every_turn_has_a_line(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 1, "user", "other"), (1, 2, "assistant", "a"),
        (1, 2, "assistant", "a"), (1, 3, None, None), (2, None, "tool", "t"), (None, None, None, "x"), (2, 5, "assistant", "lost"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, messages = calls_of_turns(turns)
    got = link_tool_calls(calls, results, REPLY_SCHEMA, messages).collect()
    status = sorted(r.status for r in got)
    assert status == sorted(["ok", "orphan", "duplicate", "duplicate", "duplicate"] + ["message"] * 4)
    assert len(got) == len(rows) - 1  # a call and its result share a line
    texts = [json.loads(r.line) for r in got]
    held = [x for t in texts for x in ((t["arguments"] or {}).get("prompt"), t["result"]) if x is not None]
    assert sorted(held) == sorted(t for *_, t in rows if t is not None)
    assert {t["name"] for t in texts if t["status"] == "message"} == {"system", None, "tool"}
