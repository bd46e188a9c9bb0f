"""op1 against plain Python."""

import json

from banditflow.llm import tool_calls as tc

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, status string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, r string"


def linked(spark, calls, results):
    a = spark.createDataFrame([(*c, "x", 9) for c in calls], CALLS)
    b = spark.createDataFrame([(*r, "x") for r in results], RESULTS)
    return tc.link_calls(a, b, tc.SCHEMAS).collect()


def test_linking_order_and_status(spark):
    ok = '{"limit": 5.0, "query": "é"}'
    calls = [
        (1, 5, "a", "search", ok, ["b"]),  # needs a later one
        (1, 7, "b", "lookup", '{"key": "abc"}', None),
        (1, 9, "c", "measure", '{"words": 3, "unit": "word", "more": [1, {"z": 1, "a": 2}]}', ["a", "b", "zz", None, "c"]),
        (1, 9, "d", "lookup", '{"key": 7}', []),
        (1, 11, "e", "nothing", "{}", []),
        (1, 11, "f", "search", "{broken", []),
        (1, 12, "g", "search", ok, ["h"]),
        (1, 13, "h", "search", ok, ["g"]),
        (1, 14, "i", "search", ok, ["h"]),
        (1, 6, "a", "search", ok, []),  # a second call of the same id
        (2, 1, "a", None, None, None),
        (None, 1, "a", "search", ok, []), (3, None, "a", "search", ok, []), (3, 1, None, "search", ok, []),
    ]
    results = [
        (1, 6, "a", "late"), (1, 6, "a", "first"), (1, 4, "a", "too early"), (1, 8, "b", None), (1, 8, "b", ""),
        (1, 20, "orphan", "x"), (None, 1, "a", "x"), (2, None, "a", "x"), (1, 10, "d", "r"),
    ]
    rows = linked(spark, calls, results)
    by = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == 11
    status = {k[1]: r.status for k, r in by.items() if k[0] == 1 and k[2] != 6}
    assert status == {"a": "linked", "b": "linked", "c": "unanswered", "d": "invalid", "e": "invalid", "f": "invalid", "g": "cycle", "h": "cycle", "i": "cycle"}
    assert by[1, "a", 6].status == "duplicate" and by[1, "a", 6].position is None
    a = by[1, "a", 5]
    assert (a.level, a.result_turn, a.n_results) == (1, 6, 3)
    assert a.record == '{"arguments":{"limit":5,"query":"é"},"id":"a","name":"search","result":"first"}'
    order = sorted((r.position, r.call_id) for k, r in by.items() if k[0] == 1 and r.position is not None)
    assert order == list(enumerate(["b", "d", "e", "f", "a", "c"]))
    assert by[1, "c", 9].record.startswith('{"arguments":{"more":[1,{"a":2,"z":1}],"unit"')
    assert by[1, "d", 9].problem == "$.key: type" and by[1, "f", 11].problem == "not JSON"
    assert by[2, "a", 1].problem == "unknown tool" and by[2, "a", 1].n_results == 1


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    """2,000 calls, each needing the one before, and a cycle beside them: ordered by tasks and, beyond HELD, by joins alike."""
    rows = [(1, f"c{i}", [f"c{i - 1}", "none"]) for i in range(2000)] + [(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["b"]), (2, "d", None)]
    rows += [(3, f"x{i}", [f"x{i // 2}", f"x{i // 3}", None]) for i in range(60)] + [(None, "n", []), (None, "m", ["n"])]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>").repartition(3)
    written = []
    keep = tc.materialize
    monkeypatch.setattr(tc, "materialize", lambda d: written.append(1) or keep(d))
    got = {(r.conv_id, r.call_id): r.level for r in tc.levels(df).collect()}
    assert len(written) < 5
    assert all(got[1, f"c{i}"] == i for i in range(2000)) and [got.get((2, c)) for c in "abcd"] == [None, None, None, 0]
    assert (got[None, "n"], got[None, "m"]) == (0, 1) and len(got) == 2063
    monkeypatch.setattr(tc, "HELD", 8)
    few = df.where("conv_id <> 1")
    joined = {(r.conv_id, r.call_id): r.level for r in tc.levels(few).collect()}
    assert joined == {k: v for k, v in got.items() if k[0] in (2, 3)}


def test_lone_surrogates_numbers_and_enums(spark):
    bad = '{"query":"\\ud800","limit":3}'
    rows = {r.call_id: r for r in linked(spark, [(1, 1, "a", "search", bad, []), (1, 3, "b", "search", '{"query":"\\ud83d\\ude00","limit":3}', [])], [])}
    assert rows["a"].status == "invalid" and rows["a"].problem == "not Unicode" and json.loads(rows["a"].record)["arguments"] is None
    assert json.loads(rows["b"].record)["arguments"]["query"] == "\U0001f600"
    for one, other in (("1e16", "10000000000000000"), ("1e21", "1" + "0" * 21), ("-0.0", "0"), ("2.50", "2.5"), ("1e300", str(int(1e300)))):
        assert tc.canonical(json.loads(one)) == tc.canonical(json.loads(other))
    assert tc.canonical(10**22 + 1) == str(10**22 + 1)
    assert tc.problem(True, {"enum": [1]}) == "$: enum" and tc.problem(1.0, {"enum": [1]}) is None and tc.problem(1, {"enum": [True]}) == "$: enum"
    assert tc.problem([1.0], {"enum": [[1]]}) is None


def test_nothing(spark):
    a, b = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tc.link_calls(a, b, tc.SCHEMAS).collect() == []


def test_schema_problems():
    s = tc.SCHEMAS
    assert tc.problem({"query": "x", "limit": 3}, s["search"]) is None
    assert tc.problem({"query": "", "limit": 3}, s["search"]) == "$.query: length"
    assert tc.problem({"query": "x"}, s["search"]) == "$.limit: missing"
    assert tc.problem({"query": "x", "limit": True}, s["search"]) == "$.limit: type"
    assert tc.problem({"query": "x", "limit": 51}, s["search"]) == "$.limit: range"
    assert tc.problem({"query": "x", "limit": 1, "z": 0}, s["search"]) == "$.z: unknown"
    assert tc.problem({"query": "x", "limit": 1, "after": ["a", 3]}, s["search"]) == "$.after[1]: type"
    assert tc.problem({"words": 1, "unit": "line"}, s["measure"]) == "$.unit: enum"


def test_canonical():
    text = tc.canonical({"b": [1.0, 2.5, None, True], "a": {"é": "\n", "B": 10**20}})
    assert text == '{"a":{"B":100000000000000000000,"é":"\\n"},"b":[1,2.5,null,true]}'
    assert tc.canonical(json.loads(text)) == text


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "lookup it"), (1, 2, "user", "there"), (1, 3, "assistant", None),
        (1, 5, "assistant", "a b c"), (None, 1, "assistant", "x"), (1, None, "assistant", "x"), (2, 1, None, "x"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, words string")
    calls, results = tc.conversation_calls(df)
    got = {r.call_id: r for r in tc.link_calls(calls, results, tc.SCHEMAS).collect()}
    assert set(got) == {"c1", "c3", "c5"}
    assert (got["c1"].status, got["c1"].result_turn, got["c1"].level) == ("linked", 2, 0)
    assert got["c3"].status == "invalid" and got["c3"].level == 1
    assert got["c5"].status == "unanswered" and got["c5"].position == 1 + (got["c3"].turn < 5 and got["c3"].level == 0)


def test_long_conversation(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"word{t} x") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = tc.conversation_calls(df)
    got = tc.link_calls(calls, results, tc.SCHEMAS).collect()
    assert sorted(r.position for r in got) == list(range(750))
    by = {r.turn: r for r in got}
    for r in got:
        assert r.level == (by[r.turn // 2].level + 1 if r.turn > 1 and r.turn // 2 in by else 0)
    order = sorted(got, key=lambda r: r.position)
    assert [r.turn for r in order] == [r.turn for r in sorted(got, key=lambda r: (r.level, r.turn))]
