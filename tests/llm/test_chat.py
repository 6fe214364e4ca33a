"""Chat formatting: layouts by fingerprint, reversible escapes, odd rows, and the query against SQL."""

import hashlib
import json

import pytest

from checks import compare
from paneldrift.llm import chat, queries

SF = "/root/testdata/sf0.001"
ODD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\l", "\\<", "<|user|>", "a\\\\</s>\\b[", "é🙂\n", "|>", "\\g>", "\\\\\\"]


def turns(df):
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect())


def test_fingerprints_do_not_depend_on_order():
    assert chat.fingerprint(["b", "a[].c"]) == chat.fingerprint(["a[].c", "b", "b"]) != chat.fingerprint(["a[].d", "b"])
    assert {chat.BY_FINGERPRINT[chat.fingerprint(x.paths)].name for x in chat.LAYOUTS} == {x.name for x in chat.LAYOUTS}


def test_layouts_of_tables(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    made = [
        spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string"),
        spark.sql("SELECT array(named_struct('content', 'q', 'role', 'user'), named_struct('content', 'a', 'role', 'assistant')) messages, 1L conv_id"),
        spark.sql("SELECT 1L conv_id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) conversations"),
        spark.sql("SELECT 1L conv_id, 'q' instruction, '' input, 'a' output"),
        spark.sql("SELECT 'a' response, 'q' prompt, 1L conv_id"),
    ]
    for df in made:
        assert turns(chat.to_turns(df)) == want
    system = spark.sql("SELECT 1L conv_id, 's' system, 'q' prompt, 'a' response UNION ALL SELECT 2L, null, 'q', null")
    assert turns(chat.to_turns(system)) == [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 1, "user", "q"), (2, 2, "assistant", "")]
    extra = made[0].selectExpr("*", "'x' AS formatted", "1 AS piece")
    assert turns(chat.to_turns(extra)) == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.to_turns(spark.sql("SELECT 1 a"))


def test_layouts_of_records(spark):
    records = [
        {"conv_id": 1, "turn": 3, "role": "user", "text": "q"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "conv_id": 2},
        {"conv_id": 3, "conversations": [{"value": "q", "from": "human"}]},
        {"conv_id": 4, "instruction": "do", "input": "this", "output": "done"},
        {"conv_id": 5, "prompt": "q", "response": "a"},
        {"conv_id": 6, "system": "s", "prompt": "q", "response": "a"},
        {"conv_id": 7, "other": "x"},
    ]
    rows = [(json.dumps(r), "x") for r in records] + [("no json", "x"), (None, "x")]
    got = chat.records_to_turns(spark.createDataFrame(rows, "record string, layout string")).collect()
    found = {}
    for r in got:
        found.setdefault((r["layout"], r["conv_id"]), []).append((r["turn"], r["role"], r["text"]))
    assert found["turn rows", 1] == [(3, "user", "q")]
    assert found["messages", 2] == [(0, "user", "q"), (1, "assistant", "a")]
    assert found["from and value", 3] == [(0, "user", "q")]
    assert found["instruction", 4] == [(0, "user", "do\nthis"), (1, "assistant", "done")]
    assert found["prompt and response", 5] == [(0, "user", "q"), (1, "assistant", "a")]
    assert found["system, prompt and response", 6][0] == (0, "system", "s")
    assert len(found[None, None]) == 2 and len(found[None, 7]) == 1
    assert {r["record"] for r in got if r["layout"] is None} == {json.dumps(records[-1]), "no json", None}


def test_records_that_differ_from_their_layout(spark):
    """Empty arrays, more fields, optional fields, ids as text: nothing is lost; what has no layout comes back whole."""
    cases = {
        1: ({"messages": []}, "messages", []),
        2: ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "gpt", "content": None}]}, "messages", [(0, "user", "q"), (1, "assistant", "")]),
        3: ({"prompt": "q", "response": "a", "score": 0.5}, "prompt and response", [(0, "user", "q"), (1, "assistant", "a")]),
        4: ({"instruction": "do", "output": "done"}, "instruction", [(0, "user", "do"), (1, "assistant", "done")]),
        5: ({"system": "s", "prompt": "q", "response": "a", "meta": {"x": [1]}}, "system, prompt and response", [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]),
        6: ({"conversations": [{"from": "human", "value": "q", "w": 1}]}, "from and value", [(0, "user", "q")]),
    }
    rows = [(json.dumps({"conv_id": str(i) if i % 2 else i, **r}),) for i, (r, _, _) in cases.items()]
    rows += [('{"conv_id": 9, "messages": ["text"]}',), ('{"conv_id": 10, "messages": 5}',), ("[1]",), ('{"prompt": "q", "response": "a"}',)]
    got = chat.records_to_turns(spark.createDataFrame(rows, "record string")).collect()
    for i, (_, layout, turns_) in cases.items():
        mine = [r for r in got if r["conv_id"] == i]
        assert {r["layout"] for r in mine} == {layout}
        assert sorted((r["turn"], r["role"], r["text"]) for r in mine if r["turn"] is not None) == turns_
    assert {(r["conv_id"], r["record"]) for r in got if r["layout"] is None} == {(9, rows[6][0]), (10, rows[7][0]), (None, "[1]")}
    assert sum(r["conv_id"] is None and r["layout"] == "prompt and response" for r in got) == 2


def test_every_layout_carries_conversations_and_back(spark):
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["human", "gpt"], ["tool", ""], ["User", "assistant"]]
    rows = [(c, i, role, ODD[(c + i) % len(ODD)]) for c in range(24) for i, role in enumerate(shapes[c // 3 % 6])] + [(None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.records_to_turns(chat.as_records(df)).collect()
    assert {r["layout"] for r in back} == {x.name for x in chat.LAYOUTS}
    assert sorted((repr(r["conv_id"]), r["turn"], r["role"], r["text"]) for r in back) == sorted((repr(c), i, role, t) for c, i, role, t in rows)


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("back")).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in "<[>")


def test_read_back(spark):
    rows = [(k // 4, k % 4, ("user", "assistant", "odd|>role", None)[k % 4], t) for k, t in enumerate([*ODD, None])]
    rows += [(None, None, "assistant", "b"), (None, 0, "assistant", "c"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.to_turns(df))
    told, trained = {}, {}
    for c, t, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        told[c] = told.get(c, "") + f"{role or ''}\n{text or ''}\n"
        trained[c] = trained.get(c, "") + (text or "" if role == "assistant" else "")
    got = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert got.keys() == told.keys()
    for c, r in got.items():
        assert r["turns_sha256"] == hashlib.sha256(told[c].encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(trained[c].encode()).hexdigest() and r["loss_chars"] == len(trained[c])
    assert {r["conv_id"]: len(r["formatted"]) for r in chats.collect()} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.digests(chat.format_chats(chat.to_turns(df.where("false")))).count() == 0


def test_query_equals_sql_and_runs_no_python(spark):
    name = "op1_chat_formatting"
    result, _ = compare.compare(spark, compare.open_tables(SF), SF, queries.op1_chat_formatting, queries.SQL[name])
    assert result.startswith("ok"), result
    plan = queries.op1_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 2
