import json
import random

from lakemill.llm.chat import ORACLE, link_tool_calls

CALL = json.dumps({"content": "let me", "tool_calls": [{"id": "c1", "name": "search", "arguments": '{"query": "a b", "limit": 3}'}, {"id": "c2", "name": "fetch", "arguments": {"url": 5, "zz": None}}]})


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, made int")


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_order_and_faults(spark):
    rows = [(1, 0, "user", 'say "hi"\n é'), (1, 1, "tool", result("c1", '{"b":1, "a": [2, 1]}')), (1, 2, "assistant", CALL), (1, 3, "tool", result("c2")), (1, 4, "tool", result("nobody")), (2, 0, "tool", result("c1")), (1, 5, "assistant", json.dumps({"tool_calls": [{"id": "c1", "name": "none", "arguments": "{"}]}))]
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [t for _, t in sorted((k for k in got if k[0] == 1), key=lambda k: (got[k].anchor, got[k].level, k[1]))] == [0, 2, 1, 3, 4, 5]
    assert (got[1, 1].linked_turn, got[1, 1].anchor, got[1, 1].level) == (2, 2, 1) and (got[1, 3].linked_turn, got[1, 3].level) == (2, 0)
    assert got[1, 4].errors == got[2, 0].errors == "orphan result" and got[1, 4].linked_turn is None
    assert got[1, 2].n_calls == 2 and got[1, 2].errors == "c2: unknown zz; c2: url is not a string"
    assert got[1, 5].errors == "c1: unknown tool"
    assert json.loads(got[1, 0].message) == {"content": 'say "hi"\n é', "role": "user"}
    assert got[1, 1].message == r'{"content":"{\"a\":[2,1],\"b\":1}","role":"tool","tool_call_id":"c1"}'
    assert got[1, 2].message == r'{"content":"let me","role":"assistant","tool_calls":[{"arguments":"{\"limit\":3,\"query\":\"a b\"}","id":"c1","name":"search"},{"arguments":"{\"url\":5,\"zz\":null}","id":"c2","name":"fetch"}]}'


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 1, "assistant", "{not json tool_calls"), (1, 1, "assistant", "{not json tool_calls"), (1, 2, "tool", "plain"), (1, 3, "user", "x" * 300_000), (1, 4, "assistant", ""), (1, None, "tool", result("c1")), (1, 5, "assistant", '{"tool_calls": [{"name": "search"}]}')]
    got = link_tool_calls(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(set(json.loads(r.message)) >= {"content", "role"} for r in got)
    assert [r.errors for r in got if r.turn == 5] == [": missing query"]
    assert link_tool_calls(table(spark, rows).limit(0)).collect() == []


def test_a_conversation_with_a_third_of_all_turns(spark):
    rows = [(0, k, "user", "same") for k in range(500)] + [(k, 0, "user", "x") for k in range(1, 1000)]
    assert link_tool_calls(table(spark, rows)).count() == 1499


def test_no_python_on_the_executors(spark):
    plan = link_tool_calls(table(spark, [(1, 1, "user", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def generated(n=60):
    """Conversations whose calls refer to earlier results, some of them late, repeated, missing or without a call."""
    rnd, rows = random.Random(12), []
    for conv in range(n):
        turns, waiting, known = list(range(rnd.randrange(4, 16))), [], []
        for t in turns:
            kind = rnd.random()
            if kind < 0.4:
                calls = []
                for _ in range(rnd.randrange(1, 3)):
                    i = f"c{rnd.randrange(6)}"
                    calls.append({"id": i, "name": "fetch", "arguments": {"url": "$" + rnd.choice([*known, "c9"]) if known and rnd.random() < 0.8 else "x"}})
                    waiting.append(i)
                known += [c["id"] for c in calls]
                rows.append((conv, t, "assistant", json.dumps({"content": "", "tool_calls": calls})))
            elif kind < 0.9:
                i = waiting.pop(rnd.randrange(len(waiting))) if waiting and rnd.random() < 0.7 else f"c{rnd.randrange(7)}"
                rows.append((conv, t, "tool", result(i)))
            else:
                rows.append((conv, t, "user", "go on"))
    return rows


def places(rows):
    """(anchor, level) by conversation and turn, by following every dependency."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {t: (role, json.loads(text) if text.startswith("{") else {}) for c, t, role, text in rows if c == conv}
        made, answered = {}, {}
        for t in sorted(own):
            for call in own[t][1].get("tool_calls", []):
                made.setdefault(call["id"], t)
            if "tool_call_id" in own[t][1]:
                answered.setdefault(own[t][1]["tool_call_id"], t)

        def at(t, conv=conv, own=own, made=made, answered=answered):
            if (conv, t) not in out:
                best, doc = (t, 0), own[t][1]
                for call in doc.get("tool_calls", []):
                    for v in call["arguments"].values():
                        i = v[1:]
                        if v.startswith("$") and made.get(i, t) < t:
                            a, b = at(made[i])
                            if i in answered:
                                a, b = max((a, b + 1), (answered[i], 0))
                            best = max(best, (a, b + 1))
                if "tool_call_id" in doc and doc["tool_call_id"] in made:
                    a, b = at(made[doc["tool_call_id"]])
                    best = max(best, (a, b + 1))
                out[conv, t] = best
            return out[conv, t]

        for t in own:
            at(t)
    return out


def test_generated_conversations_against_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rows = generated()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(docs.repartition(4)).collect()}
    want = places(rows)
    assert {k: (r.anchor, r.level) for k, r in got.items()} == want
    assert max(level for _, level in want.values()) >= 4
    assert any("no earlier call" in r.errors for r in got.values()) and any("no result of" in r.errors for r in got.values())
    docs.coalesce(1).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/t/*.parquet')")
    names = ["conv_id", "turn", "anchor", "level", "role", "n_calls", "call_id", "linked_turn"]
    found = con.execute(f"select {', '.join(names)} from ({ORACLE})").fetchall()
    assert sorted(found) == sorted(tuple(r[c] for c in names) for r in got.values())
