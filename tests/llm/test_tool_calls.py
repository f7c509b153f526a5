import json

import pytest

from complaintflow.llm import tool_calls

SCHEMA = "conv_id long, turn long, role string, text string"
DECLARED = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"]}},
                      {"name": "cat", "parameters": {"properties": {"t": {"type": "string"}}, "required": []}}]}


def call(i, name, arguments, *after):
    return {"id": i, "name": name, "arguments": arguments, **({"depends_on": list(after)} if after else {})}


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "system", json.dumps(DECLARED)), (1, 1, "user", 'hi "x"\n é'),
    (1, 2, "assistant", json.dumps({"content": "ok", "tool_calls": [call("c2", "cat", {"t": "z", "q": {"b": 1, "a": [2, 1]}}, "c1"), call("c1", "add", {"b": 1.5, "a": 2})]})),
    (1, 3, "tool", result("c2", "zz")), (1, 4, "tool", result("c1", {"v": 3})), (1, 5, "tool", result("c1", "again")), (1, 6, "tool", result("c9", "x")),
    (1, 7, "assistant", json.dumps({"tool_calls": [call("d1", "add", {"a": "no"}), call("d2", "nix", {}), call("d3", "add", '{"a": 5}'),
                                                   call("d3", "add", {}), call("e1", "cat", {}, "e2"), call("e2", "cat", {}, "e1"), call("f1", "cat", "no json")]})),
    (2, 0, "user", None), (2, 1, "assistant", "{broken"), (2, 1, "assistant", "{broken"), (None, None, None, None), (3, 0, "user", "x" * 100_000),
]


def brute(rows):
    """Items as (conv_id, turn, kind, id, problem, json), in training order."""
    compact = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    out, of = [], lambda c: [r for r in rows if r[0] == c]
    for conv in {r[0] for r in rows}:
        calls, answers, tools, items = {}, {}, {}, []
        parsed = []
        for r in of(conv):
            try:
                x = json.loads(r[3]) if r[3] and r[3].lstrip().startswith("{") else {}
            except ValueError:
                x = {}
            parsed.append((r, x))
            for t in x.get("tools", []) if r[2] == "system" else []:
                tools.setdefault(t["name"], t["parameters"])
            for n, c in enumerate(x.get("tool_calls", []) if r[2] == "assistant" else [], 1):
                calls.setdefault(c["id"], (r[1], n, c))
        for r, x in parsed:
            if r[2] == "tool" and "tool_call_id" in x and x["tool_call_id"] in calls and r[1] > calls[x["tool_call_id"]][0]:
                answers.setdefault(x["tool_call_id"], r[1])

        def level(i, path=()):
            if i in path:
                return None
            below = [level(j, (*path, i)) for j in calls[i][2].get("depends_on", []) if j in calls]
            return None if None in below else max(below, default=-1) + 1

        types = {"integer": int, "number": (int, float), "string": str}
        for r, x in parsed:
            if r[2] == "tool" and "tool_call_id" in x:
                i = x["tool_call_id"]
                fits = answers.get(i) == r[1]
                place = (calls[i][0], (level(i) or 0) + 1, calls[i][1]) if fits else (r[1], 0, 0)
                content = x["content"] if isinstance(x["content"], str) else compact(x["content"])
                problem = None if fits else "duplicate_result" if i in answers and r[1] > answers[i] else "no_call"
                items.append((*place, "result", r[1], i, problem, compact({"content": content, "id": i, "role": "tool"})))
                continue
            asked = r[2] == "assistant" and "tool_calls" in x
            items.append((r[1], 0, 0, "message", r[1], None, None, compact({"content": x.get("content") if asked else r[3], "role": r[2]})))
            for n, c in enumerate(x["tool_calls"] if asked else [], 1):
                a = c["arguments"]
                try:
                    a = json.loads(a) if isinstance(a, str) else a
                except ValueError:
                    pass
                first = calls[c["id"]][:2] == (r[1], n)
                schema = tools.get(c["name"])
                valid = schema is not None and isinstance(a, dict) and set(schema["required"]) <= set(a) and all(
                    isinstance(a[k], types[v["type"]]) for k, v in schema["properties"].items() if k in a)
                problem = ("duplicate_id" if not first else "cyclic" if level(c["id"]) is None else "unknown_tool" if schema is None
                           else "invalid_arguments" if not valid else None if c["id"] in answers else "no_result")
                items.append((r[1], (level(c["id"]) or 0) + 1, n, "call", r[1], c["id"], problem,
                              compact({"arguments": a if isinstance(a, dict) else {"x": a}, "id": c["id"], "name": c["name"]})))
        items.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2], t[3], t[4] or 0))
        out += [(conv, t[4], t[3], *t[5:]) for t in items]
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0))


@pytest.mark.parametrize("partitions", [1, 4])
def test_items_against_brute_force(spark, partitions):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions).selectExpr("*", "1 AS id", "2 AS level", "3 AS call")
    got = [(r["conv_id"], r["turn"], r["kind"], r["id"], r["problem"], r["json"]) for r in tool_calls.link(df).collect()]
    assert got == brute(ROWS)


def test_long_chain_of_dependencies(spark):
    calls = [call(f"k{i}", "cat", {}, *([f"k{i + 1}"] if i < 5 else [])) for i in range(6)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls}))]
    got = [r["id"] for r in tool_calls.link(spark.createDataFrame(rows, SCHEMA)).collect() if r["kind"] == "call"]
    assert got == [f"k{i}" for i in range(5, -1, -1)]


def test_no_rows(spark):
    assert tool_calls.link(spark.createDataFrame([], SCHEMA)).count() == 0
