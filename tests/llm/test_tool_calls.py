import json
import random

from pyspark.sql import functions as F

from cohortflow.llm.tool_calls import SCHEMAS as TRANSCRIPT_SCHEMAS
from cohortflow.llm.tool_calls import link_tool_calls, tool_transcript

SCHEMAS = {"add": {"a": {"type": "number", "required": True, "minimum": 0}, "b": {"type": "integer", "maximum": 9}, "how": {"type": "string", "enum": ["x", "y"], "max_length": 1}, "list": {"type": "array"}, "o": {"type": "object"}, "t": {"type": "boolean"}}}


def call(*calls):
    return json.dumps({"tool_calls": [{k: v for k, v in zip(("id", "name", "arguments"), c) if v is not None} for c in calls]})


def result(call_id, content="done"):
    return json.dumps({"tool_call_id": call_id, "content": content})


def rows_of(spark, messages, schemas=SCHEMAS):
    df = spark.createDataFrame([m if len(m) == 4 else (*m, None) for m in messages], "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash")).repartition(3)
    return {(r.conv_id, r.call_id): r for r in link_tool_calls(df, schemas).collect()}


def test_links_order_and_statuses(spark):
    got = rows_of(spark, [
        (1, 0, "user", "plain"), (1, 1, "assistant", call(("p", "add", {"a": 1, "b": 2}), ("q", "add", {"a": 1.5, "list": ["$p"]}))), (1, 2, "tool", result("p", "é \"1\"")), (1, 3, "tool", result("q")),
        (1, 4, "assistant", call(("r", "add", {"a": 1, "o": {"z": "$q", "$p": 1}}))), (1, 5, "tool", result("r")), (1, 6, "tool", result("nobody")),
        (2, 1, "assistant", call(("x", "add", {"a": 1, "list": ["$y"]}), ("y", "add", {"a": 1, "list": ["$x"]}), ("z", "add", {"a": 1, "list": ["$x"]}), ("w", "add", {"a": 1, "how": "$none"}))),
        (2, 3, "assistant", call(("x", "add", {"a": 5}))), (2, 3, "assistant", call(("x", "add", {"a": 5}))), (2, 9, "tool", result("z")), (2, 8, "tool", result("z", "early")),
        (3, 1, "assistant", call((None, "add", {"a": 1}), (None, "add", {"a": 2}))), (None, 1, "assistant", call(("n", "add", {"a": 1}))), (None, 2, "tool", result("n")),
        (4, 1, "assistant", "{broken"), (4, 2, "tool", "{}"), (4, 3, "assistant", None), (4, 4, None, "x"), (4, 5, "assistant", ""), (4, 6, "assistant", "[1]"), (4, 7, "assistant", call()),
    ])
    assert {k: (r.status, r.level) for k, r in got.items()} == {
        (1, "p"): ("ok", 0), (1, "q"): ("ok", 1), (1, "r"): ("ok", 2), (1, "nobody"): ("orphan", None), (2, "x"): ("cycle", None), (2, "y"): ("cycle", None), (2, "z"): ("cycle", None),
        (2, "w"): ("no_result", 0), (3, None): ("no_id", None), (None, "n"): ("ok", 0),
    }
    assert got[1, "p"].canonical == '{"arguments":{"a":1,"b":2},"id":"p","name":"add","result":"é \\"1\\""}'
    assert json.loads(got[1, "r"].canonical)["arguments"] == {"a": 1, "o": {"$p": 1, "z": "$q"}} and '{"$p":1,"z":"$q"}' in got[1, "r"].canonical
    assert (got[2, "x"].n_calls, got[2, "x"].turn, got[2, "z"].n_results) == (3, 1, 2) and '"early"' in got[2, "z"].canonical
    assert got[2, "w"].errors == ["enum:how", "length:how", "ref:none"] and got[3, None].n_calls == 2


def test_arguments_against_schemas(spark):
    cases = {
        "ok": ({"a": 0, "b": 9, "how": "x", "list": [], "o": {}, "t": True}, []), "missing": ({}, ["missing:a"]), "types": ({"a": "1", "b": 1.5, "how": 1, "list": {}, "o": [], "t": "true"}, [f"type:{f}" for f in ("a", "b", "how", "list", "o", "t")]),
        "bounds": ({"a": -1, "b": 10, "how": "zz"}, ["enum:how", "length:how", "maximum:b", "minimum:a"]), "null": ({"a": None}, ["type:a"]), "extra": ({"a": 1, "c": 1, "B": 2}, ["unknown:B", "unknown:c"]),
        "text": ('{"b": 3, "a": 2.50}', []), "broken": ("{a", ["json"]), "array": ("[1]", ["object"]), "none": (None, ["json"]),
    }
    got = rows_of(spark, [(1, i, "assistant", call((name, "add", args))) for i, (name, (args, _)) in enumerate(cases.items())] + [(1, 99, "assistant", call(("other", "sub", {"a": 1})))])
    assert {k: got[1, k].errors for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert got[1, "other"].errors == ["tool"] and '"arguments":{"a":2.5,"b":3}' in got[1, "text"].canonical


def test_long_chain_hot_conversation_and_empty(spark):
    chain = [(7, i, "assistant", call((f"k{i}", "add", {"a": i, "list": [f"$k{i - 1}"] if i else []}))) for i in range(150)]
    crowd = [(7, 100 + i, "assistant", call((f"m{i}", "add", {"a": i, "list": ["$k3"]}))) for i in range(300)]
    got = rows_of(spark, chain + crowd + [(7, 500, "assistant", call(("big", "add", {"a": 1, "how": "x" * 300_000})))])
    assert all(got[7, f"k{i}"].level == i for i in range(150)) and all(got[7, f"m{i}"].level == 4 for i in range(300))
    assert len(got[7, "big"].canonical) > 300_000
    assert rows_of(spark, []) == {}


def test_levels_of_random_graphs(spark):
    rng = random.Random(6)
    messages, deps = [], {}
    for conv in range(12):
        for i in range(25):
            span = range(i) if conv % 3 else range(25)  # every third conversation may refer forward, and so in circles
            deps[conv, i] = sorted({rng.choice(span) for _ in range(rng.choice([0, 1, 1, 2, 3]))}) if len(span) else []
            messages.append((conv, i, "assistant", call((f"k{i}", "add", {"a": 1, "list": [f"$k{d}" for d in deps[conv, i]]}))))

    def level(node, path=()):
        if node in path:
            return None
        below = [level((node[0], d), (*path, node)) for d in deps[node]]
        return None if None in below else max(below, default=-1) + 1

    got = rows_of(spark, messages)
    assert {k: r.level for k, r in got.items()} == {(c, f"k{i}"): level((c, i)) for c, i in deps}
    assert any(r.status == "cycle" for r in got.values())


def test_transcript(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "one two"), (1, 2, "assistant", "answer"), (1, 3, "user", "three"), (2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "assistant", "alone")]
    got = rows_of(spark, [tuple(r) for r in tool_transcript(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()], TRANSCRIPT_SCHEMAS)
    assert {k: (r.status, r.level) for k, r in got.items()} == {(1, "c0"): ("no_result", 0), (1, "c1"): ("ok", 1), (1, "c3"): ("no_result", 2), (2, "c0"): ("invalid", 0), (3, "c-1"): ("orphan", None)}
    assert json.loads(got[1, "c1"].canonical)["arguments"] == {"after": ["$c0"], "query": "one two", "words": 2}
