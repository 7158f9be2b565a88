import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asofledger.llm import exact, mixing, pieces, queries, toolcalls, toxicity
from asofledger.llm.common import materialize
from test_near_and_exact import similar_classes

ROWS = [(i, "w " * (1 + i % 7), "big" if i < 60 else "mid" if i < 80 else None) for i in range(90)] + [(200, "", "empty"), (201, None, "empty"), (None, "a b", "big"), (5, "w w", "big"), (5, "w w", "big")]


def mixed(rows, limit):
    """Brute force of the mixture: Counter of (doc_id, source) copies."""
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    total = Counter()
    for _, t, s in rows:
        total[s] += n(t)
    some = {s: v for s, v in total.items() if v}
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if max((v / max(some.values())) ** (mid - 1) for v in some.values()) <= limit else (mid, high)
    a = high if max((v / max(some.values())) ** -1.0 for v in some.values()) > limit else 0.0
    powers = sum(v**a for v in some.values())
    spent = max(v ** (1 - a) for v in some.values()) * powers
    out = Counter()
    for s in total:
        own = sorted((place(d), d, n(t)) for d, t, x in rows if x == s) if s in some else []
        quota = math.floor(some[s] ** a / powers * spent + 0.5) if s in some else 0
        passes = quota // some[s] if s in some else 1
        rest, done, last = quota - passes * total[s], 0, -1
        for p, _, k in own:
            if done < rest:
                last = p
            done += k
        for d, _, x in rows:
            if x == s:
                out[d, s] += passes + (place(d) <= last)
    return out


@pytest.mark.parametrize("limit", [1.0, 1.7, 50.0])
def test_mix_matches_brute_force(spark, limit):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(df, max_epochs=limit).collect())
    assert got == mixed(ROWS, limit)


def test_mix_entropy_budget_and_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("__place", F.lit(1))
    plan = mixing.plan(df, target_entropy=1.0, max_epochs=None, budget=100.0).toPandas().set_index("source")
    w = plan["weight"][plan["weight"] > 0]
    assert -(w * w.map(math.log)).sum() == pytest.approx(1.0, abs=1e-6) and w.sum() == pytest.approx(1)
    made = mixing.mix(df, target_entropy=1.0, max_epochs=None, budget=100.0)
    assert made.columns == [*df.columns, "mix_pass"]
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("source = 'empty'")).count() == 2


def test_mix_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert Counter((r[0], r[1]) for r in queries.op5_mixing(spark, sf).collect()) == mixed(rows, 2.0)


def call(i, name="reply", after=(), **arguments):
    return {"id": i, "name": name, "arguments": json.dumps(arguments), "after": list(after)}


TURNS = [
    (1, 0, "user", "hi \"q\" \n"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (None, 1, "user", "x"), (4, 1, None, "x"), (4, 0, "user", "again"), (4, 0, "user", "again"),
    (9, 0, "user", "use tools"),
    (9, 1, "assistant", json.dumps({"tool_calls": [call("a", turn=1, text="é"), call("b", after=["a"], text=5, turn=1), call("c", after=["b", "a"], text="x", turn=2), call("d", after=["e"], text="x", turn=1), call("e", after=["d"], text="x", turn=1), call("f", name="unknown", text="x", turn=1), call("g", after=["nowhere"], turn=3, text="t", more=1)]})),
    (9, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})), (9, 3, "tool", json.dumps({"tool_call_id": "a", "content": "rb"})), (9, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})), (9, 5, "tool", '{"tool_call_id": broken'),
]


def test_calls_are_linked_ordered_validated_and_canonical(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, status int")
    got = {r["call_id"]: r for r in toolcalls.format_calls(df).collect()}
    status = {k: (r["status"], r["level"]) for k, r in got.items()}
    assert status == {
        "call_1_0": ("ok", 0), "call_1_2": ("no_result", 1), "call_2_0": ("no_result", 0), "call_4_0": ("duplicate", 0), "a": ("ok", 0), "b": ("invalid", 1), "c": ("no_result", 2),
        "d": ("cyclic", None), "e": ("cyclic", None), "f": ("invalid", 0), "g": ("invalid", 0), "zz": ("orphan", None),
    }
    assert got["a"]["n_results"] == 2
    assert got["a"]["message"] == '{"arguments":{"text":"é","turn":1},"id":"a","name":"reply","result":"ra"}'
    assert json.loads(got["call_1_0"]["message"]) == {"arguments": {"text": 'hi "q" \n', "turn": 0}, "id": "call_1_0", "name": "reply", "result": "yo"}
    assert json.loads(got["call_1_2"]["message"])["arguments"] == {"after": "call_1_0", "text": "", "turn": 2}
    assert toolcalls.format_calls(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_row", [0, 70])
def test_long_chains_ladders_and_circles_get_their_levels(spark, monkeypatch, in_row):
    """By halved paths, by arrays, and some of both."""
    monkeypatch.setattr(toolcalls, "IN_ROW", in_row)
    rng = random.Random(3)
    cases = [
        (500, [(i, i - 1) for i in range(1, 500)]), (60, [(i, j) for i in range(1, 60) for j in rng.sample(range(i), min(i, 2))]), (7, [(i, (i - 1) % 3) for i in range(7)]), (30, [(i, rng.randrange(30)) for i in range(30) if i % 3]),
        (100, [(i, i - 1) for i in range(1, 100)] + [(i, i - 3) for i in range(3, 100, 3)]), (6, [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (5, 0), (4, 4)]),
    ]
    want = {}
    for c, (n, pairs) in enumerate(cases):
        placed, before = {}, {i: {u for v, u in pairs if v == i} for i in range(n)}
        while new := [i for i in range(n) if i not in placed and before[i] <= placed.keys()]:
            placed |= {i: max((placed[u] + 1 for u in before[i]), default=0) for i in new}
        want |= {(c, f"c{i}"): placed.get(i) for i in range(n)}
    ids = spark.createDataFrame(list(want), "conv_id long, call_id string")
    edges = spark.createDataFrame([(c, f"c{v}", f"c{u}") for c, (_, pairs) in enumerate(cases) for v, u in pairs], "conv_id long, call_id string, before string")
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in toolcalls.levels(ids, edges).collect()} == want


def test_calls_behind_two_predecessors_each_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(toolcalls, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    ids = spark.createDataFrame([(c, f"c{i}") for c in range(3) for i in range(500)], "conv_id long, call_id string")
    edges = spark.createDataFrame([(c, f"c{i}", f"c{i - d}") for c in range(3) for i in range(1, 500) for d in (1, 2) if i >= d], "conv_id long, call_id string, before string")
    assert {(r["conv_id"], r["call_id"], r["level"]) for r in toolcalls.levels(ids, edges).collect()} == {(c, f"c{i}", i) for c in range(3) for i in range(500)}
    assert written == ["calledges"]


def test_functions_that_a_conversation_declares(spark):
    weather = {"name": "weather", "parameters": {"type": "object", "properties": {"place": {"type": "string"}, "days": {"type": "integer"}, "units": {"type": "string", "enum": ["c", "f"]}, "at": {"type": ["number", "null"]}, "tags": {"type": "array"}, "more": {"type": "object"}, "share": {"type": "number"}, "exact": {"type": "boolean"}}, "required": ["place", "days"]}}
    tools = json.dumps({"tools": [{"type": "function", "function": weather}, {"name": "now"}, {"name": "reply", "parameters": {"properties": {"x": True}}}, {"parameters": {}}, 7, None, {"name": ["x"]}]})
    given = {
        "ok": dict(place="p", days=1), "all": dict(place="p", days=1, units="c", at=None, tags=[1], more={"a": {"b": 1}}, share=0.5, exact=True), "whole": dict(place="p", days=1, share=2), "missing": dict(place="p"), "wrong": dict(place="p", days="1"), "other": dict(place="p", days=1, hour=3),
        "null": dict(place=None, days=1), "list": dict(place="p", days=1, tags={}), "nested": dict(place="p", days=1, more=[1]), "truth": dict(place="p", days=1, exact="true"),
    }
    calls = [call(k, name="weather", **v) for k, v in given.items()] + [call("none", name="now"), call("some", name="now", x=1), call("own", name="reply", x=[1]), call("fixed", name="reply", text="t", turn=1), call("unknown", name="nothing"), {"id": "broken", "name": "now", "arguments": "[1"}, {"id": "array", "name": "now", "arguments": "[1]"}, {"id": "nameless", "arguments": "{}"}, {"id": "empty", "name": "now"}, {"id": "under", "type": "function", "function": {"name": "weather", "arguments": '{"days": 2, "place": "q"}'}}]
    said = json.dumps({"tool_calls": [*calls, 5, {"name": "no id"}]})
    turns = [(1, 0, "system", tools), (1, 1, "assistant", said), (1, 2, "system", json.dumps({"tools": [{"name": "weather"}]})), (2, 0, "system", 'no "tools" {'), (2, 1, "assistant", said), (3, 0, "system", '{"tools": 5}'), (None, 0, "system", tools), (4, 0, "system", None)]
    rows = toolcalls.format_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    good = lambda c: {r["call_id"] for r in rows if r["conv_id"] == c and r["status"] == "no_result"}
    assert len(rows) == 2 * len(calls) and {r["status"] for r in rows} == {"no_result", "invalid"}
    assert good(1) == {"ok", "all", "whole", "none", "own", "under"} and good(2) == {"fixed"}


def test_call_ids_hold_within_a_conversation(spark):
    asks = lambda c, text, after=(): (c, 0, "assistant", json.dumps({"tool_calls": [call("call_1", turn=0, text=text), call("call_2", after=after, turn=0, text=text)]}))
    says = lambda c, t, i, text: (c, t, "tool", json.dumps({"tool_call_id": i, "content": text}))
    turns = [asks(1, "x", ["call_1"]), asks(2, "y"), says(1, 5, "call_1", "one"), says(2, 1, "call_1", "two"), says(2, 2, "call_2", "three"), says(3, 0, "call_2", "stray")]
    made = toolcalls.format_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["call_id"]): (r["status"], r["level"], json.loads(r["message"])["result"]) for r in made}
    assert len(made) == len(got) and got == {
        (1, "call_1"): ("ok", 0, "one"), (1, "call_2"): ("no_result", 1, None), (2, "call_1"): ("ok", 0, "two"), (2, "call_2"): ("ok", 0, "three"), (3, "call_2"): ("orphan", None, "stray"),
    }


def test_calls_query_matches_brute_force(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    texts = {(c, t): (r, x) for c, t, r, x in turns}
    first = {}
    for c, t, r, _ in turns:
        if r == "user":
            first[c] = min(t, first.get(c, t))
    want = {}
    for c, t, r, x in turns:
        if r == "user":
            reply = texts.get((c, t + 1), (None, None))
            args = {"text": x, "turn": t} | ({"after": f"call_{c}_{first[c]}"} if t > first[c] else {})
            message = {"arguments": args, "id": f"call_{c}_{t}", "name": "reply", "result": reply[1] if reply[0] == "assistant" else None}
            want[f"call_{c}_{t}"] = (int(t > first[c]), json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    got = {r["call_id"]: (r["level"], r["message"]) for r in queries.op6_toolcalls(spark, sf).collect()}
    assert got == want


def test_pipeline_matches_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if scores[r["doc_id"]] < toxicity.THRESHOLD]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for d, t, _ in rows:
        least[norm(t)] = min(d, least.get(norm(t), d))
    rows = [r for r in rows if least[norm(r[1])] == r[0]]
    label = similar_classes([r[:2] for r in rows])
    rows = [r for i, r in enumerate(rows) if r[0] == min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])]
    want = mixed(rows, corpus_pipeline.MAX_EPOCHS)
    made = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["source"]) for r in made) == want
    sp = pieces.processor(queries.tokenizer_file())
    texts = {d: t or "" for d, t, _ in rows}
    for r in made:
        assert r["ids"] == sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(r["ids"]).encode()).hexdigest()


def test_pipeline_stages_take_odd_tables(spark, sf):
    df = spark.createDataFrame([(1, "a  b c", "en", "s", 1, "k"), (2, "a b c", None, None, None, None), (None, None, "x", "s", 0, "k"), (1, "a  b c", "en", "s", 1, "k"), (3, "word " * 30000, "en", "t", 9, "z")], "doc_id long, text string, lang string, source string, n_chars long, __digest string")
    for name in ("__own", "__sha", "passes", "last_place", "score", "fp", "component_id", "id", "ids", "place", "n"):
        df = df.withColumn(name, F.lit(7))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            assert name == "sentencepiece" or out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in exact.keep_first(df).collect()) == ["1", "3", "None"]
