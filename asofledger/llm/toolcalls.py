"""Chat formatting by tool-call linking, with DataFrame functions only.

Method. Calls and results are found in a table of turns: an assistant turn that is JSON with tool_calls (id, after: ids that must come first, and, bare or under function, name and arguments), and a tool turn that is JSON with
tool_call_id and content. In a conversation without such turns each user turn is a call of the function reply, whose identifier comes from its conversation and turn, the assistant turn that follows it is its result, and it comes after the
conversation's first call. An identifier holds within its conversation only: two conversations may both have a call_1. Calls and results are brought to one row per conversation and identifier and hash-joined; arguments are parsed as variants and validated against schemas: those that the
conversation itself declares (a system turn that is JSON with tools: name and parameters as JSON Schema writes them, properties with a type each and required names, bare or under function too), and SCHEMAS for functions that it does not. Calls get topological levels; and a call with its result is serialised as canonical JSON (sorted keys, no white space).

Levels. A conversation of up to IN_ROW links is one array, whose levels rise until they stay. In longer ones the paths between calls are halved in joins by conversation and identifier, so a long conversation never meets in one task. There rounds grow with the logarithm of a chain whose calls have one
predecessor each; where calls have several, each of these waits for them, so rounds are as many as such calls stand one behind the other.

Cases. Status is the first that holds: orphan (a result without a call in its conversation), duplicate (an identifier of several calls of a conversation; the first turn's counts), cyclic, invalid (arguments that are no JSON object or fail their schema, or a function without one), no_result, ok. Null text is an
empty turn; null conversations, turns and roles make no calls. Predecessors that don't exist are left out. Repeated rows make a duplicate. Of several declarations of a function in a conversation the first turn's counts; a declared type that is not in TYPES takes any value, and what is no such JSON declares nothing. A broken member of a list spoils no other one. Empty tables give empty ones; columns besides conv_id, turn, role and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Functions and their arguments: name -> {argument: type}, a type being one of TYPES with ? if it may be missing.
SCHEMAS = {"reply": {"after": "string?", "text": "string", "turn": "integer"}}
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "array": "ARRAY.*", "object": "OBJECT.*"}

_CALL = "struct<id:string,name:string,arguments:string,after:array<string>,function:struct<name:string,arguments:string>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_PARAMETERS = "struct<properties:map<string,string>,required:array<string>>"
_TOOL = f"struct<name:string,parameters:{_PARAMETERS},function:struct<name:string,parameters:{_PARAMETERS}>>"
#: What identifies a call.
CALL = ["conv_id", "call_id"]
#: Links of a conversation whose levels are found within a row: passes are its calls at most, so some 2 million steps.
IN_ROW = 1024


def _known(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null and role is not null")


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))


def _members(text: str, name: str, schema: str) -> Column:
    """Members of a list in JSON text, a row each, parsed one by one: a broken one is null and spoils no other."""
    return F.explode(F.transform(F.from_json(text, f"struct<{name}:array<string>>")[name], lambda x: F.from_json(x, schema)))


def extract(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls (call_id, conv_id, turn, name, arguments JSON, after array) and results (call_id, conv_id, turn, content)."""
    turns = _known(turns)
    parsed = turns.where((F.col("role") == "assistant") & F.col("text").contains('"tool_calls"')).select("conv_id", "turn", _members("text", "tool_calls", _CALL).alias("c"))
    written = parsed.where("c.id is not null").select(F.col("c.id").alias("call_id"), "conv_id", "turn", F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    given = turns.where((F.col("role") == "tool") & F.col("text").contains('"tool_call_id"')).select("conv_id", "turn", F.from_json("text", _RESULT).alias("r"))
    answers = given.where("r.tool_call_id is not null").select(F.col("r.tool_call_id").alias("call_id"), "conv_id", "turn", F.col("r.content").alias("content"))

    using = turns.groupBy("conv_id").agg(F.max((F.col("text").contains('"tool_calls"') & (F.col("role") == "assistant")) | (F.col("role") == "tool")).alias("tools"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    plain = using.where("not tools and first is not null").select("conv_id", "first")
    asked = turns.where("role = 'user'").join(plain, "conv_id")
    later = F.col("turn") > F.col("first")
    arguments = F.to_json(F.struct(F.when(later, _call_id(F.col("first"))).alias("after"), "text", "turn"))
    replies = asked.select(_call_id(F.col("turn")).alias("call_id"), "conv_id", "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(later, F.array(_call_id(F.col("first")))).otherwise(F.array().cast("array<string>")).alias("after"))
    answered = turns.where("role = 'assistant'").join(plain, "conv_id").select(_call_id(F.col("turn") - 1).alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    answered = answered.join(replies.select(*CALL).distinct(), CALL, "left_semi")  # an assistant turn after no user turn is no result
    return written.unionByName(replies), answers.unionByName(answered)


def declared(turns: DataFrame) -> DataFrame:
    """Functions that conversations declare (conv_id, name, fields): fields maps each argument to its type, with ? if it may be missing."""
    told = _known(turns).where((F.col("role") == "system") & F.col("text").contains('"tools"')).select("conv_id", "turn", _members("text", "tools", _TOOL).alias("t"))
    told = told.select("conv_id", "turn", F.coalesce("t.name", "t.function.name").alias("name"), F.when(F.col("t.name").isNotNull(), F.col("t.parameters")).otherwise(F.col("t.function.parameters")).alias("p")).where("name is not null")
    optional = lambda k: ~F.array_contains(F.coalesce(F.col("p.required"), F.array().cast("array<string>")), k)
    properties = F.coalesce(F.col("p.properties"), F.from_json(F.lit("{}"), "map<string,string>"))
    fields = F.transform_values(properties, lambda k, v: F.concat(F.coalesce(F.get_json_object(v, "$.type"), F.lit("any")), F.when(optional(k), "?").otherwise("")))
    return told.select("conv_id", "name", "turn", fields.alias("fields")).groupBy("conv_id", "name").agg(F.min_by("fields", F.struct("turn", F.to_json("fields"))).alias("fields"))


def _levels_in_rows(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that have predecessors, by an array per conversation: each pass sets a call one above the largest level before it, starting from 1, until nothing changes. A call on or behind a cycle rises in every pass and alone gets beyond the number of calls: its level is null."""
    calls = edges.groupBy(*CALL).agg(F.collect_set("before").alias("befores"))
    nodes = calls.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "befores"))).alias("nodes"))
    found = nodes.select("conv_id", "nodes.call_id", F.expr("transform(nodes, n -> transform(n.befores, b -> cast(array_position(nodes.call_id, b) as int)))").alias("places"))
    risen = F.expr("""aggregate(sequence(1, size(places)), named_struct('now', array_repeat(1L, size(places)), 'was', cast(null as array<bigint>)),
        (s, k) -> if(s.now <=> s.was, s, named_struct('now', transform(places, p -> 1L + array_max(transform(p, i -> coalesce(get(s.now, i - 1), 0L)))), 'was', s.now)), s -> s.now)""")
    each = found.select("conv_id", F.explode(F.arrays_zip("call_id", risen.alias("level"))).alias("x"), F.size("call_id").alias("most"))
    return each.select("conv_id", "x.call_id", F.when(F.col("x.level") <= F.col("most"), F.col("x.level")).alias("level"))


def _levels_by_halving(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that have predecessors. sizes: conv_id, most (its calls).

    A row (call, before, w) says that a path of w steps leads from before to the call, and one without before that the call's level is w at least. In each round
    a row whose `before` is settled (it has no such rows, so its level is 0, or bounds only) becomes such a bound, and one whose `before` has a single predecessor leaps over it; rows to the same call are brought to the longest. So a chain of n calls takes
    log2(n) rounds, and so do ladders of parallel chains; where a call has several predecessors, those behind it wait until it is settled, a round for each such call on the longest path. A path as long as its conversation has calls runs in a circle: it stays as a row from the call to itself.
    """
    ahead = ["conv_id", "before"]
    rows = materialize(edges.select(*CALL, "before", F.lit(1).cast("long").alias("w")).join(sizes, "conv_id"), "callpaths")
    seen = None
    while True:
        open_rows = F.col("before").isNotNull() & (F.col("before") != F.col("call_id"))
        now = tuple(rows.agg(F.count_if(open_rows), F.bit_xor(F.xxhash64(*CALL, "before", "w"))).first())
        if not now[0] or now == seen:
            break
        seen = now
        calls = rows.groupBy(*CALL).agg(
            F.coalesce(F.max(F.when(F.col("before").isNull(), F.col("w"))), F.lit(0)).alias("base"), F.count("before").alias("n"), F.max(F.when(F.col("before").isNotNull(), F.struct("before", "w"))).alias("only")
        )
        calls = materialize(calls.select("conv_id", F.col("call_id").alias("before"), "base", "n", "only"), "callnodes")
        met = rows.where("before is not null").join(calls, ahead, "left").withColumns({"base": F.coalesce("base", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
        bound = F.struct(F.lit(None).cast("string").alias("before"), (F.col("w") + F.col("base")).alias("w"))
        leap = F.when(F.col("n") == 1, F.struct(F.col("only.before").alias("before"), (F.col("w") + F.col("only.w")).alias("w"))).otherwise(F.struct("before", "w"))
        moved = met.select(*CALL, "most", F.explode(F.when(F.col("n") == 0, F.array(bound)).otherwise(F.array(bound, leap))).alias("x"))
        circles = (F.col("x.before").isNotNull()) & (F.col("x.w") >= F.col("most"))
        moved = moved.select(*CALL, F.when(circles, F.col("call_id")).otherwise(F.col("x.before")).alias("before"), F.least("x.w", "most").alias("w"), "most")
        after = rows.where("before is null").unionByName(moved.select(*rows.columns)).groupBy(*CALL, "before").agg(F.max("w").alias("w"), F.max("most").alias("most"))
        after = materialize(after, "callpaths")
        discard(rows)
        discard(calls)
        rows = after
    return rows.groupBy(*CALL).agg(F.when(F.count("before") == 0, F.max("w")).alias("level"))


def levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """ids (conv_id, call_id) with level: 0 without predecessors, else one more than the largest of them; null on or behind a cycle. edges: conv_id, call_id, before."""
    edges = edges.join(ids.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi").join(ids, CALL, "left_semi").select(*CALL, "before").distinct()
    edges = materialize(edges, "calledges")
    links = edges.groupBy("conv_id").agg(F.count("*").alias("links"))
    long = links.where(F.col("links") > IN_ROW).select("conv_id")
    made = _levels_in_rows(edges.join(links.where(F.col("links") <= IN_ROW), "conv_id", "left_semi"))
    if not long.isEmpty():
        sizes = ids.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("most"))
        made = made.unionByName(_levels_by_halving(edges.join(long, "conv_id", "left_semi"), sizes))
    made = made.withColumn("behind", F.lit(True))
    return ids.join(made, CALL, "left").select(*CALL, F.when(F.col("behind"), F.col("level")).otherwise(F.lit(0)).alias("level"))


def _right_type(value: Column, kind: Column) -> Column:
    """Whether a variant has a schema's type; any variant has a type that is not in TYPES."""
    seen = F.schema_of_variant(value)
    return F.coalesce(*[F.when(kind == t, seen.rlike(f"^(?:{pattern})$")) for t, pattern in TYPES.items()], F.lit(True))


def valid(value: Column, fields: Column) -> Column:
    """Whether a variant is an object that has each argument of fields (name to type) in the right type, except for missing ones that may be, and no other argument. False without fields."""
    given = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    known = F.forall(given, lambda e: F.coalesce(_right_type(e["value"], F.rtrim(F.element_at(fields, e["key"]), F.lit("?"))) & F.map_contains_key(fields, e["key"]), F.lit(False)))
    names = F.transform(given, lambda e: e["key"])
    whole = F.forall(F.map_entries(fields), lambda f: f["value"].endswith("?") | F.array_contains(names, f["key"]))
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT") & known & whole, F.lit(False))


def _held(schemas: dict[str, dict[str, str]], name: Column) -> Column:
    """The fields of a function of schemas, null for another."""
    found = F.lit(None).cast("map<string,string>")
    for function, fields in schemas.items():
        found = F.when(name == function, F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]).cast("map<string,string>") if fields else F.from_json(F.lit("{}"), "map<string,string>")).otherwise(found)
    return found


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS, own: DataFrame | None = None) -> DataFrame:
    """One row per conversation and identifier: call_id, conv_id, turn, name, level, status, n_results, message (canonical JSON). own: functions that conversations declare, as declared() gives them."""
    calls = materialize(calls, "calls")
    first = calls.groupBy(*CALL).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    answers = results.groupBy(*CALL).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    placed = levels(calls.select(*CALL).distinct(), calls.select(*CALL, F.explode("after").alias("before")))
    value = F.try_parse_json("c.arguments")
    if own is None:
        first = first.withColumn("fields", _held(schemas, F.col("c.name")))
    else:
        first = first.withColumn("name", F.col("c.name")).join(own, ["conv_id", "name"], "left").withColumn("fields", F.coalesce("fields", _held(schemas, F.col("name")))).drop("name")
    rows = first.join(placed, CALL, "left").join(answers, CALL, "full_outer").select(
        "call_id", "conv_id", F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), "fields", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("r.content").alias("content"), value.alias("value"),
    )
    status = F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_calls") > 1, "duplicate").when(F.col("level").isNull(), "cyclic").when(~valid(F.col("value"), F.col("fields")), "invalid").when(F.col("n_results") == 0, "no_result").otherwise("ok")
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    message = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("value"), F.lit("null")), F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("content")), F.lit("}"))
    return rows.select("call_id", "conv_id", "turn", "name", F.col("level").cast("int").alias("level"), status.alias("status"), "n_results", message.alias("message"))


def format_calls(turns: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """link() over the calls and results of a table of turns (conv_id, turn, role, text)."""
    return link(*extract(turns), schemas, declared(turns))
