"""Linking tool calls of conversations with their results. Spark expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import written

#: A schema of one tool: field -> {"type", "required", "max_length", "minimum", "maximum", "enum"}; only "type" must be there.
Schemas = dict[str, dict[str, dict]]

_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string>>"
_RESULT = "tool_call_id string, content string"
_REFERENCE = r'"\$([A-Za-z0-9_.:-]+)"(?!:)'


def _field_errors(arguments: Column, field: str, rule: dict) -> list[Column]:
    """Null or a message for each rule of one field."""
    value = F.variant_get(arguments, f"$['{field}']", "variant")
    kind = F.schema_of_variant(value)
    of_type = {
        "string": kind == "STRING", "integer": kind == "BIGINT", "number": (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
        "boolean": kind == "BOOLEAN", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }[rule["type"]]
    here = value.isNotNull()
    out = [F.when(here & ~of_type, F.lit(f"type:{field}"))]
    if rule.get("required"):
        out.append(F.when(~here, F.lit(f"missing:{field}")))
    fits = here & of_type
    text, number = F.try_variant_get(arguments, f"$['{field}']", "string"), F.try_variant_get(arguments, f"$['{field}']", "double")
    if "max_length" in rule:
        out.append(F.when(fits & (F.length(text) > rule["max_length"]), F.lit(f"length:{field}")))
    if "minimum" in rule:
        out.append(F.when(fits & (number < rule["minimum"]), F.lit(f"minimum:{field}")))
    if "maximum" in rule:
        out.append(F.when(fits & (number > rule["maximum"]), F.lit(f"maximum:{field}")))
    if "enum" in rule:
        out.append(F.when(fits & ~text.isin(*rule["enum"]), F.lit(f"enum:{field}")))
    return out


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what breaks the schema of the tool; arguments are a variant, null where they are no JSON."""
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    checks = F.lit(None).cast("array<string>")
    for tool in sorted(schemas, reverse=True):
        known = [F.lit(f) for f in schemas[tool]]
        extra = F.transform(F.array_except(keys, F.array(*known)) if known else keys, lambda k: F.concat(F.lit("unknown:"), k))
        listed = F.array_compact(F.array(F.lit(None).cast("string"), *[e for field, rule in schemas[tool].items() for e in _field_errors(arguments, field, rule)]))
        checks = F.when(name == tool, F.sort_array(F.concat(extra, listed))).otherwise(checks)
    whole = F.coalesce(checks, F.array(F.lit("tool")))
    return F.when(arguments.isNull(), F.array(F.lit("json"))).when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.array(F.lit("object"))).otherwise(whole)


_ENDLESS = 1 << 60


def _levels(edges: DataFrame) -> DataFrame:
    """conv, call_id, level of every call with dependencies: one more than the largest level among them, null for cycles and what needs them.

    `edges` has conv, call_id, dep and the turn and pos of dep; a dep without edges of its own has level 0. Every call points
    to one dependency, and pointers are doubled until they reach a call without any, which takes rounds in the logarithm of
    the longest chain. Then each call looks whether another dependency lies deeper than the one it points to; if so it points
    there and the pointers run again. Pointers that never arrive stand on a cycle, deeper than anything else.
    """
    edges = written(edges, "edges")
    policy = edges.groupBy("conv", "call_id").agg(F.max(F.struct("turn", "pos", "dep"))["dep"].alias("ptr"))
    policy = written(policy, "policy")
    widest = policy.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while True:
        state = policy.select("conv", "call_id", "ptr", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done"))
        for _ in range(widest.bit_length() + 1):
            further = state.select("conv", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"))
            doubled = state.join(further, ["conv", "ptr"], "left").select("conv", "call_id", F.coalesce("next", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNull().alias("done"))
            state = written(doubled, "state")
            if state.filter(~F.col("done")).isEmpty():
                break
        depth = state.select("conv", "call_id", F.when(F.col("done"), F.col("dist")).alias("level"))
        of_dep = depth.select("conv", F.col("call_id").alias("dep"), F.coalesce("level", F.lit(_ENDLESS)).alias("below"))
        deepest = edges.join(of_dep, ["conv", "dep"], "left").groupBy("conv", "call_id").agg(F.max(F.struct(F.coalesce("below", F.lit(0)).alias("below"), "turn", "pos", "dep")).alias("best"))
        looked = written(deepest.join(depth, ["conv", "call_id"]).select("conv", "call_id", "level", F.col("best.dep").alias("ptr"), (F.col("best.below") >= F.coalesce("level", F.lit(2 * _ENDLESS))).alias("deeper")), "looked")
        if looked.filter("deeper").isEmpty():
            return looked.select("conv", "call_id", F.col("level").cast("int").alias("level"), F.lit(True).alias("waits"))
        policy = looked.select("conv", "call_id", "ptr")


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: its result, place in a topological order, schema errors and canonical JSON.

    `messages` has conv_id, turn, role, text. An assistant's text is a JSON object with tool_calls (id, name, arguments), a
    tool's text one with tool_call_id and content; other texts are ordinary turns. Calls meet results in a hash join by
    conversation and identifier. A string "$id" in the arguments depends on the call of that id; within a conversation, order
    by level, turn, pos is topological. Columns: conv_id, call_id, name, turn, pos, level, n_calls, n_results, status, errors,
    canonical. Canonical JSON has sorted keys at every depth and no blanks.

    status: no_id (calls without identifier, one row per conversation), orphan (result without call), cycle (level null),
    no_result, invalid, ok. errors: type, missing, length, minimum, maximum, enum, unknown (field), ref (unknown identifier),
    json, object, tool. A repeated identifier: the first by turn and pos counts, n_calls tells how many; results likewise by turn
    and content, so repeated rows change the counts only. Null conv_id: one conversation of its own. Null or empty text, null
    role: ordinary turns. Empty table: empty result. Other columns are not read. Very long texts: whole.
    """
    base = messages.select(F.col("conv_id").cast("long"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long"), "role", F.col("text").cast("string"))
    assistant = base.filter((F.col("role") == "assistant") & F.ltrim("text").startswith("{"))
    call = assistant.select("conv_id", "conv", "turn", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("pos", "c")).filter(F.col("c").isNotNull())
    first = call.groupBy("conv", F.col("c.id").alias("call_id")).agg(F.min("conv_id").alias("conv_id"), F.min(F.struct("turn", "pos", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    calls = written(first.select("conv_id", "conv", "call_id", "c.*", "n_calls"), "calls")

    tool = base.filter((F.col("role") == "tool") & F.ltrim("text").startswith("{")).select("conv_id", "conv", "turn", F.from_json("text", _RESULT).alias("r")).filter(F.col("r.tool_call_id").isNotNull())
    results = tool.groupBy(F.col("conv").alias("r_conv"), F.col("r.tool_call_id").alias("r_id")).agg(F.min("conv_id").alias("r_conv_id"), F.min(F.struct("turn", F.col("r.content").alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results"))

    parsed = F.try_parse_json("arguments")
    refs = calls.filter(F.col("call_id").isNotNull()).select("conv", "call_id", F.explode(F.array_distinct(F.regexp_extract_all(F.to_json(parsed), F.lit(_REFERENCE), F.lit(1)))).alias("dep"))
    known = calls.filter(F.col("call_id").isNotNull()).select("conv", F.col("call_id").alias("dep"), "turn", "pos", F.lit(True).alias("known"))
    refs = written(refs.join(known, ["conv", "dep"], "left"), "refs")
    levels = _levels(refs.filter("known").select("conv", "call_id", "dep", "turn", "pos"))
    unknown = refs.filter("known is null").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("ref:"), "dep"))).alias("unknown"))

    placed = calls.join(levels, ["conv", "call_id"], "left").withColumn("level", F.when(F.col("waits").isNull() & F.col("call_id").isNotNull(), 0).otherwise(F.col("level"))).join(unknown, ["conv", "call_id"], "left")
    linked = placed.join(results.hint("shuffle_hash"), (placed["conv"] == results["r_conv"]) & (placed["call_id"] == results["r_id"]), "full_outer")
    is_call = F.col("n_calls").isNotNull()
    errors = F.when(is_call, F.concat(argument_errors(F.col("name"), parsed, schemas), F.coalesce("unknown", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    out = linked.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("r_conv_id")).alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"), "name", F.coalesce("turn", "r.turn").alias("turn"), "pos", "level",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), errors.alias("errors"), parsed.alias("parsed"), F.col("r.content").alias("result"))
    status = (
        F.when(F.col("n_calls") == 0, "orphan").when(F.col("call_id").isNull(), "no_id").when(F.col("level").isNull(), "cycle")
        .when(F.col("n_results") == 0, "no_result").when(F.size("errors") > 0, "invalid").otherwise("ok"))
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", "result"))
    return out.select("conv_id", "call_id", "name", "turn", "pos", "level", "n_calls", "n_results", status.alias("status"), "errors", canonical.alias("canonical"))


# ---- transcripts with calls, derived from plain conversations ----

#: Tools of the derived transcripts.
SCHEMAS: Schemas = {
    "configure": {"prompt": {"type": "string", "required": True}},
    "lookup": {
        "query": {"type": "string", "required": True, "max_length": 400}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 60},
        "after": {"type": "array", "required": True},
    },
}


def tool_transcript(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a transcript in which every user turn asks a tool and the answer is the tool's result.

    A system turn becomes a call of `configure`, a user turn one of `lookup` with its whole text, its number of words and
    references to the calls of the two turns before it where those were made; the turn after a user's becomes the result.
    Only neighbouring turns are compared, through joins on conversation and turn.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    asking = turns.filter(F.col("role").isin("system", "user"))
    earlier = asking.select(F.col("conv_id").alias("e_conv"), F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("e_turn"), name(F.col("turn")).alias("e_name")).distinct()
    earlier = earlier.groupBy("e_conv", "e_turn").agg(F.sort_array(F.collect_set(F.concat(F.lit("$"), "e_name"))).alias("after"))
    joined = asking.join(earlier, (F.col("conv_id") == F.col("e_conv")) & (F.col("turn") == F.col("e_turn")), "left")
    lookup = F.to_json(F.struct(F.col("text").alias("query"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(lookup)
    tool = F.when(F.col("role") == "system", "configure").otherwise("lookup")
    calls = joined.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), tool.alias("name"), arguments.alias("arguments"))).alias("tool_calls"))).alias("text"))
    answers = turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))).alias("text"))
    return calls.unionByName(answers)
