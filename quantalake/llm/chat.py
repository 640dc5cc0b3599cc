"""Chat formatting with tool calls: linked to results, ordered, validated, and written as canonical JSON.

Calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids of the conversation).
Results: conv_id, turn, call_id, content. Calls and results meet by a hash join on (conv_id, call_id).
"""

from __future__ import annotations

import json
import math
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import release, stored

#: The types of JSON Schema and the Python types that they allow (booleans aren't numbers).
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, characters as they are; whole floats are written as integers."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(value: Any) -> Any:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return int(value)
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def parsed(text: str | None) -> Any:
    """The value of strict JSON text; ``...`` if it isn't any. A repeated key, NaN, a number beyond doubles, half of a
    surrogate pair and nesting beyond the interpreter's limit aren't."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(_: str) -> None:
        raise ValueError("not a number")

    def finite(digits: str) -> float:
        if math.isinf(value := float(digits)):
            raise ValueError("too large")
        return value

    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse, parse_float=finite)
        canonical(value).encode()
        return value
    except (TypeError, ValueError, RecursionError):
        return ...


#: The keywords of JSON Schema that ``fault`` knows, and those that say nothing about a value.
KEYWORDS = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"}
REMARKS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema: dict, at: str = "$") -> None:
    """An error for a keyword that ``fault`` doesn't know, a type that there isn't, or a schema that isn't an object."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    if unknown := sorted(set(schema) - KEYWORDS - REMARKS):
        raise ValueError(f"{at}: unknown keywords {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if wrong := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in TYPES]:
        raise ValueError(f"{at}: unknown type {wrong[0]}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    for k, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def fault(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema``: type, enum, required, properties, additionalProperties
    (boolean), items, minimum, maximum, minLength, maxLength, minItems, maxItems. None if it holds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds is not None and not any(_is(value, k) for k in kinds):
        return f"{at}: not of type {'|'.join(kinds)}"
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}: {k} is missing"
        for k in sorted(value):
            if k in known:
                if said := fault(value[k], known[k], f"{at}.{k}"):
                    return said
            elif schema.get("additionalProperties") is False:
                return f"{at}: {k} is unknown"
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    limits = [("minimum", value, 1), ("maximum", value, -1)] if number else []
    if isinstance(value, str):
        limits = [("minLength", len(value), 1), ("maxLength", len(value), -1)]
    if isinstance(value, list):
        limits = [("minItems", len(value), 1), ("maxItems", len(value), -1)]
    for k, own, sign in limits:
        if k in schema and sign * own < sign * schema[k]:
            return f"{at}: {k}"
    if isinstance(value, list) and "items" in schema:
        for n, x in enumerate(value):
            if said := fault(x, schema["items"], f"{at}[{n}]"):
                return said
    return None


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES[kind])


def _order(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level: 0 without known dependencies, else one more than the highest of them; null in a
    cycle or after one.

    Calls with one known dependency form chains. Each looks for its anchor, the first call on its chain that has none
    or several, by doubling its steps: as many rounds as the longest chain's length has binary digits. Only calls with
    several dependencies are then worked in rounds, one a level of them.
    """
    own = calls.groupBy("conv_id", "call_id").agg(F.flatten(F.collect_set(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("depends_on"))
    own = stored(own, "calls")
    needs = own.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    needs = stored(needs.join(own.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]), "needs")
    count = needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("needs").alias("up"))
    nodes = own.select("conv_id", "call_id").join(count, ["conv_id", "call_id"], "left")
    one, several = F.coalesce(F.col("n") == 1, F.lit(False)), F.coalesce(F.col("n") > 1, F.lit(False))
    # ``steps`` up, at ``up``; ``found``: that is the anchor
    state = nodes.select("conv_id", "call_id", F.when(one, F.col("up")).otherwise(F.col("call_id")).alias("up"), one.cast("long").alias("steps"), (~one).alias("found"), several.alias("several"))
    state = stored(state, "chains")
    columns, anchored = state.columns, state.where("found")
    seen, still = anchored, state.where("not found")
    while not still.isEmpty():
        above = seen.unionByName(still).select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("to"), F.col("steps").alias("more"), F.col("found").alias("at"), F.col("several").alias("s"))
        moved = still.select("conv_id", "call_id", "up", "steps").join(above, ["conv_id", "up"])
        moved = stored(moved.select("conv_id", "call_id", F.col("to").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("at").alias("found"), F.col("s").alias("several")).select(*columns), "moved")
        fresh, still = moved.where("found"), moved.where("not found")
        if fresh.isEmpty():  # a path to an anchor has a call at every distance: the rest is in cycles or after them
            break
        anchored = anchored.unionByName(fresh)
        wanted = still.select("conv_id", F.col("up").alias("call_id")).distinct()
        seen = stored(seen.unionByName(fresh).join(wanted, ["conv_id", "call_id"], "left_semi").select(*columns), "seen")
    lost = still.select("conv_id", "call_id", F.lit(None).cast("int").alias("level"))
    level = F.col("steps").cast("int").alias("level")
    forks = anchored.where("several and steps = 0").select("conv_id", "call_id")
    if forks.isEmpty():
        return anchored.select("conv_id", "call_id", level).unionByName(lost)
    # what a call with several dependencies waits for: an anchor, and how far above it the call stands at least
    ends = anchored.select("conv_id", F.col("call_id").alias("needs"), "up", "steps", "several")
    waits = needs.join(forks, ["conv_id", "call_id"], "left_semi").join(ends, ["conv_id", "needs"], "left")
    waits = waits.groupBy("conv_id", "call_id", "up", "several").agg(F.max(F.col("steps") + 1).cast("int").alias("far"))
    waits = stored(waits, "waits")
    known = waits.where("not several").groupBy("conv_id", "call_id").agg(F.max("far").alias("least"))
    rest = stored(forks.join(known, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("least", F.lit(0)).alias("least")), "forks")
    open_waits = waits.where("several or up is null").select("conv_id", "call_id", "up", "far")  # null: never
    done = rest.where("false").select("conv_id", "call_id", F.col("least").alias("level"))
    while True:
        blocked = open_waits.select("conv_id", "call_id").distinct()
        free = stored(rest.join(blocked, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("least").alias("level")), "free")
        if free.isEmpty():
            break
        done = done.unionByName(free)
        met = open_waits.join(free.select("conv_id", F.col("call_id").alias("up"), "level"), ["conv_id", "up"], "left")
        met = stored(met.select("conv_id", "call_id", "up", "far", "level"), "met")
        open_waits = met.where("level is null").drop("level")
        gained = met.where("level is not null").groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("far")).alias("gain"))
        rest = rest.join(free.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(gained, ["conv_id", "call_id"], "left")
        rest = stored(rest.select("conv_id", "call_id", F.greatest("least", "gain").alias("least")), "rest")
    base = done.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
    below = anchored.where("several").join(base, ["conv_id", "up"], "left").select("conv_id", "call_id", (F.col("base") + F.col("steps")).cast("int").alias("level"))
    return anchored.where("not several").select("conv_id", "call_id", level).unionByName(below).unionByName(lost)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with their results, validated and serialised.

    Returns conv_id, turn, call_id, name, result_turn, level, status and json. Within a conversation, (level, turn,
    call_id) is a topological order. status: ``ok``, ``no result``, ``early result`` (it stands before the call),
    ``cycle``, ``bad json``, ``no schema``, or the first fault against the schema. json: the canonical text of
    ``{"arguments", "call_id", "name", "result"}``; arguments that aren't JSON stay text.

    ``schemas``: a JSON Schema a tool name (see ``fault``; an error if it has other keywords); a part of the program,
    not data.

    Defined cases: calls without id or conversation never have a result (``no result``); of several results for one
    identifier the first by turn and content holds; repeated calls each get it; dependencies on unknown calls are
    ignored; null arguments are bad JSON; null content is null; other columns are ignored; either table may be empty.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    c = calls.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("arguments").cast("string"), F.col("depends_on").cast("array<string>"))
    r = results.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("result_turn"), F.col("call_id").cast("string"), F.col("content").cast("string"))
    first = F.min(F.struct("result_turn", F.col("content").isNull().alias("no"), "content"))
    r = stored(r.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(first.alias("r")), "results")
    levels = stored(_order(c.where("conv_id is not null and call_id is not null")), "levels")
    joined = c.drop("depends_on").join(r, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")

    @F.arrow_udf("struct<fault:string,json:string>")
    def judged(name: pa.Array, call_id: pa.Array, arguments: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for tool, ident, text, said in zip(name.to_pylist(), call_id.to_pylist(), arguments.to_pylist(), content.to_pylist(), strict=True):
            value = parsed(text)
            if value is ...:
                wrong = "bad json"
            elif tool not in schemas:
                wrong = "no schema"
            else:
                wrong = fault(value, schemas[tool])
            out.append({"fault": wrong, "json": canonical({"arguments": text if value is ... else value, "call_id": ident, "name": tool, "result": said})})
        release()
        return pa.array(out, pa.struct([("fault", pa.string()), ("json", pa.string())]))

    joined = joined.withColumn("j", judged("name", "call_id", "arguments", "r.content"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    status = (
        F.when(known & F.col("level").isNull(), "cycle")
        .when(F.col("j.fault").isNotNull(), F.col("j.fault"))
        .when(F.col("r").isNull(), "no result")
        .when(F.col("r.result_turn") < F.col("turn"), "early result")
        .otherwise("ok")
    )
    return joined.select("conv_id", "turn", "call_id", "name", F.col("r.result_turn").alias("result_turn"), "level", status.alias("status"), F.col("j.json").alias("json"))


#: What a user turn asks of the assistant, seen as a tool call.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn as a call of the tool ``reply``, which needs the call two turns before, and each assistant turn as
    the result of the turn before it. Roles other than these give no rows."""
    ident = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - n).cast("string"))
    arguments = F.to_json(F.struct(F.col("text"), F.col("turn")))
    calls = turns.where("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(ident(2)).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
