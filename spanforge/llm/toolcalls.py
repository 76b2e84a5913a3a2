"""Operator 10: chat formatting by tool-call linking.

Calls are joined to their results by identifier, ordered topologically, checked
against the schemas of their tools, and written as canonical JSON. The order is
the depth of each call in the chain of calls that it follows, found by pointer
doubling over joins, so that a conversation of any length needs only as many
rounds as its depth has binary digits and never sits in one task.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.storage import materialize

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: The tools that ``calls_of`` derives, as JSON schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 20}, "limit": {"type": "integer", "minimum": 1, "maximum": 8}}},
    "lookup": {"type": "object", "required": ["key"], "properties": {"key": {"type": "string"}, "exact": {"type": "boolean"}}},
    "measure": {"type": "object", "required": ["text", "unit"], "properties": {"text": {"type": "string"}, "unit": {"enum": ["words", "characters"]}}},
}


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks the schema: type, enum, required, properties, items and plain bounds."""
    out = []
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        for k in sorted(set(known) & set(value)):
            out += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, no escapes but the required ones; ValueError for numbers that aren't JSON and lone surrogates."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()  # UnicodeEncodeError is a ValueError
    return text


def parsed(text: str) -> object:
    """The value of a JSON text that has a canonical form, else ValueError, TypeError or RecursionError."""
    value = json.loads(text)
    canonical_json(value)
    return value


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) from (conv_id, call_id, after): 0 for calls that follow none of the conversation, null in cycles."""
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    hops = calls.select("conv_id", "call_id", "after").join(ids, ["conv_id", "after"], "left")
    hops = hops.select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("to"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    hops = materialize(hops, "calls-hops")
    # after as many doublings as the count has digits, what isn't at its end is in a cycle
    for _ in range(max(1, hops.count().bit_length() + 1)):
        if hops.filter("to is not null").isEmpty():
            break
        ahead = hops.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        going, there = hops.filter("to is not null"), hops.filter("to is null")
        going = going.join(ahead, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        hops = materialize(going.unionByName(there), "calls-hops")
    return hops.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """Every call with its result, place, faults and canonical JSON; results without a call as rows of their own.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (a call_id or
    null). results: conv_id, call_id, turn, content. The rows of a conversation
    are in topological order by (depth, turn, call_id).

    status is "ok", or the first that applies of "orphan" (a result without its
    call), "cycle", "bad arguments", "unanswered".

    Defined cases: rows with a null conv_id or call_id are dropped, as nothing
    links them. Calls that share an identifier count once, the earliest, then by
    name and arguments; so do results. A null or malformed argument text, one
    with a lone surrogate or a number that isn't finite, and a tool without a
    schema, are bad arguments; such a text is kept as a string. Null and empty contents are kept
    as such. Other columns are not read. Empty tables give no rows.
    """

    def once(df: DataFrame, *order: str) -> DataFrame:
        rows = df.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        return rows.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("r")).select("conv_id", "call_id", "r.*")

    calls = materialize(once(calls, "turn", "name", "arguments", "after"), "calls")
    answers = once(results, "turn", "content").withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True))
    placed = calls.join(materialize(depths(calls), "calls-depths"), ["conv_id", "call_id"])
    both = placed.withColumn("called", F.lit(True)).join(answers, ["conv_id", "call_id"], "full")

    @F.pandas_udf("struct<faults: string, json: string>")
    def written(call_id: pd.Series, name: pd.Series, arguments: pd.Series, after: pd.Series, content: pd.Series, answered: pd.Series, called: pd.Series) -> pd.DataFrame:
        out = []
        for i, tool, text, parent, answer, has, is_call in zip(call_id, name, arguments, after, content, answered, called, strict=True):
            record: dict = {"id": i}
            faults = ""
            if is_call == True:  # noqa: E712  null where there is no call
                try:
                    value = parsed(text)
                except (TypeError, ValueError, RecursionError):
                    value, faults = text, "$: not JSON"
                if not faults:
                    faults = "; ".join(violations(value, tools[tool]) if tool in tools else ["no such tool"])
                record |= {"name": tool, "arguments": value} | ({"after": parent} if parent is not None else {})
            if has == True:  # noqa: E712
                record["result"] = answer
            out.append((faults, canonical_json(record)))
        return pd.DataFrame(out, columns=["faults", "json"])

    w = written("call_id", "name", "arguments", "after", "content", "answered", "called")
    status = (
        F.when(F.col("called").isNull(), "orphan").when(F.col("depth").isNull(), "cycle").when(F.col("w.faults") != "", "bad arguments").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    both = both.withColumn("w", w).withColumn("status", status)
    return both.select("conv_id", "call_id", "turn", "name", "depth", "result_turn", "status", F.col("w.faults").alias("faults"), F.col("w.json").alias("json"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results derived from plain turns, all by expressions.

    Each turn of a user becomes a call of one of ``TOOLS``, which follows the call
    two turns before; each turn of an assistant the result of the call one turn
    before. Identifiers are digests of the conversation and the turn.

    Defined cases: other roles, and a null one, give nothing. A null text is an
    argument or result that is missing. A null conversation or turn is kept, and
    ``link`` drops the row of a null conversation. Turns that repeat give rows
    that repeat, which ``link`` counts once. Other columns are not read. An empty
    table gives two empty ones.
    """
    ident = lambda t: F.md5(F.concat_ws(":", F.col("conv_id"), t).cast("binary"))
    n = F.length(F.coalesce("text", F.lit("")))
    asked = conversations.filter("role = 'user'")
    arguments = (
        F.when(n % 3 == 0, F.to_json(F.struct(F.col("text").alias("query"), (n % 10).alias("limit"))))
        .when(n % 3 == 1, F.to_json(F.struct((n % 2 == 0).alias("exact"), F.col("text").alias("key"))))
        .otherwise(F.to_json(F.struct(F.when(n % 2 == 0, "words").otherwise("characters").alias("unit"), F.col("text").alias("text"))))
    )
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("measure")
    calls = asked.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
