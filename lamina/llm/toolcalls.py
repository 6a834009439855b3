"""Chat formatting: tool calls linked to their results.

Calls and results of a conversation meet by a hash join on the conversation and the
call's identifier. Calls may wait for others; taking away the calls whose waits are over,
level by level, orders them topologically: by level, then turn, then identifier. Their
arguments are validated against the tool's schema, and each linked call is serialised
as canonical JSON: keys sorted, no spaces, no escapes that are not needed, whole numbers
without a fraction; half a surrogate pair stays an escape.

Joins are by conversation and identifier. Calls are ordered in one pass over the rows sorted by
conversation, which holds the identifiers of one conversation at a time, AT_ONCE of them with
their waits at most. A conversation of more is never gathered in one task: its calls are peeled
by joins, in as many rounds as its longest chain of waits.

Edge cases: of several calls, or results, with one identifier the first by turn is linked
and has the number of the others; each of these has a row of its own, as ``repeated_call``
with its arguments validated and no level or result, or as ``repeated_result`` with the
result as its message; equal ones have as many rows as they are. Calls and results without
an identifier cannot be linked and are reported as ``no_id`` and ``result_no_id``; like any
other result without a call, the latter has no message. A null conversation is a conversation; a wait for a call that
does not exist is reported and not waited for; a call that waits for itself, in a cycle,
or for such a call has no level; null or unparsable arguments, duplicate keys, numbers
that JSON does not know and unknown tools are errors of validation; a result that is not
JSON is a string; a null result is null.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle

LONE = re.compile("[\ud800-\udfff]")
#: Calls and waits of one conversation that one task orders; those of a larger one are peeled.
AT_ONCE = 200_000
CALL = "conv_id, call_id, turn, name, arguments, after"
#: Kinds of rows that hold a result and no call.
OF_RESULTS = ("no_call", "repeated_result", "result_no_id")
TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in the value breaks the schema, as path and rule."""
    found = []
    wanted = schema.get("type")
    if wanted is not None:
        kinds = wanted if isinstance(wanted, list) else [wanted]
        if not any(TYPES[kind](value) for kind in kinds):
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: enum")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        found += [f"{at}.{name}: required" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in fields:
                found += violations(value[name], fields[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{name}: unknown")
    elif isinstance(value, list):
        found += _outside(len(value), schema, at, "minItems", "maxItems")
        if "items" in schema:
            for i, item in enumerate(value):
                found += violations(item, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        found += _outside(len(value), schema, at, "minLength", "maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    elif TYPES["number"](value):
        found += _outside(value, schema, at, "minimum", "maximum")
    return found


def _outside(value, schema: dict, at: str, least: str, most: str) -> list[str]:
    below = [f"{at}: {least}"] if least in schema and value < schema[least] else []
    above = [f"{at}: {most}"] if most in schema and value > schema[most] else []
    return below + above


def parsed(source: str):
    """The JSON value; raises ValueError on duplicate keys and on NaN and infinities."""

    def once(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("duplicate key")
        return out

    def refused(name: str):
        raise ValueError(f"{name} is not JSON")

    return _whole(json.loads(source, object_pairs_hook=once, parse_constant=refused))


def _whole(value):
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("number out of range")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return _encodable(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _encodable(text: str) -> str:
    """Half a surrogate pair, which UTF-8 cannot hold, stays the JSON escape that it came as."""
    return LONE.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def message(call_id: str, name: str, arguments: str | None, result: str | None, schemas: dict) -> tuple[list[str], str]:
    """Errors of validation, and the call with its result as canonical JSON."""
    value, errors = arguments, []
    if arguments is None:
        errors = ["$: missing"]
    else:
        try:
            value = parsed(arguments)
            errors = violations(value, schemas[name]) if name in schemas else [f"unknown tool {name}"]
            errors = [_encodable(error) for error in errors]
        except (ValueError, RecursionError):
            errors = ["$: not JSON"]
    return errors, canonical({"id": call_id, "name": name, "arguments": value, "result": answer_of(result)})


def answer_of(result: str | None):
    """The result as JSON, or as the string that it is."""
    if result is None:
        return None
    try:
        return parsed(result)
    except (ValueError, RecursionError):
        return result


def _key(conv: Column, call: Column) -> Column:
    """One string per conversation and identifier, nulls included."""
    return F.to_json(F.struct(conv.alias("conv"), call.alias("call")))


def _first_of_each(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The first row per key by turn, and how many others there are."""
    picked = rows.groupBy("link").agg(
        F.min(F.struct("turn", *fields)).alias("first"), (F.count("*") - 1).alias("others")
    )
    return picked.select("link", "first.*", "others")


def _others_of_each(rows: DataFrame, fields: list[str], firsts: DataFrame) -> DataFrame:
    """The rows that ``_first_of_each`` only counts; ``firsts`` is what it found."""
    columns = ["turn", *fields]
    several = firsts.where("others > 0").select("link", F.struct(*columns).alias("first"))
    if several.isEmpty():
        return rows.select(*columns).where(F.lit(False))
    row = F.struct(*columns)
    found = rows.join(several, "link").select("link", row.alias("row"), row.eqNullSafe(F.col("first")).alias("is_first"))
    # The one that is linked is one of the rows equal to it.
    copies = F.count("*").cast("int") - F.max(F.col("is_first").cast("int"))
    counted = found.groupBy("link", "row").agg(copies.alias("copies")).where("copies > 0")
    return counted.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def levels(calls: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``link, level`` for calls ``conv_id, link, waits`` (keys that each waits for, in its conversation).

    There is none for calls in or behind cycles.
    """
    calls = calls.select(F.to_json(F.struct("conv_id")).alias("conv"), "link", "waits")
    sizes = calls.groupBy("conv").agg(F.sum(F.size("waits") + 1).alias("size"))
    large = settle(sizes.where(F.col("size") > at_once).select("conv"), "large-conversations")
    if large.isEmpty():
        return _ordered(calls)
    peeled = _peeled(calls.join(large, "conv", "left_semi").select("link", "waits"))
    return _ordered(calls.join(large, "conv", "left_anti")).unionByName(peeled)


def _ordered(calls: DataFrame) -> DataFrame:
    """``link, level`` by one pass over the conversations, each of which fits a task."""
    rows = calls.select("conv", "link", "waits").repartition("conv").sortWithinPartitions("conv")
    return rows.mapInArrow(_levels_of_conversations, "link string, level int")


def _levels_of_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
    links, found = [], []
    for _, calls in groupby(rows, key=lambda row: row[0]):
        for link, level in levels_of({link: waits for _, link, waits in calls}).items():
            links.append(link)
            found.append(level)
        if len(links) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(found, pa.int32())], ["link", "level"])
            links, found = [], []
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(found, pa.int32())], ["link", "level"])


def levels_of(waits: dict[str, list[str]]) -> dict[str, int]:
    """The level of each call that is not in or behind a cycle; waits for calls that do not exist are over."""
    left = {link: sum(w in waits for w in those) for link, those in waits.items()}
    waiting = defaultdict(list)
    for link, those in waits.items():
        for w in those:
            waiting[w].append(link)
    found, done, level = {}, [link for link, n in left.items() if not n], 0
    while done:
        following = []
        for link in done:
            found[link] = level
            for other in waiting[link]:
                left[other] -= 1
                if not left[other]:
                    following.append(other)
        done, level = following, level + 1
    return found


def _peeled(calls: DataFrame) -> DataFrame:
    """``link, level`` of calls ``link, waits`` whose conversations fit no task, level by level."""
    nodes = calls.select("link")
    waits = calls.select("link", F.explode("waits").alias("wait")).distinct()
    waits = settle(waits.join(nodes.withColumnRenamed("link", "wait"), "wait", "left_semi"), "waits")
    done = settle(nodes.join(waits, "link", "left_anti").withColumn("level", F.lit(0)), "level")
    out = [done]
    while not waits.isEmpty():
        over = done.select(F.col("link").alias("wait"))
        left = settle(waits.join(over, "wait", "left_anti"), "waits")
        done = settle(
            waits.select("link").distinct().join(left, "link", "left_anti").withColumn("level", F.lit(len(out))),
            "level",
        )
        if done.isEmpty():
            break
        out.append(done)
        waits = left
    return reduce(DataFrame.unionByName, out)


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result that is not the first of a call's identifier.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (array of the
    identifiers of calls that it waits for). ``results``: conv_id, call_id, turn, content.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string"), "turn", "name", "arguments", "after")
    results = results.select("conv_id", F.col("call_id").cast("string"), "turn", "content")
    conv = F.col("conv_id")
    waits = F.transform(F.coalesce("after", F.array().cast("array<string>")), lambda a: _key(conv, a))
    named_calls = (
        calls.where("call_id is not null")
        .withColumn("waits", F.array_sort(F.array_distinct(waits)))
        .withColumn("link", _key(conv, F.col("call_id")))
    )
    call_fields = ["conv_id", "call_id", "name", "arguments", "waits"]
    asked = settle(_first_of_each(named_calls, call_fields), "calls")
    more_calls = _others_of_each(named_calls, call_fields, asked)
    asked = asked.withColumnRenamed("others", "other_calls")
    named_results = results.where("call_id is not null").withColumn("link", _key(conv, F.col("call_id")))
    result_fields = ["conv_id", "call_id", "content"]
    answered = settle(_first_of_each(named_results, result_fields), "results")
    more_results = _others_of_each(named_results, result_fields, answered)
    found = answered.select(
        "link",
        F.col("turn").alias("result_turn"),
        F.col("conv_id").alias("result_conv"),
        F.col("call_id").alias("result_call"),
        "content",
        F.col("others").alias("other_results"),
    )
    met = asked.join(found.hint("shuffle_hash"), "link", "full")
    order = levels(asked.select("conv_id", "link", "waits"))
    present = asked.select(F.col("link").alias("wait"), F.lit(1).alias("there"))
    missing = (
        asked.select("link", F.explode("waits").alias("wait"))
        .join(present, "wait", "left_anti")
        .groupBy("link")
        .agg(F.count("*").alias("missing_waits"))
    )
    met = met.join(order, "link", "left").join(missing, "link", "left")
    status = (
        F.when(F.col("other_calls").isNull(), F.lit("no_call"))
        .when(F.col("other_results").isNull(), F.lit("no_result"))
        .otherwise(F.lit("linked"))
    )
    rows = met.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"),
        F.coalesce("call_id", "result_call").alias("call_id"),
        "turn",
        "result_turn",
        "level",
        status.alias("status"),
        F.coalesce("missing_waits", F.lit(0)).alias("missing_waits"),
        F.coalesce("other_calls", F.lit(0)).alias("other_calls"),
        F.coalesce("other_results", F.lit(0)).alias("other_results"),
        "name",
        "arguments",
        "content",
    )
    alone = [
        _alone(more_calls, "repeated_call"),
        _alone(more_results, "repeated_result"),
        _alone(calls.where("call_id is null"), "no_id", level=0),
        _alone(results.where("call_id is null"), "result_no_id"),
    ]
    return _serialised(reduce(DataFrame.unionByName, [*alone, rows]), schemas)


def _alone(rows: DataFrame, status: str, level: int | None = None) -> DataFrame:
    """Calls or results that are linked to nothing, as rows of the output."""
    of_results = "content" in rows.columns
    nothing = F.lit(None)
    return rows.select(
        "conv_id",
        "call_id",
        (nothing.cast("long") if of_results else F.col("turn")).alias("turn"),
        (F.col("turn") if of_results else nothing.cast("long")).alias("result_turn"),
        F.lit(level).cast("int").alias("level"),
        F.lit(status).alias("status"),
        *[F.lit(0).cast("long").alias(c) for c in ("missing_waits", "other_calls", "other_results")],
        *[nothing.cast("string").alias(c) if of_results else F.col(c) for c in ("name", "arguments")],
        F.col("content") if of_results else nothing.cast("string").alias("content"),
    )


def _serialised(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    @F.pandas_udf("errors array<string>, message string")
    def of(
        statuses: pd.Series, ids: pd.Series, names: pd.Series, arguments: pd.Series, results: pd.Series
    ) -> pd.DataFrame:
        given = zip(statuses, ids, names, arguments, results)
        made = [_made(status, values, schemas) for status, *values in given]
        return pd.DataFrame(made, columns=["errors", "message"])

    made = of("status", "call_id", "name", "arguments", "content")
    is_call = ~F.col("status").isin(*OF_RESULTS)
    return (
        rows.withColumn("made", made)
        .withColumn("errors", F.when(is_call, F.col("made.errors")))
        .withColumn("valid", F.when(is_call, F.size("made.errors") == 0))
        .withColumn("message", F.col("made.message"))
        .drop("made", "name", "arguments", "content")
    )


def _made(status: str, values: list, schemas: dict[str, dict]) -> tuple[list[str] | None, str | None]:
    if status not in OF_RESULTS:
        return message(*values, schemas)
    if status != "repeated_result":
        return None, None
    return None, canonical({"id": values[0], "result": answer_of(values[-1])})


#: What the turns of a conversation are read as, and what their arguments must be.
SCHEMAS = {
    name: {
        "type": "object",
        "required": ["text", "words"],
        "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1},
            "words": {"type": "integer", "minimum": 1, "maximum": most},
            "opening": {"type": "boolean"},
        },
    }
    for name, most in (("answer", 200), ("configure", 50))
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads turns as calls and results.

    A user's turn calls ``answer`` and a system's ``configure``, identified by the turn's
    number; an assistant's turn is the result of the turn before it. A call waits for
    another half as far into the conversation, so threads fork and are not one chain.
    """
    turn = F.col("turn")
    odd = F.pmod(turn, F.lit(2))
    earlier = odd + F.floor((turn - odd) / 4) * 2
    arguments = F.to_json(
        F.struct(
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), "text", (turn <= 1).alias("opening")
        )
    )
    calls = conversations.where("role in ('user', 'system')").select(
        "conv_id",
        turn.cast("string").alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", F.lit("answer")).otherwise(F.lit("configure")).alias("name"),
        arguments.alias("arguments"),
        F.when(earlier < turn, F.array(earlier.cast("string"))).alias("after"),
    )
    others = conversations.where("role is null or role not in ('user', 'system')")
    results = others.select(
        "conv_id", (turn - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results
