"""Chat formatting with linked tool calls.

Calls and results meet by a hash join on conversation and call identifier. A call
may name the call it was made from; such chains are followed by pointer doubling,
so a chain of any length takes a logarithmic number of joins. The order puts every
call after its parent and every result after its call, and otherwise keeps turns.
Arguments are checked against JSON schemas, and each record is written as
canonical JSON (sorted keys, no blanks, one spelling of every number).
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordering import with_rank
from packetloom.session import written

#: ``calls`` of a message, in order
CALLS = "array<struct<id:string,name:string,arguments:string,parent:string>>"


# --- JSON -------------------------------------------------------------------


def _number(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        head, tail = text.split("e")
        sign = "-" if tail[0] == "-" else "+"
        return f"{head}e{sign}{tail.lstrip('+-').lstrip('0')}"
    return text


def canonical_json(value) -> str:
    """JSON with keys in UTF-16 order and no blanks; equal values, equal text."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or value == int(value)
    return isinstance(value, _TYPES[kind])


def schema_errors(value, schema: Mapping, at: str = "$") -> list[str]:
    """What breaks the schema: type, enum, required, properties,
    additionalProperties (true or false), items, and the limits of lengths,
    numbers and item counts."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: {k} is unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{at}[{i}]")
    measures = {
        "Length": len(value) if isinstance(value, str) else None,
        "Items": len(value) if isinstance(value, list) else None,
        "imum": value if _is(value, "number") else None,
    }
    for name, size in measures.items():
        if size is not None:
            if size < schema.get(f"min{name}", size):
                out.append(f"{at}: below min{name}")
            if size > schema.get(f"max{name}", size):
                out.append(f"{at}: above max{name}")
    return out


def checked_arguments(text: str | None, schema: Mapping | None) -> tuple[object, list[str]]:
    """The parsed arguments (None where unreadable) and what is wrong with them."""
    if schema is None:
        return None, ["unknown tool"]
    try:
        value = json.loads(text or "")
        canonical_json(value)
    except (ValueError, RecursionError):
        return None, ["arguments are no JSON"]
    return value, schema_errors(value, schema)


# --- links ------------------------------------------------------------------


def _chains(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``at`` (largest turn of the call and its
    ancestors), ``depth`` and ``broken`` (its chain has no end) of every call."""
    first = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "k", "parent")).alias("c")
    )
    start = first.select("conv_id", "call_id", F.col("c.turn").alias("at"), F.col("c.parent").alias("up"))
    known = start.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("id2"))
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("id2"))
    now = start.join(known, same, "left").select(
        "conv_id",
        "call_id",
        "at",
        F.col("id2").alias("up"),
        F.col("id2").isNotNull().cast("long").alias("depth"),
    )
    open_, before = -1, None
    while True:
        now = written(now, "chains")
        open_ = now.filter("up is not null").count()
        if open_ == 0 or open_ == before:
            break
        before = open_
        jump = now.select(
            F.col("conv_id").alias("c2"),
            F.col("call_id").alias("id2"),
            F.col("at").alias("at2"),
            F.col("up").alias("up2"),
            F.col("depth").alias("depth2"),
        )
        now = now.join(jump, same, "left").select(
            "conv_id",
            "call_id",
            F.greatest("at", "at2").alias("at"),
            F.col("up2").alias("up"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
        )
    return now.select(
        "conv_id",
        "call_id",
        "at",
        F.when(F.col("up").isNull(), F.col("depth")).otherwise(0).alias("depth"),
        F.col("up").isNotNull().alias("broken"),
    )


def _events(messages: DataFrame) -> DataFrame:
    base = messages.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.col("calls").cast(CALLS).alias("calls"),
        F.col("result_of").cast("string").alias("result_of"),
    )
    none = F.lit(None).cast("string")
    plain = base.select(
        "conv_id",
        "turn",
        F.when(F.col("result_of").isNull(), "message").otherwise("result").alias("kind"),
        F.lit(-1).alias("k"),
        F.col("result_of").alias("call_id"),
        "role",
        "text",
        none.alias("name"),
        none.alias("arguments"),
        none.alias("parent"),
    )
    made = base.select("conv_id", "turn", "role", F.posexplode("calls").alias("k", "c"))
    calls = made.select(
        "conv_id",
        "turn",
        F.lit("call").alias("kind"),
        "k",
        F.col("c.id").alias("call_id"),
        "role",
        none.alias("text"),
        F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"),
        F.col("c.parent").alias("parent"),
    )
    return plain.unionByName(calls)


def link_calls(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Messages, calls and results in topological order, as canonical JSON.

    ``messages`` has ``conv_id``, ``turn``, ``role``, ``text``, ``calls`` (see
    ``CALLS``; NULL for none) and ``result_of`` (the identifier of the call that
    the message answers, or NULL). Per event: ``kind``, ``position`` in its
    conversation from 1, ``call_id``, ``linked`` (a call with a result, a result
    with a call; NULL for plain messages), ``valid`` and ``errors`` of a call,
    ``json``.

    If an identifier is used by several calls of a conversation, the first of
    them places its results. A parent that does not exist is ignored; calls whose
    parents form a cycle keep their turns and get an error. Results without a
    call, and calls without an identifier, stay where their turn puts them. NULL
    conversations are one conversation; NULL turns come first. Repeated rows
    give repeated events; an empty table gives none.
    """
    events = written(_events(messages), "events")
    calls = events.filter("kind = 'call' and call_id is not null")
    chains = written(_chains(calls.select("conv_id", "call_id", "turn", "k", "parent")), "chains")
    answered = (
        events.filter("kind = 'result'").select("conv_id", "call_id").distinct()
        .withColumn("answered", F.lit(True))
    )
    sides = chains.unionByName(answered, allowMissingColumns=True)
    by_call = written(
        sides.groupBy("conv_id", "call_id").agg(
            F.max("at").alias("at"),
            F.max("depth").alias("depth"),
            F.coalesce(F.max("broken"), F.lit(False)).alias("broken"),
            F.coalesce(F.max("answered"), F.lit(False)).alias("answered"),
            F.count("broken").alias("called"),
        ),
        "calls",
    ).withColumnsRenamed({"conv_id": "c2", "call_id": "id2"})
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("call_id") == F.col("id2"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    ordered = events.join(by_call, same, "left").select(
        *events.columns,
        F.coalesce(F.greatest("turn", "at"), F.lit(-1)).alias("at"),
        # a plain message, then calls by depth, each result below its call
        F.when(is_call, F.coalesce("depth", F.lit(0)) + 1)
        .when(is_result, F.coalesce("depth", F.lit(-1)) + 2)
        .otherwise(0)
        .alias("level"),
        F.when(is_call, F.coalesce("answered", F.lit(False)))
        .when(is_result, F.coalesce(F.col("called") > 0, F.lit(False)))
        .alias("linked"),
        F.coalesce("broken", F.lit(False)).alias("broken"),
    )
    order = ["at", "level", "turn", "k", "call_id", "tie"]
    ordered = ordered.withColumn("tie", F.xxhash64("kind", "role", "text", "name", "arguments"))
    ranked = with_rank(written(ordered, "ordered"), order, ["conv_id"], name="position")
    return _serialised(ranked, schemas)


def _serialised(ranked: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Validate calls and write every event as JSON; a small step per row."""
    tools = {k: dict(v) for k, v in schemas.items()}
    names = ["kind", "role", "text", "call_id", "name", "arguments", "broken"]
    kept = [c for c in ("conv_id", "turn", "kind", "position", "call_id", "linked") if c in ranked.columns]
    rows = ranked.select(F.struct(*kept).alias("event"), *names)
    kind = rows.schema["event"].dataType.simpleString()

    def write(batches):
        for batch in batches:
            valid, errors, out = [], [], []
            for r in batch.select(names).to_pylist():
                record = {"role": r["role"]}
                found: list[str] | None = None
                if r["kind"] == "call":
                    value, found = checked_arguments(r["arguments"], tools.get(r["name"]))
                    if r["call_id"] is None:
                        found = [*found, "no identifier"]
                    if r["broken"]:
                        found = [*found, "parents form a cycle"]
                    raw = r["arguments"] if value is None else value
                    record["call"] = {"id": r["call_id"], "name": r["name"], "arguments": raw}
                else:
                    record["content"] = r["text"]
                    if r["kind"] == "result":
                        record["result_of"] = r["call_id"]
                valid.append(None if found is None else not found)
                errors.append(found)
                out.append(canonical_json(record))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(valid, pa.bool_()),
                    pa.array(errors, pa.list_(pa.string())),
                    pa.array(out, pa.string()),
                ],
                ["event", "valid", "errors", "json"],
            )

    schema = f"event {kind}, valid boolean, errors array<string>, json string"
    return rows.mapInArrow(write, schema).select("event.*", "valid", "errors", "json")
