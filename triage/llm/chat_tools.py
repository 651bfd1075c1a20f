"""Chat formatting: links tool calls with their results, orders them, checks arguments against schemas, and writes canonical JSON.

Calls and results meet in a hash join by conversation and identifier.  Calls may refer to the result of another call; they are ordered by
peeling off, round by round, the calls that wait for none (one round per level of the deepest chain, each a join on the links still
open), so no conversation is ever held in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.jsonwalk import utf8
from triage.llm.common import land, small_batches

#: A string argument of this form stands for the result of another call of the conversation.
REFERENCE = r'"\$result:([^"\\]+)"'
_schemas: dict[str | None, dict | bool | None] = {}


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: conv_id, call_id, turn, depth, status, errors, message.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text).  ``results``: conv_id, turn, call_id, content.  ``tools``: name, schema
    (JSON Schema text); other columns are ignored.  Of calls or results that share conversation and identifier the one with the smallest
    turn counts (then the smallest content), and ``repeats`` has the number of others.  depth is 0 for calls that refer to no other call,
    else one more than the deepest they refer to; null for calls in or behind a cycle.  status: linked, no_result, no_call, no_tool,
    invalid (arguments are no JSON object or break the schema), cycle; the first that fits of no_call, no_tool, invalid, cycle,
    no_result, linked.  A reference to a call that isn't there is an error, as are rows whose conversation or identifier is null
    (status no_call for results, invalid for calls; they are linked with nothing).  Empty tables give an empty result.
    message is canonical JSON: keys sorted, no white space, numbers shortest; null where the arguments are no JSON object.  Arguments with a
    number out of range or nested too deep for the parser are invalid; lone surrogates are written as U+FFFD.
    """
    small_batches(calls.sparkSession)
    key = ["conv_id", "call_id"]
    first = lambda df, *rest: df.groupBy(*key).agg(
        F.min(F.struct("turn", *rest)).alias("x"), (F.count("*") - 1).alias("repeats")).select(*key, "x.*", "repeats")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*key, "turn", "name", "arguments")
    results = results.select(*key, "turn", "content")
    known = first(calls.where(named), "arguments", "name").select(*key, F.col("turn").alias("turn"), "name", "arguments", F.col("repeats").alias("r1"))
    answers = first(results.where(named), "content").select(
        *key, F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("r2"))
    tools = tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema"))
    both = known.withColumn("is_call", F.lit(True)).hint("shuffle_hash").join(answers.withColumn("is_result", F.lit(True)), key, "full")
    loose = calls.where(~named).select(
        *key, "turn", "name", "arguments", F.lit(0).alias("r1"), F.lit(True).alias("is_call"), F.lit(None).alias("result_turn"),
        F.lit(None).alias("content"), F.lit(0).alias("r2"), F.lit(None).alias("is_result"))
    orphans = results.where(~named).select(
        *key, F.lit(None).alias("turn"), F.lit(None).alias("name"), F.lit(None).alias("arguments"), F.lit(0).alias("r1"),
        F.lit(None).alias("is_call"), F.col("turn").alias("result_turn"), "content", F.lit(0).alias("r2"), F.lit(True).alias("is_result"))
    both = both.unionByName(loose).unionByName(orphans).join(tools, "name", "left")
    both = land(both, "tool-calls")

    links = both.where(F.col("is_call") & named).select(*key, F.explode(F.array_distinct(
        F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(REFERENCE), F.lit(1)))).alias("needs"))
    depth = _depths(both.where(F.col("is_call") & named).select(*key), land(links, "tool-links"))
    rows = both.join(depth, key, "left")

    fields = ("name", "schema", "arguments", "content", "is_call", "is_result", "depth", "missing")
    rows = rows.select(*key, F.coalesce("turn", "result_turn").alias("turn"), "depth", (F.coalesce("r1", F.lit(0)) + F.coalesce(
        "r2", F.lit(0))).cast("long").alias("repeats"), F.struct(*fields).alias("all"), named.alias("named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(one, i, ok) for one, i, ok in zip(
                batch.column("all").to_pylist(), batch.column("call_id").to_pylist(), batch.column("named").to_pylist())]
            status, errors, message = zip(*made) if made else ((), (), ())
            keep = ["conv_id", "call_id", "turn", "depth", "repeats"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())),
                 pa.array(message, pa.string())], names=[*keep, "status", "errors", "message"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "call_id", "turn", "depth", "repeats"))
                           + ", status string, errors array<string>, message string")


def _depths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, call_id, depth, missing (references without a call)."""
    key = ["conv_id", "call_id"]
    there = nodes.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    links = land(links.join(there, ["conv_id", "needs"], "left"), "tool-links")
    missing = links.where("there is null").groupBy(*key).agg(F.array_sort(F.collect_set("needs")).alias("missing"))
    open_ = links.where("there").select(*key, "needs")
    waiting = land(open_.select(*key).distinct(), "tool-waiting")
    free = nodes.join(waiting, key, "left_anti").withColumn("depth", F.lit(0))
    done = [free]
    level = 0
    fresh = free.select("conv_id", F.col("call_id").alias("needs"))
    while not waiting.isEmpty():
        level += 1
        open_ = land(open_.join(fresh, ["conv_id", "needs"], "left_anti"), "tool-links")
        still = land(open_.select(*key).distinct(), "tool-waiting")
        now = land(waiting.join(still, key, "left_anti"), "tool-level")
        if now.isEmpty():
            break  # what is left waits for itself
        done.append(now.withColumn("depth", F.lit(level)))
        fresh = now.select("conv_id", F.col("call_id").alias("needs"))
        waiting = still
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out.join(missing, key, "full")


def judge(row: dict, call_id: str | None, named: bool) -> tuple[str, list[str], str | None]:
    """Status, errors and message of a linked row.  Whatever is in the row ends in its status, never in an exception."""
    status, errors, message = _judge(row, call_id, named)
    return status, [utf8(e) for e in errors], utf8(message)


def _judge(row: dict, call_id: str | None, named: bool) -> tuple[str, list[str], str | None]:
    if not row["is_call"]:
        return "no_call", ["result without a call"], canonical({"id": call_id, "result": row["content"]})
    errors = [] if named else ["no identifier"]
    errors += [f"no call {m}" for m in row["missing"] or []]
    arguments, schema, message = None, _schema(row["schema"]), None
    try:
        arguments = json.loads(row["arguments"] or "", parse_constant=_refuse, parse_float=_finite, object_pairs_hook=_once)
        if not isinstance(arguments, dict):
            errors.append("arguments: not an object")
        else:
            message = canonical({"arguments": arguments, "id": call_id, "name": row["name"], **({"result": row["content"]} if row["is_result"] else {})})
            if schema is not None:
                errors += check(arguments, schema, "arguments")
    except RecursionError:
        errors.append("arguments: nested too deep")
    except ValueError as e:
        errors.append(f"arguments: {e}")
    if row["schema"] is None:
        return "no_tool", [*errors, "no such tool"], message
    if schema is None:
        return "no_tool", [*errors, "tool's schema is no JSON Schema"], message
    if errors:
        return "invalid", errors, message
    if row["depth"] is None:
        return "cycle", ["refers to itself"], message
    return ("linked" if row["is_result"] else "no_result"), [], message


def _finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is out of range")
    return number


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _schema(text: str | None) -> dict | bool | None:
    """A schema's object, or true or false; null for anything else."""
    if text not in _schemas:
        try:
            found = json.loads(text or "")
        except (ValueError, RecursionError):
            found = None
        if len(_schemas) > 1000:
            _schemas.clear()
        _schemas[text] = found if isinstance(found, (dict, bool)) else None
    return _schemas[text]


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords that judge nothing.
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == math.floor(value))
    return isinstance(value, _TYPES[kind])


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is."""
    return canonical(a) == canonical(b)


def check(value, schema, at: str) -> list[str]:
    """What breaks a JSON Schema: boolean schemas, type, enum, const, allOf, anyOf, oneOf, not, required, properties, patternProperties,
    additionalProperties, propertyNames, min/maxProperties, items, contains, uniqueItems, lengths, bounds, multipleOf, pattern.  Any other
    keyword, and one with a value that means nothing, is an error of its own: what isn't understood is never passed as valid.
    """
    if schema is True:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is neither object nor boolean"]
    out = []
    for word in sorted(schema):
        if word in _NOTES:
            continue
        judged = _KEYWORDS.get(word)
        if judged is None:
            out.append(f"{at}: schema keyword {word} is not known")
            continue
        try:
            found = judged(value, schema[word], at, schema)
        except (TypeError, KeyError, AttributeError, re.error, ArithmeticError):
            found = [f"{at}: schema keyword {word} can't be read"]
        out += found
    return out


def _type(value, kinds, at, schema):
    kinds = kinds if isinstance(kinds, list) else [kinds]
    return [] if any([_is(value, k) for k in kinds]) else [f"{at}: not {' or '.join(kinds)}"]


def _required(value, names, at, schema):
    return [f"{at}.{k}: missing" for k in sorted(set(names)) if k not in value] if isinstance(value, dict) else []


def _properties(value, known, at, schema):
    return [e for k in sorted(value) if k in known for e in check(value[k], known[k], f"{at}.{k}")] if isinstance(value, dict) else []


def _pattern_properties(value, known, at, schema):
    return [e for p in sorted(known) for k in sorted(value) if re.search(p, k) for e in check(value[k], known[p], f"{at}.{k}")] if isinstance(value, dict) else []


def _additional(value, rest, at, schema):
    if not isinstance(value, dict):
        return []
    patterns = schema.get("patternProperties", {})
    other = [k for k in sorted(value) if k not in schema.get("properties", {}) and not any(re.search(p, k) for p in patterns)]
    return [f"{at}.{k}: not known" for k in other] if rest is False else [e for k in other for e in check(value[k], rest, f"{at}.{k}")]


def _branches(value, schemas, at) -> list[bool]:
    return [not check(value, s, at) for s in list(schemas)]


def _items(value, kind, at, schema):
    if not isinstance(value, list):
        return []
    kinds = [*kind, *[True] * len(value)] if isinstance(kind, list) else [kind] * len(value)
    return [e for i, x in enumerate(value) for e in check(x, kinds[i], f"{at}[{i}]")]


def _unless(bad: bool, at: str, what: str) -> list[str]:
    return [f"{at}: {what}"] if bad else []


def _size(kind: type, bad, what: str):
    return lambda v, n, at, s: _unless(isinstance(v, kind) and bad(len(v), n), at, what)


def _bound(bad, what: str):
    return lambda v, n, at, s: _unless(_is(v, "number") and bad(v, n), at, what)


_FEW, _MANY = (lambda n, least: n < least), (lambda n, most: n > most)
_KEYWORDS = {
    "type": _type, "required": _required, "properties": _properties, "patternProperties": _pattern_properties,
    "additionalProperties": _additional, "items": _items,
    "enum": lambda v, given, at, s: _unless(not any([_same(v, x) for x in list(given)]), at, "not one of the values"),
    "const": lambda v, given, at, s: _unless(not _same(v, given), at, "not the value"),
    "allOf": lambda v, given, at, s: [e for x in list(given) for e in check(v, x, at)],
    "anyOf": lambda v, given, at, s: _unless(not any(_branches(v, given, at)), at, "fits no schema of anyOf"),
    "oneOf": lambda v, given, at, s: _unless(sum(_branches(v, given, at)) != 1, at, "does not fit one schema of oneOf alone"),
    "not": lambda v, given, at, s: _unless(not check(v, given, at), at, "fits the schema of not"),
    "propertyNames": lambda v, given, at, s: [e for k in sorted(v) for e in check(k, given, f"{at}.{k}")] if isinstance(v, dict) else [],
    "contains": lambda v, given, at, s: _unless(isinstance(v, list) and not any(_branches_of(v, given, at)), at, "contains none that fits"),
    "uniqueItems": lambda v, given, at, s: _unless(given is True and isinstance(v, list) and len({canonical(x) for x in v}) < len(v), at, "holds an item twice"),
    "minLength": _size(str, _FEW, "too short"), "maxLength": _size(str, _MANY, "too long"),
    "minItems": _size(list, _FEW, "too short"), "maxItems": _size(list, _MANY, "too long"),
    "minProperties": _size(dict, _FEW, "too few keys"), "maxProperties": _size(dict, _MANY, "too many keys"),
    "minimum": _bound(lambda v, n: v < n, "too small"), "maximum": _bound(lambda v, n: v > n, "too large"),
    "exclusiveMinimum": _bound(lambda v, n: v <= n, "too small"), "exclusiveMaximum": _bound(lambda v, n: v >= n, "too large"),
    "multipleOf": _bound(lambda v, n: Fraction(repr(v)) % Fraction(repr(n)) != 0, "not a multiple"),
    "pattern": lambda v, given, at, s: _unless(isinstance(v, str) and not re.search(given, v), at, "does not match"),
}


def _branches_of(values: list, schema, at: str) -> list[bool]:
    return [not check(x, schema, at) for x in values]


def _number(x: int | float) -> str:
    """Whole numbers by their digits; others shortest, without exponent from 1e-6 to 1e21."""
    if isinstance(x, int):
        return int.__repr__(x)
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x).removesuffix(".0")), "f")
    mantissa, _, power = repr(x).partition("e")
    return f"{mantissa.removesuffix('.0')}e{'+' if int(power) > 0 else ''}{int(power)}"


def canonical(value) -> str:
    """Canonical JSON: keys sorted by UTF-16 units, no white space, shortest numbers.  Walks with a stack, so any depth is written."""
    out: list[str] = []
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            stack.append(_Raw("}"))
            for i in range(len(keys) - 1, -1, -1):
                stack += [x[keys[i]], _Raw(("," if i else "") + json.dumps(keys[i], ensure_ascii=False) + ":")]
            stack.append(_Raw("{"))
        elif isinstance(x, list):
            stack.append(_Raw("]"))
            for i in range(len(x) - 1, -1, -1):
                stack += [x[i], _Raw("," if i else "")]
            stack.append(_Raw("["))
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            out.append(_number(x))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text of the output that waits on the stack."""
