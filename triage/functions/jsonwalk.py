"""Walking JSON bodies of any shape: keys and named leaves.

Bodies are taken as they come: repeated keys (the last value counts), NaN and infinities, numbers of any length, any depth, and lone
surrogate escapes, which become U+FFFD since no UTF-8 text can hold them.  What is no JSON has no keys and no leaves.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<quote>\")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<word>true|false|null|NaN|-?Infinity))")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_END = re.compile(r"[ \t\n\r]*\Z")
#: Digits from which a whole number is kept as text instead of being computed.
_LONG = 4000


class Digits:
    """A whole number too long to compute with."""

    def __init__(self, text: str) -> None:
        self.text = text

    def __str__(self) -> str:
        return self.text


def utf8(text: str | None) -> str | None:
    """The text with U+FFFD for lone surrogates."""
    if text is None or text.isascii():
        return text
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def parse(text: str):
    """The value of a JSON text; ValueError if it is none.  The built-in parser reads all but deep nesting and very long numbers."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):
        return _parse(text)


def _parse(text: str):
    """One pass over the tokens with the open arrays and objects on a stack."""
    at, root = 0, []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]  # container, key that waits for its value
    ready = True  # a value may come: after an opening, a comma or a colon
    opened = False  # the container may also end here
    while len(stack) > 1 or not root:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"no JSON at {at}")
        at, kind, mark = token.end(), token.lastgroup, token.group().lstrip(" \t\n\r")
        box, key = stack[-1]
        if kind == "mark" and mark in "]}":
            if len(stack) == 1 or (isinstance(box, dict) != (mark == "}")) or (ready and not opened) or key is not None:
                raise ValueError(f"{mark} at {at}")
            stack.pop()
            ready = opened = False
            continue
        if kind == "mark" and mark == ",":
            if ready or len(stack) == 1:
                raise ValueError(f"comma at {at}")
            ready, opened = True, False
            continue
        if not ready:
            raise ValueError(f"value at {at}")
        if isinstance(box, dict) and key is None:
            if kind != "quote":
                raise ValueError(f"no key at {at}")
            name, at = scanstring(text, at, True)
            colon = _TOKEN.match(text, at)
            if colon is None or colon.group("mark") != ":":
                raise ValueError(f"no colon at {at}")
            at, opened = colon.end(), False
            stack[-1] = (box, name)
            continue
        if kind == "quote":
            value, at = scanstring(text, at, True)
        elif kind == "mark":
            if mark == ":":
                raise ValueError(f"colon at {at}")
            value = {} if mark == "{" else []
        elif kind == "number":
            whole = not set(mark) & set(".eE")
            value = float(mark) if not whole else Digits(mark) if len(mark) > _LONG else int(mark)
        else:
            value = _WORDS[mark]
        if isinstance(box, dict):
            box[key] = value
            stack[-1] = (box, None)
        else:
            box.append(value)
        ready = opened = kind == "mark"
        if opened:
            stack.append((value, None))
    if not _END.match(text, at):
        raise ValueError(f"more at {at}")
    return root[0]


def walk(text: str | None, keys: bool = False):
    """Keys, once per occurrence, or (name, value) leaves in document order; None if the text is no JSON, or null.

    Items of a list inherit the name above them; leaves without a name are left out.
    """
    if text is None:
        return None
    try:
        root = parse(text)
    except ValueError:
        return None
    if root is None:
        return None
    found, stack = [], [("", root)]
    while stack:
        name, node = stack.pop()
        if isinstance(node, dict):
            if keys:
                found.extend(utf8(k) for k in node)
            stack.extend((k, v) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((name, v) for v in reversed(node))
        elif name and not keys:
            found.append((utf8(name), utf8(str(node))))
    return found


_PAIRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
_ARROW_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _json_keys(bodies: pa.Array) -> pa.Array:
    return pa.array([walk(b.as_py(), keys=True) for b in bodies], pa.list_(pa.string()))


@F.arrow_udf(_PAIRS)
def _json_leaves(bodies: pa.Array) -> pa.Array:
    found = (walk(b.as_py()) for b in bodies)
    return pa.array([f and [{"name": n, "value": v} for n, v in f] if f is not None else None for f in found], _ARROW_PAIRS)


def json_keys(body: Column) -> Column:
    """Every object key of a JSON text, at any depth, once per occurrence.

    The one Arrow step that a plan takes for all the bodies of its rows; only bodies that open like an object or a list are sent to it.
    """
    opens = F.regexp_extract(body, r"^\s*+(.)", 1).isin("{", "[")
    return F.coalesce(_json_keys(F.when(opens, body)), F.array().cast("array<string>"))


def distinct_json_keys(body: Column) -> Column:
    return F.array_sort(F.array_distinct(json_keys(body)))


def body_leaves(body: Column) -> Column:
    """(name, value) leaves of a JSON body, or the pairs of a form body.

    The walk needs a stack, which no built-in expression has; it is the one Arrow
    step, and only bodies that open like JSON are sent to it.
    """
    from triage.functions.urls import query_pairs

    opens = body.rlike(r'^\s*+[\[{"\-0-9tfnNI]')
    walked = _json_leaves(F.when(opens, body))
    return F.coalesce(walked, query_pairs(body), F.array().cast("array<struct<name:string,value:string>>"))
