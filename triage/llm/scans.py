"""Running counts, sums and sequence hashes over a key's ordered rows, however many rows a key has.

Rows are dealt by ranges of (key, order), so the rows of a hot key lie in several tasks.  Each task scans its range on its own; the state in
which each range ends (one row a range) is carried over on the driver; then the rows that go on a key of an earlier range are corrected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import land

#: Sequence hashes are polynomials over this prime (2**127 - 1), in a base without structure.
PRIME = (1 << 127) - 1
BASE = 0x2B7E151628AED2A6ABF7158809CF4F3C % PRIME
#: The hash of the empty sequence.
EMPTY = bytes(16)

_ADDED = T.StructType().add("pid", "integer").add("at", "long").add("head", "boolean").add("n", "long").add("before", "binary").add("h", "binary").add("total", "long")


def _number(x: bytes | None) -> int:
    return int.from_bytes(x, "big") % PRIME if x is not None else 0


def scan(rows: DataFrame, key: str, order: list[Column], *, token: str | None = None, value: str | None = None) -> DataFrame:
    """``rows`` with n (place in the key's order, from 1), h (16 bytes, hash of the tokens up to here), before (h of the row before, or
    EMPTY) and total (sum of the values up to here).  Tokens are binary, the key has no nulls, and rows alike in key, order and token are
    interchangeable.  Columns of these names are replaced.
    """
    rows = rows.drop(*[f.name for f in _ADDED])
    names, schema = rows.columns, T.StructType([*rows.schema, *_ADDED])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, head, last, n, h, total = TaskContext.get().partitionId(), 0, True, None, 0, 0, 0
        for batch in batches:
            size = batch.num_rows
            out: list[list] = [[] for _ in _ADDED]
            tokens = batch.column(token).to_pylist() if token else [None] * size
            values = batch.column(value).to_pylist() if value else [0] * size
            for k, t, v in zip(batch.column(key).to_pylist(), tokens, values):
                if k != last:
                    head, last, n, h, total = last is None, k, 0, 0, 0
                before, n, total, at = h, n + 1, total + (v or 0), at + 1
                h = (h * BASE + _number(t) + 1) % PRIME
                for column, x in zip(out, (pid, at, head, n, before.to_bytes(16, "big"), h.to_bytes(16, "big"), total)):
                    column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x, k) for x, k in zip(out, kinds)]], schema.names)

    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    done = land(dealt.mapInArrow(local, schema), "scan")
    # the last row of every range and the key it begins with: as many rows as ranges
    size = done.groupBy("pid").agg(F.max("at").alias("at"))
    ends = done.join(F.broadcast(size), ["pid", "at"]).select("pid", F.col(key).alias("key"), "head", "n", "h", "total")
    begins = done.where("at = 1").select("pid", F.col(key).alias("first"))
    carried, state, open_key = {}, (0, 0, 0), None
    for r in ends.join(begins, "pid").orderBy("pid").toLocalIterator():
        carry = state if r["first"] == open_key else (0, 0, 0)
        if carry[0]:
            carried[r["pid"]] = carry
        own = (r["n"], int.from_bytes(r["h"], "big"), r["total"])
        state = _joined(carry, own) if r["head"] else own
        open_key = r["key"]
    if not carried:
        return done.drop("pid", "at", "head")

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = {c: batch.column(c).to_pylist() for c in ("n", "before", "h", "total")}
            for i, (pid, head) in enumerate(zip(batch.column("pid").to_pylist(), batch.column("head").to_pylist())):
                if head and pid in carried:
                    carry, n, total = carried[pid], fixed["n"][i], fixed["total"][i]
                    before = _joined(carry, (n - 1, int.from_bytes(fixed["before"][i], "big"), 0))[1]
                    n, h, total = _joined(carry, (n, int.from_bytes(fixed["h"][i], "big"), total))
                    fixed["n"][i], fixed["before"][i], fixed["h"][i], fixed["total"][i] = n, before.to_bytes(16, "big"), h.to_bytes(16, "big"), total
            kinds = {"n": pa.int64(), "before": pa.binary(), "h": pa.binary(), "total": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(fixed[c], kinds[c]) if c in fixed else batch.column(c) for c in schema.names], schema.names)

    return done.mapInArrow(corrected, schema).drop("pid", "at", "head")


def _joined(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """State after b's rows behind a's."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], PRIME) + b[1]) % PRIME, a[2] + b[2]
