"""Near-duplicate vectors by an epsilon grid order join.

Vectors become unit vectors in double precision; cosine >= c means a distance of at most eps = sqrt(2 - 2c).  Equal vectors of a label are one
class.  All vectors are projected on the leading principal directions (from the second moments of all of them, summed by Spark), put in
cells of width eps, and range-sorted by label and cells.  The sorted sequence is cut into blocks of a bounded size with a bounding box each.
Pairs of blocks of a label whose boxes are at most eps apart are read side by side from the shared folder, without a shuffle, so the disk
holds each vector a fixed number of times however many pairs there are.  In the task the two sequences are cut into tiles and these into
runs, skipping those that are provably too far apart; what single precision can't rule out is compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import components, discard, forest, land, small_batches

COSINE = 0.93
DIRECTIONS = 8
#: Vectors of a block at most, and bytes of them in double precision: a task holds two blocks.
BLOCK = 8192
BLOCK_BYTES = 4 << 20
TILE = 512
LEAF = 64
#: Vectors of one Arrow batch.
ROWS = 4096
#: Rounding of projections never hides a pair.
SLACK = 1e-6


def link(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
         directions: int = DIRECTIONS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of every row.

    Rows link when their labels are equal and not null and their cosine in double precision is at least ``cosine``.  Null vectors and ones
    that are empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different dimensions.  n_links counts other
    rows, equal vectors too; component_id is the smallest id reachable.  Rows with a null id link with nothing; an empty table gives an
    empty result.  Rows find their class by 128 bits of the SHA-256 of their numbers.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    small_batches(vectors.sparkSession, ROWS)
    real, kind = ("float", "<f4") if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType()) else ("double", "<f8")
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{real}>").alias("v"),
                           F.col(label).cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    given = given.select("vec_id", "label", F.when(good, F.transform("v", lambda x: x + F.lit(0.0).cast(real))).alias("v"))
    widths = [r.dims for r in given.where("v is not null").select(F.size("v").alias("dims")).distinct().collect()]  # one, but for malformed tables
    if not widths:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            at = (v.offsets.to_numpy().astype(np.int64) * np.dtype(kind).itemsize).astype(np.int32)
            data = np.ascontiguousarray(v.values.to_numpy(zero_copy_only=False).astype(kind))
            x = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), x], names=["vec_id", "label", "x"])

    # the numbers as they were given, without those that link with nothing
    packed = given.mapInArrow(pack, "vec_id long, label string, x binary")
    parts = [_one_width(packed.where(F.octet_length("x") == d * np.dtype(kind).itemsize), d, kind, cosine, eps, min(directions, d), block)
             for d in sorted(widths)]
    edges, links, classes = (reduce(DataFrame.unionAll, tables) for tables in zip(*parts))
    joined = components(edges).select(F.col("id").alias("rep"), "component")
    own = classes.join(joined, "rep", "left").join(links, "rep", "left").select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    key = F.unhex(F.substring(F.sha2("x", 256), 1, 32)).alias("key")
    ids = packed.where(F.octet_length("x") > 0).select("vec_id", "label", key).join(own, ["label", "key"]).select("vec_id", "n_links", "component_id")
    return ids.unionAll(given.where("v is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))


def principal_directions(packed: DataFrame, d: int, kind: str, m: int) -> tuple[np.ndarray, int]:
    """Leading eigenvectors of the second moments of the unit vectors, and their number; d² sums per task are added up by Spark."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = unit(b"".join(batch.column("x").to_pylist()), d, kind)
            total += x.T @ x
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    got = packed.select("x").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((d, d))
    for r in got:
        total[r.i, r.j] = r.s
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1][:, :m], round(np.trace(total))  # each unit vector adds one to the trace


def unit(data: bytes, d: int, kind: str) -> np.ndarray:
    x = np.frombuffer(data, kind).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _one_width(packed: DataFrame, d: int, kind: str, cosine: float, eps: float, m: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (a, b) between representatives, links of each (rep, links), and the classes (rep, copies, label, key) of vectors of one width."""
    spark = packed.sparkSession
    found_axes, rows = principal_directions(packed, d, kind, m)
    axes = spark.sparkContext.broadcast(found_axes)
    block = max(1, min(block, BLOCK_BYTES // (8 * d)))
    classes = packed.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(unit(b"".join(batch.column("x").to_pylist()), d, kind) @ axes.value / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "rep", "copies", "x")), *(pa.array(cells[:, k]) for k in range(m))],
                                             names=["label", "rep", "copies", "x", *(f"c{k}" for k in range(m))])

    cells = [f"c{k}" for k in range(m)]
    placed = classes.select("label", "rep", "copies", "x").mapInArrow(
        project, "label string, rep long, copies long, x binary, " + ", ".join(f"{c} int" for c in cells))
    # as many parts as there are blocks, but some for each core
    parts = max(1, -(-rows // block), min(spark.sparkContext.defaultParallelism, rows // TILE))
    ordered = placed.repartitionByRange(parts, "label", *cells, "rep").sortWithinPartitions("label", *cells, "rep")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "rep", "copies", "x"))):
                if held and (len(held) == block or held[0][0] != row[0]):
                    yield one(held, (part << 32) + count)
                    held, count = [], count + 1
                held.append(row)
        if held:
            yield one(held, (part << 32) + count)

    def one(held: list[tuple], number: int) -> pa.RecordBatch:
        x = b"".join(r[3] for r in held)
        p = unit(x, d, kind) @ axes.value
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([held[0][0]]), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]),
             pa.array([x], pa.binary()), pa.array([np.array([r[1:3] for r in held], np.int64).T.tobytes()], pa.binary())],
            names=["block", "label", "lo", "hi", "x", "ids"])

    cut = land(ordered.mapInArrow(blocks, "block long, label string, lo array<double>, hi array<double>, x binary, ids binary"), "grid-blocks")
    # every task reads a part of the blocks beside another one: a join by key would write the vectors once for every pair
    side = lambda n: cut.select(*[F.col(c).alias(f"{c}{n}") for c in cut.columns])
    gap = F.aggregate(F.zip_with(F.arrays_zip("lo1", "hi1"), F.arrays_zip("lo2", "hi2"), lambda p, q: F.greatest(
        p["lo1"] - q["hi2"], q["lo2"] - p["hi1"], F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = side(1).hint("shuffle_replicate_nl").join(side(2), (F.col("label1") == F.col("label2")) & (F.col("block1") <= F.col("block2")) & (gap <= eps * eps))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, xa, ia, xb, ib in zip(*(batch.column(k).to_pylist() for k in range(6))):
                xs = [unit(v, d, kind) for v in (xa, xb)]
                ids = [np.frombuffer(v, np.int64).reshape(2, -1) for v in (ia, ib)]
                yield from _found(xs, [v @ axes.value for v in xs], ids, a == b, cosine, eps)

    found = land(pairs.select("block1", "block2", "x1", "ids1", "x2", "ids2").mapInArrow(compare, "kind int, a long, b long"), "grid-links")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rep, copies = np.frombuffer(ids, np.int64).reshape(2, -1)
                size = len(x) // len(rep)
                keys = [hashlib.sha256(x[i * size : (i + 1) * size]).digest()[:16] for i in range(len(rep))]
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(copies), pa.array([name] * len(rep), pa.string()), pa.array(keys, pa.binary())],
                                                 names=["rep", "copies", "label", "key"])

    own = land(cut.select("label", "x", "ids").mapInArrow(members, "rep long, copies long, label string, key binary"), "grid-classes")
    discard(cut)
    edges = found.where("kind = 0").select("a", "b").distinct()
    return edges, found.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links")), own


def _boxes(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest coordinates of every ``size`` rows."""
    at = np.arange(0, len(p), size)
    return np.minimum.reduceat(p, at, axis=0), np.maximum.reduceat(p, at, axis=0)


def _near(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], eps: float) -> np.ndarray:
    """Which boxes of two lists are at most eps apart."""
    gap = np.maximum(np.maximum(one[0][:, None] - other[1][None], other[0][None] - one[1][:, None]), 0)
    return (gap * gap).sum(axis=2) <= eps * eps


def _found(xs, ps, ids, same: bool, cosine: float, eps: float) -> Iterator[pa.RecordBatch]:
    """Spanning edges (0, rep, rep) and link counts (1, rep, rows) of two blocks."""
    n, d = xs[0].shape
    small = [x.astype(np.float32) for x in xs]
    least = cosine - (d + 8) * 2.0**-22  # more than a product in single precision can be off
    reps, copies = ids[0] if same else np.concatenate(ids, axis=1)
    count, kept = np.zeros(len(reps)), []

    def close(a0: int, a1: int, b0: int, b1: int, hits: list) -> None:
        may = small[0][a0:a1] @ small[1][b0:b1].T >= least
        i = np.flatnonzero(may.any(axis=1))
        if not len(i):
            return
        j = np.flatnonzero(may.any(axis=0))
        p, q = np.nonzero(xs[0][a0 + i] @ xs[1][b0 + j].T >= cosine)
        i, j = a0 + i[p], b0 + j[q]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            hits.append((i, j if same else j + n))

    tiles, runs = [_boxes(p, TILE) for p in ps], [_boxes(p, LEAF) for p in ps]
    each = TILE // LEAF
    for s, t in np.argwhere(_near(*tiles, eps)):
        if same and s > t:
            continue
        a0, b0 = s * TILE, t * TILE
        a1, b1 = min(a0 + TILE, n), min(b0 + TILE, len(xs[1]))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        inside = _near(*([bound[k * each : (k + 1) * each] for bound in box] for box, k in zip(runs, (s, t))), eps)
        if 2 * inside.sum() > inside.size:
            close(a0, a1, b0, b1, hits)
        else:
            for p, q in np.argwhere(inside):
                a, b = a0 + p * LEAF, b0 + q * LEAF
                close(a, min(a + LEAF, a1), b, min(b + LEAF, b1), hits)
        if hits:
            i, other = (np.concatenate(v) for v in zip(*hits))
            count += np.bincount(i, copies[other], len(reps)) + np.bincount(other, copies[i], len(reps))
            kept.append(forest(i, other, len(reps)))  # fewer links than rows, however many the tile has
    if not kept:
        return
    i, j = (np.concatenate(v) for v in zip(*kept))
    p, q = forest(i, j, len(reps))
    a, b = reps[p], reps[q]
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], [len(a), len(at)]).astype(np.int32)), pa.array(np.append(a, reps[at])),
         pa.array(np.append(b, count[at].astype(np.int64)))], names=["kind", "a", "b"])
