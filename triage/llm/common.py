"""What several operators need: tables in the shared folder, connected components, numpy word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.session import shared_dir

#: Rows of one Arrow batch: texts can be long, and a batch is held in memory twice.
BATCH_ROWS = 256
#: A batch ends with the row that takes it over this.
BATCH_BYTES = 4 << 20
#: Bytes hashed at once; a longer word is hashed whole.
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With it set, Spark deletes the shuffle files of a write as the write ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage and survives lost executors.  Its shuffle files go as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def discard(*landed: DataFrame) -> None:
    """Deletes tables of ``land`` that nothing reads any more."""
    for df in landed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.landed_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes, since a row can hold a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): every id with the smallest id reachable. Each round points every node at its smallest
    neighbour, follows the pointers a few steps, and contracts the links; a few rounds suffice for any shape."""
    edges = land(edges.select("a", "b").where("a <> b").distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        to = land(to, "pointers")
        for _ in range(2):
            up = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = land(to.join(up, "p").select("v", F.col("q").alias("p")), "pointers")
        if label is None:
            label = to.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            nxt = to.select(F.col("v").alias("component"), "p")
            label = land(label.join(nxt, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        left, right = to.select(F.col("v").alias("a"), F.col("p").alias("x")), to.select(F.col("v").alias("b"), F.col("p").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = land(edges.distinct(), "links")
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label


# ---- words in numpy ---------------------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[65:91] = True
ALNUM_WORDS[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never crosses a row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = kind[data]
    first = np.empty(len(data), bool)
    first[0] = inside[0]
    first[1:] = inside[1:] & ~inside[:-1]
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased byte ranges that are sorted and don't overlap, block by block."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[to - 1])
        up, down = _powers_to(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[LOWER[data[lo:hi]]] * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; of the whole sequence if it has fewer; none of nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = mix(hashes[: n - k + 1] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * np.uint64(_BASE) + hashes[j : n - k + 1 + j])
    return out


def by_key(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows that share the keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= bool(x[0] != held[-1].column(k)[-1].as_py())
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo in cuts[1:-1] or (lo == 0 and change[0]):
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between numbers below n, as many as connect what they all connect: fewer than n."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for e, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        r, s = root(p), root(q)
        if r != s:
            parent[s] = r
            kept.append(e)
    return i[kept], j[kept]
