"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised in Arrow batches and cut into pieces of at most one sequence.  Only the histogram of piece lengths (one count
per length, so at most ``size`` numbers) reaches the driver, which places lengths longest first into the open pattern with the
shortest fitting rest and splits pattern counts as they fill.  Patterns come back to the pieces by rank: the r-th piece of a length
takes the r-th slot of that length.  Ranks are counted in salted groups, so a length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triage.llm.common import land, small_batches

SIZE = 2048
END_ID = 1
_held: dict[str, tuple] = {}


def _encoder(path: str):
    """Ids of the byte-level vocabulary in a tokenizer file: a rank encoder made from that file (several times faster), and the
    file's own tokenizer for the texts that hold one of its special strings."""
    if path not in _held:
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        code = _byte_letters()
        ranks = {bytes(code[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _held[path] = fast, Tokenizer.from_file(path), special
    return _held[path]


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a text (null: none), without special tokens added, as unsigned 32-bit numbers."""
    fast, own, special = _encoder(path)
    if not text:
        return np.empty(0, np.uint32)
    if any(s in text for s in special):
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
           end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; a document has one more id (``end_id``) than its text.

    Null and empty texts are the end id alone.  Rows with a null id have pieces with a null id, and repeated rows each their own.  A very
    long text is encoded whole and gives as many pieces as it needs.  An empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(t, tokenizer), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((d, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Packing patterns (how often, lengths) that use every piece exactly once.

    Lengths go longest first.  Each takes the open pattern whose rest is the smallest that still fits; as many of its copies as there
    are pieces are split off as a new pattern.  Without a fitting pattern it opens one.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    rests: list[int] = []
    done: list[tuple[int, list[int]]] = []

    def put(rest: int, pattern: tuple[int, list[int]]) -> None:
        if rest == 0:
            done.append(pattern)
            return
        if rest not in open_:
            open_[rest] = []
            insort(rests, rest)
        open_[rest].append(pattern)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rests, length)
            if k == len(rests):
                put(size - length, (left, [length]))
                left = 0
                continue
            rest = rests[k]
            n, held = open_[rest].pop()
            if not open_[rest]:
                del open_[rest]
                rests.pop(k)
            each = min(n, left)
            if n > each:
                put(rest, (n - each, held))
            put(rest - length, (each, [*held, length]))
            left -= each
    return done + [p for own in open_.values() for p in own]


def pack(parts: DataFrame, *, size: int = SIZE, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (needs doc_id, start and length from 1 to ``size``).

    Sequence ids run gapless from 0, offsets gapless within a sequence.  Repeated rows are packed as separate pieces; an empty table
    gives an empty result; other columns stay.
    """
    spark = parts.sparkSession
    parts = land(parts.drop("sequence_id", "offset"), "pieces")
    salts = salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    groups = groups.withColumn("__before", F.sum("n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: rank from which it holds, first sequence, offset
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for n, lengths in pack_histogram(histogram, size):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "__rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, at = tables.value[int(n)], np.flatnonzero(length == n)
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                seq[at], off[at] = own[k, 1] + rank[at] - own[k, 0], own[k, 2]
            names = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    number = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start"))
    ranked = (salted.withColumn("__rank", number).join(groups.drop("n"), ["length", "__salt"])
              .withColumn("__rank", (F.col("__rank") - 1 + F.coalesce("__before", F.lit(0))).cast("long")))
    ranked = ranked.select(*parts.columns, "__rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
