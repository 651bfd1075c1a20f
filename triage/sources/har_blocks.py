"""Captures of any size as ``log.entries`` items, read in byte ranges.

The text source deals a file out in splits, here with a comma as the end of a line, so a row is never longer than the longest string between
two commas and no task holds a capture.  A split begins somewhere inside the JSON, so each is looked at up to three times:

1. quotes and brackets are counted, for the case that the split begins inside a string and for the case that it doesn't; the counts of the
   splits before it then tell in which case, and at which depth, it begins;
2. with that known, it is followed where it enters and leaves ``log`` and ``entries``, for each of the three places in which it may begin;
3. with that known too, the items are cut out; one that goes over the end of a split is put together from its pieces.

Captures of one split (most) begin at a known place and are only looked at for the third.  All sums are over the splits of one file: as many
rows as a file has splits.  ``log`` and ``entries`` must be written without escapes; of two lists named so the items follow each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a split may begin: elsewhere, inside the log object, inside its list of entries.
ELSEWHERE, LOG, ENTRIES = 0, 1, 2

_QUOTE, _BACKSLASH, _COMMA = 34, 92, 44
_OPEN, _CLOSE = (123, 91), (125, 93)


def _marks(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets and commas outside strings, how each changes the depth, and whether the text ends inside a string.

    A text begins behind a comma or at the start of a file, so no backslash of before counts.
    """
    data = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(data == _QUOTE)
    if len(quotes) and (data == _BACKSLASH).any():
        plain = np.maximum.accumulate(np.where(data != _BACKSLASH, np.arange(len(data)), -1))
        run = np.where(quotes > 0, quotes - 1 - plain[np.maximum(quotes - 1, 0)], 0)
        quotes = quotes[run % 2 == 0]
    kind = np.zeros(256, np.int8)
    kind[list(_OPEN)], kind[list(_CLOSE)], kind[_COMMA] = 1, -1, 2
    at = np.flatnonzero(kind[data])
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    step = kind[data[at]]
    return at, np.where(step == 2, 0, step), bool((len(quotes) + inside) % 2)


def _named(text: bytes, at: int, name: bytes) -> bool:
    """Whether the value that begins at a place is that of this key."""
    end = text.rfind(b'"', 0, at)
    start = end - len(name) - 1
    return (start >= 0 and text[end + 1 : at].strip() == b":" and text[start : end] == b'"' + name
            and not text[max(0, start - 1) : start] == b"\\")


class Block:
    """What is followed through one split from a known state on."""

    def __init__(self, inside: bool, depth: int, place: int, begun: int) -> None:
        self.inside, self.depth, self.place, self.begun = inside, depth, place, begun
        self.held: list[bytes] = []  # of the item that is open
        self.first_here = False  # whether it began in this split
        self.lists = 0
        self.lowest = depth
        self.ended = False
        self.junk = False

    def read(self, text: bytes) -> Iterator[tuple[int, bool, bytes]]:
        """Items that end in the text: (number, whether it began in this split, bytes of it in this split)."""
        at, step, inside = _marks(text, self.inside)
        depths = self.depth + np.cumsum(step)
        if len(depths):
            self.lowest = min(self.lowest, int(depths.min()))
        look = np.flatnonzero(((step == 1) & (depths <= 3)) | ((step == -1) & (depths <= 2)) | ((step == 0) & (depths == 3)))
        start = 0
        if self.ended and text.strip(b" \t\r\n,"):
            self.junk = True
        for i in look.tolist():
            pos, depth, move = int(at[i]), int(depths[i]), int(step[i])
            if move == 1 and depth == 2:
                self.place = LOG if text[pos] == _OPEN[0] and _named(text, pos, b"log") else ELSEWHERE
            elif move == 1 and depth == 3 and self.place == LOG and text[pos] == _OPEN[1] and _named(text, pos, b"entries"):
                self.place, start, self.first_here = ENTRIES, pos + 1, True
                self.lists += 1
                self.begun += 1
                self.held = []
            elif self.place == ENTRIES and (move == 0 or (move == -1 and depth == 2)):
                yield self.begun - 1, self.first_here, b"".join([*self.held, text[start:pos]])
                start, self.held, self.first_here = pos + 1, [], True
                if move == 0:
                    self.begun += 1
                else:
                    self.place = LOG
            elif move == -1 and depth <= 1:
                self.place = ELSEWHERE
                if depth == 0:
                    self.ended = True
                    self.junk |= bool(text[pos + 1 :].strip(b" \t\r\n,"))
        if self.place == ENTRIES:
            self.held.append(text[start:])
        self.inside, self.depth = inside, self.depth + int(step.sum())


def _bytes(size: str) -> int:
    """A size of the configuration, such as 4MB or 134217728b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _never_cut(spark: SparkSession) -> int:
    """Files of up to so many bytes are one split, whatever else is read."""
    return min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.har").load(path)
    return listed.select(F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("bytes"))


def _segments(spark: SparkSession, path: str, large: bool) -> DataFrame:
    """(source_file, block, value): what stands between commas, in order, by splits of the files above or up to the size never cut."""
    size, limit = F.col("_metadata.file_size"), _never_cut(spark)
    rows = spark.read.option("lineSep", ",").option("recursiveFileLookup", True).option("pathGlobFilter", "*.har").text(path)
    return rows.where(size > limit if large else size <= limit).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes | None]]:
    """Texts of (file, block, state…) in order; None at the end of each block."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_pylist() for c in batch.schema.names if c != "value"]
        values = batch.column("value")
        edges = [i for i in range(batch.num_rows) if i == 0 or any(k[i] != k[i - 1] for k in keys)]
        for lo, hi in zip(edges, [*edges[1:], batch.num_rows]):
            key = tuple(k[lo] for k in keys)
            if now is not None and key != now:
                yield now, None
            now = key
            yield key, b",".join([*(v.as_buffer() for v in values[lo:hi]), b""])
    if now is not None:
        yield now, None


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[] for _ in schema], schema.types)], schema=schema)


_COUNTS = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("odd", pa.bool_()), ("out", pa.int64()), ("within", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes (odd or even) and change of depth of each split, for both cases."""
    odd, out, within = False, 0, 0
    for key, text in _blocks(batches):
        if text is None:
            yield _frame([(*key, odd, out, within)], _COUNTS)
            odd, out, within = False, 0, 0
            continue
        for case in (False, True):
            _, step, ends = _marks(text, odd ^ case)
            if case:
                within += int(step.sum())
            else:
                out, after = out + int(step.sum()), ends
        odd = after


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of the splits of a file: whether each begins inside a string, and its depth there."""
    blocks = blocks.sort_values("block")
    inside, depth, rows = False, 0, []
    for b in blocks.itertuples(index=False):
        rows.append((b.source_file, b.block, inside, depth))
        depth += b.within if inside else b.out
        inside ^= b.odd
    return pd.DataFrame(rows, columns=["source_file", "block", "inside", "depth"])


_FOLLOWED = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()),
                       ("ends", pa.list_(pa.int32())), ("begun", pa.list_(pa.int64()))])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for each place in which it may begin: the place in which it ends, and how many items begin in it."""
    cases: list[Block] = []
    for key, text in _blocks(batches):
        _, _, inside, depth = key
        if text is None:
            yield _frame([(*key, [c.place for c in cases], [c.begun for c in cases])], _FOLLOWED)
            cases = []
            continue
        cases = cases or [Block(inside, depth, place, 0) for place in (ELSEWHERE, LOG, ENTRIES)]
        for c in cases:
            for _ in c.read(text):
                pass
            c.held = []


def _places(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("block")
    place, begun, rows = ELSEWHERE, 0, []
    for b in blocks.itertuples(index=False):
        rows.append((b.source_file, b.block, b.inside, b.depth, place, begun))
        place, begun = int(b.ends[place]), begun + int(b.begun[place])
    return pd.DataFrame(rows, columns=["source_file", "block", "inside", "depth", "place", "begun"])


_STATE = "inside boolean, depth long, place int, begun long"
_ITEM = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("entry_idx", pa.int64()), ("whole", pa.bool_()), ("item", pa.binary()),
                   ("end", pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("lowest", pa.int64()), ("lists", pa.int64()), ("junk", pa.bool_()), ("opens", pa.string())]))])
_ITEM_SQL = ("source_file string, block long, entry_idx long, whole boolean, item binary, "
             "end struct<inside:boolean,depth:bigint,lowest:bigint,lists:bigint,junk:boolean,opens:string>")


def _cut(parts: bool, texts: bool):
    """Items (or, with ``parts``, only the pieces of those that go over an end), and a last row for each split with how it ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, opens = None, ""
        for key, text in _blocks(batches):
            name, number, inside, depth, place, begun = key
            if text is None:
                rows = [(name, number, block.begun - 1, False, b"".join(block.held), None)] if block.place == ENTRIES and parts else []
                end = {"inside": block.inside, "depth": block.depth, "lowest": block.lowest, "lists": block.lists, "junk": block.junk, "opens": opens}
                yield _frame([*rows, (name, number, None, None, None, end)], _ITEM)
                block, opens = None, ""
                continue
            block = block or Block(inside, depth, place, begun)
            if not opens:
                opens = text.lstrip(b" \t\r\n")[:1].decode("latin-1").replace(",", "")
            found = [(name, number, i, first, item if texts else b"", None) for i, first, item in block.read(text) if first != parts]
            if not texts:
                block.held = []
            if found:
                yield _frame(found, _ITEM)

    return run


def _known(segments: DataFrame) -> DataFrame:
    """Of files of one split: they begin outside any string, at depth 0."""
    return segments.select("source_file", "block", F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.lit(ELSEWHERE).alias("place"),
                           F.lit(0).cast("long").alias("begun"), "value")


def _states(segments: DataFrame) -> DataFrame:
    """The state in which each split of large files begins: one row a split."""
    counted = segments.mapInArrow(_count, "source_file string, block long, odd boolean, out long, within long")
    starts = counted.groupBy("source_file").applyInPandas(_starts, "source_file string, block long, inside boolean, depth long")
    followed = segments.join(F.broadcast(starts), ["source_file", "block"]).select("source_file", "block", "inside", "depth", "value").mapInArrow(
        _follow, "source_file string, block long, inside boolean, depth long, ends array<int>, begun array<long>")
    return followed.groupBy("source_file").applyInPandas(_places, f"source_file string, block long, {_STATE}")


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source_file, entry_idx, item): the text of every ``log.entries`` item; and (source_file, reason): what is wrong with the frame of
    a capture, null if nothing is.

    The states of the splits of large captures, one row for every ``spark.sql.files.maxPartitionBytes`` read, are broadcast.
    """
    files = _files(spark, path)
    small = _known(_segments(spark, path, large=False))
    items = small.mapInArrow(_cut(False, True), _ITEM_SQL).where("item is not null").select("source_file", "entry_idx", "item")
    ends = small.mapInArrow(_cut(False, False), _ITEM_SQL).where("end is not null")
    if not files.where(F.col("bytes") > _never_cut(spark)).isEmpty():
        texts = _segments(spark, path, large=True)
        known = texts.join(F.broadcast(_states(texts)), ["source_file", "block"]).select(
            "source_file", "block", "inside", "depth", "place", "begun", "value")
        whole = known.mapInArrow(_cut(False, True), _ITEM_SQL).where("item is not null").select("source_file", "entry_idx", "item")
        pieces = known.mapInArrow(_cut(True, True), _ITEM_SQL).where("item is not null")
        joined = pieces.groupBy("source_file", "entry_idx").agg(F.array_sort(F.collect_list(F.struct("block", "item"))).alias("p"))
        joined = joined.select("source_file", "entry_idx", F.expr("aggregate(p, cast('' as binary), (s, x) -> s || x.item)").alias("item"))
        items = items.unionByName(whole).unionByName(joined)
        ends = ends.unionByName(known.mapInArrow(_cut(False, False), _ITEM_SQL).where("end is not null"))
    frames = ends.groupBy("source_file").agg(
        F.max(F.struct("block", "end.inside", "end.depth")).alias("last"), F.min(F.struct("block", "end.opens")).alias("first"),
        F.min("end.lowest").alias("lowest"), F.sum("end.lists").alias("lists"), F.max("end.junk").alias("junk"))
    c = F.col
    reason = (F.when(c("first").isNull() | (c("first.opens") == ""), F.lit("HAR file is empty"))
              .when(c("last.inside") | (c("last.depth") != 0) | (c("lowest") < 0) | c("junk"), F.lit("Invalid JSON in HAR file"))
              .when(c("first.opens") != "{", F.lit("HAR root must be a JSON object"))
              .when(c("lists") == 0, F.lit("HAR must contain a log.entries list")))
    items = items.withColumn("item", F.btrim(c("item").cast("string"), F.lit(" \t\r\n"))).where("item <> '' or entry_idx > 0")
    return items, files.join(frames, "source_file", "left").select("source_file", reason.alias("reason"))
