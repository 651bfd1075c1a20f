"""Benchmark decontamination with an FM-index per shard of training text.

Each task cuts its rows into shards of a fixed number of bytes.  Words that occur in no benchmark item can be part of no match, so a
shard is first reduced to its runs of known words that are long enough to hold a window.  Over these runs it builds a suffix array,
the Burrows-Wheeler transform and a wavelet matrix; all windows are searched backwards through its ranks, and the occurrences are
located by walking to sampled suffix positions.  Matches become word spans, merged per document.  Nothing is shuffled.

Items go to the tasks in blocks of at most ``block_bytes`` of text (measured, not assumed); more items mean more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import ALNUM_WORDS, hash_ranges, small_batches, text_bytes, words

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
SAMPLE = 16

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("word_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("byte_spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


class Windows:
    """The distinct windows of some items as rows of word numbers, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends = words(data, offsets, ALNUM_WORDS)
        hashes = hash_ranges(data, starts, ends)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        first = np.searchsorted(starts, offsets)
        names = sorted({i for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(names)}
        self.items = names
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (name, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]]
            if len(own):
                n = min(size, len(own))
                got = np.lib.stride_tricks.sliding_window_view(own, n)
                rows.setdefault(n, []).append(got)
                owners.setdefault(n, []).append(np.full(len(got), number.get(name, -1)))
        self.lengths, self.patterns, self.owner_start, self.owner = sorted(rows), {}, {}, {}
        for n in self.lengths:
            distinct, which = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            owner = np.concatenate(owners[n])
            order = np.lexsort((owner, which.ravel()))
            self.patterns[n] = distinct
            self.owner[n] = owner[order]
            self.owner_start[n] = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))

    def owners_of(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its items: positions in ``which``, item numbers."""
        lo, hi = self.owner_start[n][which], self.owner_start[n][which + 1]
        at, index = expand(lo, hi)
        return at, self.owner[n][index]


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), with the range each is from."""
    n = hi - lo
    at = np.repeat(np.arange(len(lo)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[at]


class FMIndex:
    """Over a sequence of symbols 1, 2, …; 0 ends it."""

    def __init__(self, symbols: np.ndarray) -> None:
        text = np.append(symbols, 0).astype(np.int64)
        self.n = n = len(text)
        order = suffix_array(text)
        self.bits = max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.bits)))])
        level = text[order - 1]
        self.ranks, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (level >> bit) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        begin = np.zeros(1 << self.bits, np.int64)
        self.begin = self._descend(np.arange(1 << self.bits), begin)
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)])
        self.kept = order[sampled]

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = self.ranks[level][i]
            i = np.where((c >> bit) & 1, self.zeros[level] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before row i of the transform."""
        return self._descend(c, i) - self.begin[c]

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            before = self.ranks[level][i]
            bit = self.ranks[level][i + 1] - before
            c = c * 2 + bit
            i = np.where(bit == 1, self.zeros[level] + before, i - before)
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which patterns occur, and their rows [lo, hi), by backward search of all at once."""
        alive, lo, hi = np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        known = (patterns < (1 << self.bits)).all(axis=1)
        alive, lo, hi = alive[known], lo[known], hi[known]
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            found = lo < hi
            alive, lo, hi = alive[found], lo[found], hi[found]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            hit = self.marks[at + 1] > self.marks[at]
            out[open_[hit]] = self.kept[self.marks[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; after the first rounds only suffixes that still tie are sorted again."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    rank = np.searchsorted(rank[order], rank)  # the first row of its group
    step, groups = 1, None
    while True:
        ranked = rank[order]
        head = np.append(True, ranked[1:] != ranked[:-1])
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        rows = np.flatnonzero(tied)
        own = order[rows]
        second = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], -1)
        by = np.lexsort((second, rank[own]))
        own, second = own[by], second[by]
        order[rows] = own
        base = rank[own]
        new = np.append(True, (base[1:] != base[:-1]) | (second[1:] != second[:-1]))
        rank[own] = rows[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        step *= 2


def shard_hits(data: np.ndarray, offsets: np.ndarray, wanted: Windows) -> list[dict]:
    """One HITS value per row of a shard."""
    starts, ends = words(data, offsets, ALNUM_WORDS)
    docs = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(docs, minlength=len(offsets) - 1)
    first_word = np.cumsum(n_words) - n_words
    covered = np.zeros(len(starts) + 1, np.int64)
    pairs: list[np.ndarray] = []
    if len(starts) and len(wanted.vocabulary):
        hashes = hash_ranges(data, starts, ends)
        ids = np.searchsorted(wanted.vocabulary, hashes)
        ids[ids == len(wanted.vocabulary)] = 0
        known = wanted.vocabulary[ids] == hashes
        # runs of known words within a document, long enough for the shortest window
        begins = known & np.append(True, ~known[:-1] | (docs[1:] != docs[:-1]))
        stops = known & np.append(~known[1:] | (docs[1:] != docs[:-1]), True)
        lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long_enough = hi - lo >= wanted.lengths[0]
        lo, hi = lo[long_enough], hi[long_enough]
        if len(lo):
            # symbol 1 stands between runs, words follow from 2
            size = hi - lo + 1
            at = np.cumsum(size) - size
            _, source = expand(lo, hi)
            place = np.arange(size.sum())
            gap = at + size - 1
            inside = np.ones(len(place), bool)
            inside[gap] = False
            symbols = np.ones(len(place), np.int64)
            symbols[inside] = ids[source] + 2
            word_of = np.zeros(len(place), np.int64)
            word_of[inside] = source
            index = FMIndex(symbols)
            for n in wanted.lengths:
                which, a, b = index.search(wanted.patterns[n] + 2)
                if not len(which):
                    continue
                found, rows = expand(a, b)
                begin = word_of[index.locate(rows)]
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + n, -1)
                pair = np.unique(np.stack([docs[begin], which[found]]), axis=1)
                k, owner = wanted.owners_of(n, pair[1])
                pairs.append(np.stack([pair[0][k], owner]))
    hit = np.cumsum(covered[:-1]) > 0
    n_hit = np.bincount(docs[hit], minlength=len(n_words))
    items: dict[int, list[str]] = {}
    if pairs:
        for d, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            if i >= 0:
                items.setdefault(d, []).append(wanted.items[i])
    begins = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (docs[1:] != docs[:-1]))) if len(hit) else np.empty(0, np.int64)
    stops = np.flatnonzero(hit & np.append(~hit[1:] | (docs[1:] != docs[:-1]), True)) if len(hit) else begins
    spans: dict[int, tuple[list, list]] = {}
    for a, b in zip(begins.tolist(), stops.tolist()):
        d = int(docs[a])
        own = spans.setdefault(d, ([], []))
        own[0].append([a - int(first_word[d]), b + 1 - int(first_word[d])])
        own[1].append([int(starts[a] - offsets[d]), int(ends[b] - offsets[d])])
    return [{"n_words": int(n), "n_hit": int(n_hit[d]), "items": items.get(d, []), "word_spans": spans.get(d, ([], []))[0],
             "byte_spans": spans.get(d, ([], []))[1]} for d, n in enumerate(n_words.tolist())]


def find_hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              size: int = 10, into: str = "hits", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row of ``docs`` with its columns and a struct ``into``: n_words, n_hit, items (ids as text, sorted), word_spans and
    byte_spans (merged ranges [start, end) of words, and of bytes of the UTF-8 text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.  An item with fewer than ``size`` words is one
    window; without words (or null) it matches nothing.  Null and empty texts have no words and no hits.  Items repeated under one id
    count once; hits of an item whose id is null count as hits, but are listed nowhere.  Without items nothing is hit; an empty table gives an
    empty one.  Words are told apart by 64-bit hashes.  A column already named ``into`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    docs = docs.drop(into)
    out = docs
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    parts = [f"{into}__{b}" for b in range(blocks)]
    for b, name in enumerate(parts):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        wanted = spark.sparkContext.broadcast(Windows([(r.i, r.t) for r in own.where("t is not null").collect()], size))
        out = _scan(out, text, name, wanted, shard_bytes)
    if blocks == 1:
        return out.withColumnRenamed(parts[0], into)
    joined = lambda field: F.flatten(F.array(*[F.col(f"{p}.{field}") for p in parts]))
    words_ = F.expr(_MERGED.format(spans="__w"))
    out = out.withColumn("__w", joined("word_spans")).withColumn("__b", joined("byte_spans")).withColumn("__m", words_)
    return out.withColumn(into, F.struct(
        F.col(f"{parts[0]}.n_words").alias("n_words"), F.expr("aggregate(__m, 0L, (n, s) -> n + s[1] - s[0])").alias("n_hit"),
        F.array_sort(F.array_distinct(joined("items"))).alias("items"), F.col("__m").alias("word_spans"),
        F.expr(_MERGED.format(spans="__b")).alias("byte_spans"))).drop("__w", "__b", "__m", *parts)


#: Merges overlapping ranges of a list.
_MERGED = """aggregate(array_sort({spans}), cast(array() as array<array<bigint>>), (out, s) ->
    case when size(out) = 0 or element_at(out, -1)[1] < s[0] then concat(out, array(s))
    else concat(slice(out, 1, size(out) - 1), array(array(element_at(out, -1)[0], greatest(element_at(out, -1)[1], s[1])))) end)"""


def _scan(docs: DataFrame, text: str, into: str, wanted, shard_bytes: int) -> DataFrame:
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("word_spans", pa.list_(pa.list_(pa.int64()))), ("byte_spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(text).nbytes
            if size >= shard_bytes:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        column = whole.column(text)
        data, offsets = text_bytes(pa.concat_arrays(column.chunks))
        hits = pa.array(shard_hits(data, offsets, wanted.value), kind)
        yield from whole.append_column(into, hits).to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, HITS)]))


def without_spans(hits: DataFrame, *, text: str = "text", into: str = "hits") -> DataFrame:
    """The same rows with the hit spans cut out of the text."""
    small_batches(hits.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, h in zip(batch.column(text).to_pylist(), batch.column(into).to_pylist()):
                if t is not None and h and h["byte_spans"]:
                    raw, out, at = t.encode(), [], 0
                    for lo, hi in h["byte_spans"]:
                        out.append(raw[at:lo])
                        at = hi
                    t = b"".join([*out, raw[at:]]).decode()
                kept.append(t)
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(kept, batch.schema.field(k).type))

    return hits.mapInArrow(run, hits.schema)
