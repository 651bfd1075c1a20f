"""Exact substring dedup by difference-cover suffix sorting, spread over tasks by content.

1. Equal texts are one text; later ones repeat the first whole.
2. Of every window of ``length`` bytes the gram of GRAM bytes with the smallest hash is its minimizer.  Equal windows have equal minimizers, so
   only minimizers that two texts share can lie in a repeat (about one row for 14 bytes is shuffled, without text).
3. Of the surroundings of shared minimizers first only hashes are dealt out, by minimizer.  Surroundings that an earlier document has whole are
   decided by that; the middle of a long repeat ends here.
4. Where a minimizer has different surroundings, the first document of each sends its bytes, dealt out by minimizer: all equal windows meet in one
   task.  There, of surroundings with a window whose hash occurs twice, the suffixes are sorted by the difference-cover method: triples at two of three positions are sorted and named, the
   names are sorted recursively, the remaining suffixes are sorted by one symbol and a name and merged in; then prefixes of adjacent
   suffixes are compared over ``length`` bytes, and the smallest id of each run of equal ones decides.
5. Removed windows become spans of each document.

Texts are written once, bucketed by id and hash, and every join with them has just these two as its keys, so that none shuffles a text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import _BYTE, _powers_to, land, mix, small_batches, text_bytes

LENGTH = 50
GRAM = 24
#: Bytes of a text looked at together, and of surroundings sorted together (a minimizer's distinct surroundings are never parted).
PIECE = 1 << 19
#: Most rows of these streams are a few numbers; texts are bounded by bytes.
BATCH_ROWS = 8192
SORTED = 1 << 20


def minimizers(raw: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, last window) for each run of windows that have the same minimizer, piece by piece of a text."""
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        part = raw[at : at + PIECE + length - 1]
        up, down = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        n = len(part) - gram + 1
        h = mix((sums[gram:] - sums[:n]) * down[:n])
        low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        place = (low & np.uint64(0xFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        yield (h[place[heads]] >> np.uint64(16)).astype(np.int64), heads + at, np.append(heads[1:], len(place)) - 1 + at


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of positive symbols below 2²¹, or below 2³¹ for a million and more, by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    padded = np.append(t.astype(np.int64), [0, 0, 0, 0])
    # the sample also has the empty suffix where n is 1 modulo 3, so that its two parts stay apart
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.append(one, two)
    if n >= 1 << 20:  # pairs are named first, so that three symbols fit 64 bits
        pair = np.append(np.unique((padded[:-1] << 32) | padded[1:], return_inverse=True)[1], 0)
    else:
        pair = (padded << 21) | np.append(padded[1:], 0)
    shift = 32 if n >= 1 << 20 else 21
    triple = (pair[sample] << shift) | padded[sample + 2]
    values, names = np.unique(triple, return_inverse=True)
    if len(values) == len(sample):
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_order(names + 1)
    order = sample[order]
    order = order[order < n]
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rest = np.arange(0, n, 3)
    by_one = (padded[rest] << 32) | rank[rest + 1]
    turn = np.argsort(by_one, kind="stable")
    rest, by_one = rest[turn], by_one[turn]
    by_two = (pair[rest] << shift) | rank[rest + 2]
    # merged by counting, for each of the rest, the sampled suffixes before it, and the other way round
    own = order[order % 3 == 1]
    key_one = (padded[own] << 32) | rank[own + 1]
    other = order[order % 3 == 2]
    key_two = (pair[other] << shift) | rank[other + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + np.searchsorted(key_one, by_one) + np.searchsorted(key_two, by_two)] = rest
    out[rank[own] - 1 + np.searchsorted(by_one, key_one)] = own
    out[rank[other] - 1 + np.searchsorted(by_two, key_two)] = other
    return out


def earliest(contexts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each context, the smallest id of a context that has an equal window."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = raw.astype(np.int64) + 1
    ends = begin + sizes
    text[ends] = 257 + np.arange(len(contexts))  # each ends with a symbol of its own
    order = suffix_order(text)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    order = order[order + length <= ends[owner[order]]]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        same[at:to] = (views[order[at:to]] == views[order[at - 1 : to - 1]]).all(axis=1)
    heads = np.flatnonzero(~same)
    low = np.minimum.reduceat(docs[owner[order]], heads) if len(heads) else np.empty(0, np.int64)
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return [first[b : b + n - length + 1] for b, n in zip(begin, sizes)]


def may_repeat(contexts: list[bytes], length: int) -> np.ndarray:
    """Which contexts have a window whose hash another window has: equal windows have equal hashes, so the rest repeat nothing."""
    sizes = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    up, down = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    windows = sizes - length + 1
    begin = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) + np.repeat(np.cumsum(sizes) - sizes - begin, windows)
    hashes = (sums[at + length] - sums[at]) * down[at]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return np.logical_or.reduceat(twice, begin)


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text and spans (sorted, disjoint byte ranges [start, end) to remove) of every row of ``docs``.

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller id; strings are judged on the input.  Null and
    short texts keep everything.  Rows that share an id are no repeats of one another; rows with a null id keep all their bytes and
    are no one's repeat.  Minimizers are compared by 48 bits of a hash, which only ever adds work; windows are compared byte by byte, equal whole
    texts and equal surroundings of one minimizer by a 64-bit hash and their length.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=BATCH_ROWS)
    name = f"texts_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"),
                F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("n")).write.bucketBy(buckets, "doc_id", "digest").saveAsTable(name)
    texts = spark.table(name)
    firsts = land(texts.where(f"doc_id is not null and n >= {length}").groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id")), "firsts")
    key = ["doc_id", "digest"]
    first = texts.join(firsts.hint("merge"), key, "left_semi").select("doc_id", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            hashes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                found = [h for h, _, _ in minimizers(data[offsets[i] : offsets[i + 1]], length, gram)]
                if found:
                    hashes.append(np.unique(np.concatenate(found)))
                    ids.append(np.full(len(hashes[-1]), d))
            yield _batch(("h", hashes), ("doc_id", ids))

    rows = first.mapInArrow(grams, "h long, doc_id long")
    shared = rows.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_shared, "h long, doc_id long")
    # the hash follows from the id but where ids repeat, so it is not shuffled with the grams
    wanted = shared.groupBy("doc_id").agg(F.collect_set("h").alias("wanted")).join(firsts.select(*key).hint("merge"), "doc_id")
    wanted = land(wanted, "shared-grams")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 6]
            for i, (d, g, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*key, "wanted")))):
                raw, w = data[offsets[i] : offsets[i + 1]], np.sort(np.array(w, np.int64))
                for h, lo, hi in minimizers(raw, length, gram):
                    k = w[np.minimum(np.searchsorted(w, h), len(w) - 1)] == h
                    h, lo, hi = h[k], lo[k], hi[k] + length
                    out.append((h, _range_hashes(raw, lo, hi), np.full(len(h), d), lo, hi - lo, np.full(len(h), g)))
            h, around_, ids, at, n, digest = zip(*out)
            yield _batch(("h", h), ("around", around_), ("doc_id", ids), ("at", at), ("n", n, np.int32), ("digest", digest))

    marked = texts.select(*key, "text").join(wanted.hint("merge"), key)
    spread = marked.mapInArrow(around, "h long, around long, doc_id long, at long, n int, digest long").repartition("h").sortWithinPartitions(
        "h", "around", "doc_id", "at")
    seen = land(spread.mapInArrow(_seen, "h long, doc_id long, at long, digest long, n int, gone boolean"), "repeat-seen")

    open_ = seen.where("not gone").groupBy(*key).agg(F.collect_list(F.struct("h", "at", "n")).alias("open"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, (d, g, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*key, "open")))):
                raw = data[offsets[i] : offsets[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o["h"] for o in own], pa.int64()), pa.array([d] * len(own), pa.int64()), pa.array([g] * len(own), pa.int64()),
                     pa.array([o["at"] for o in own], pa.int64()),
                     pa.array([raw[o["at"] : o["at"] + o["n"]].tobytes() for o in own], pa.binary())], names=["h", "doc_id", "digest", "at", "around"])

    told = texts.select(*key, "text").join(open_.hint("merge"), key).mapInArrow(
        contexts, "h long, doc_id long, digest long, at long, around binary")
    judged = told.repartition("h").sortWithinPartitions("h").mapInArrow(_judge(length), "doc_id long, digest long, lo long, hi long")
    runs = land(judged, "repeat-runs").unionAll(seen.where("gone").select(*key, F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi")))
    runs = runs.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    kept = firsts.withColumnRenamed("doc_id", "first")
    whole = texts.select("doc_id", "digest", "n").join(kept, ["digest", "n"]).where("doc_id > first").select(
        "doc_id", "digest", "n").distinct()
    gone = runs.select("doc_id", "digest", "runs", F.lit(False).alias("all")).unionByName(
        whole.select("doc_id", "digest", F.lit(None).alias("runs"), F.lit(True).alias("all")))
    return texts.join(gone.hint("merge"), ["doc_id", "digest"], "left").select("doc_id", "text", F.when(
        F.col("all"), F.array(F.array(F.lit(0).cast("long"), F.col("n").cast("long")))).when(
        F.col("runs").isNotNull(), F.expr(_MERGED)).otherwise(F.array().cast("array<array<bigint>>")).alias("spans"))


#: Ranges joined where they touch.
_MERGED = """aggregate(array_sort(runs), cast(array() as array<array<bigint>>), (out, s) ->
    case when size(out) = 0 or element_at(out, -1)[1] < s.lo then concat(out, array(array(s.lo, s.hi)))
    else concat(slice(out, 1, size(out) - 1), array(array(element_at(out, -1)[0], greatest(element_at(out, -1)[1], s.hi)))) end)"""


def _batch(*columns) -> pa.RecordBatch:
    """Columns (name, arrays to join[, type])."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c[1]).astype(*c[2:] or (np.int64,))) for c in columns], names=[c[0] for c in columns])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, doc_id), those whose h has two ids."""
    last_h, last_d, pending = None, None, False  # pending: the last row is the only id of its h so far
    for batch in batches:
        if not batch.num_rows:
            continue
        h, d = (batch.column(k).to_numpy() for k in (0, 1))
        same = np.append(last_h is not None and h[0] == last_h, h[1:] == h[:-1])
        fresh = ~same | np.append(last_d is None or d[0] != last_d, d[1:] != d[:-1])
        h, d, same = h[fresh], d[fresh], same[fresh]
        if not len(h):
            continue
        keep = same.copy()
        keep[:-1] |= same[1:]
        extra = [(last_h, last_d)] if pending and same[0] else []
        # the last row is decided by the next batch
        out_h, out_d = np.append([x for x, _ in extra], h[keep]).astype(np.int64), np.append([x for _, x in extra], d[keep]).astype(np.int64)
        last_h, last_d, pending = h[-1], d[-1], not same[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_h), pa.array(out_d)], names=["h", "doc_id"])


def _range_hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that may overlap, sorted by their starts."""
    if not len(lo):
        return np.empty(0, np.int64)
    part = raw[lo[0] : hi[-1]]
    up, down = _powers_to(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
    s, e = lo - lo[0], hi - lo[0]
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)).view(np.int64)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, around, doc_id): gone, the surroundings that a smaller id has too; not gone, those of the smallest id if their
    h has several surroundings.  Rows are read once, in order; those of the last h wait until it is known to have several."""
    last_h, last_a, first_d, several = None, None, 0, False
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 4)]
        h, a, d = rows[:3]
        new_h = np.append(last_h is None or h[0] != last_h, h[1:] != h[:-1])
        new = new_h | np.append(last_a is None or a[0] != last_a, a[1:] != a[:-1])
        heads = np.flatnonzero(new)
        low = np.full(len(h), first_d, np.int64)
        if len(heads):
            low[heads[0] :] = np.repeat(d[heads], np.diff(np.append(heads, len(h))))
        gone = d > low
        group = np.cumsum(new_h)  # 0 goes on from the batch before
        count = np.bincount(group[heads], minlength=group[-1] + 1)
        many = count > 1
        many[0] = several or count[0] > 0
        pick = lambda at: tuple(c[at] for c in (*rows[:1], *rows[2:]))
        out = [(*pick(gone), True)]
        if many[0]:
            out += [(*x, False) for x in held]
        if many[0] or group[-1] > 0:
            held = []
        own = ~gone
        out.append((*pick(own & many[group]), False))
        if not many[group[-1]]:
            held.append(pick(own & (group == group[-1])))
        several = bool(many[group[-1]])
        last_h, last_a, first_d = h[-1], a[-1], int(low[-1])
        columns = [np.concatenate(c) for c in zip(*(x[:5] for x in out))]
        marks = np.repeat([x[5] for x in out], [len(x[0]) for x in out])
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns[:4]), pa.array(columns[4].astype(np.int32)), pa.array(marks)],
                                         names=["h", "doc_id", "at", "digest", "n", "gone"])


def _judge(length: int):
    """Runs of windows [lo, hi) in bytes that an earlier document has, of surroundings sorted by h."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            fresh = np.flatnonzero(h != last)
            if size >= SORTED and len(fresh):  # up to where the last minimizer ends
                yield from decide([*held, batch.slice(0, fresh[0])])
                batch, held, size = batch.slice(fresh[0]), [], 0
            held.append(batch)
            size, last = size + batch.column("around").nbytes, h[-1]
        if held:
            yield from decide(held)

    def decide(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        rows = rows.filter(pa.array(may_repeat(rows.column("around").to_pylist(), length)))
        if not rows.num_rows:
            return
        docs, digest, at = (rows.column(c).to_numpy() for c in ("doc_id", "digest", "at"))
        around = rows.column("around").to_pylist()
        first = earliest(around, docs, length)
        size = np.array([len(a) - length + 1 for a in around])
        begin = np.cumsum(size) - size
        gone = np.concatenate(first) < np.repeat(docs, size)
        change = np.append(gone, False)
        edge = np.zeros(len(gone) + 1, bool)
        edge[begin] = True
        edge[-1] = True
        starts = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
        stops = np.flatnonzero(gone & (edge[1:] | ~change[1:]))
        own = np.searchsorted(begin, starts, "right") - 1
        lo = at[own] + starts - begin[own]
        yield pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(digest[own]), pa.array(lo), pa.array(lo + stops - starts + length)],
                                         names=["doc_id", "digest", "lo", "hi"])

    return run


def digest_rows(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows with text and spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for i, s in enumerate(batch.column("spans").to_pylist()):
                raw, at, kept = data[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
                for lo, hi in s:
                    kept.update(raw[at:lo].tobytes())
                    at = hi
                kept.update(raw[at:].tobytes())
                rows.append((len(raw), sum(hi - lo for lo, hi in s), len(s), kept.hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.select("doc_id", "text", "spans").mapInArrow(run, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
