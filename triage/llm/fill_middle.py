"""Fill-in-the-middle over seekable compressed frames.

``frame_store`` writes every text as independent zstandard frames of at most ``FRAME`` bytes, each with the units, code points and bytes
before it.  ``rearrange`` chooses the cuts from the counts alone, decompresses only the frames that hold a cut, and copies all others as
they are into the output, which is again a list of frames (put one after the other they are a valid zstandard file).  ``digests`` streams
the output's frames in order, and those of the text rebuilt from output and form.  No text crosses a shuffle, and beyond a row's
compressed frames a task holds one frame.

A unit is a word with the white space before it, or the white space that ends a text.  Null texts are empty, and empty ones plain.  A text
with a marker in it is plain.  Repeated rows are rows of their own; rows that share an id are cut by the same numbers.  A null id draws its
numbers from the seed alone.  Columns of the input are kept beside the result in the struct ``row``, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm.common import SPACE_WORDS, small_batches

#: Bytes of text in one frame.
FRAME = 1 << 16
LEVEL = 3
#: Fixed values of the contract: markers, the seed's text, and the percentages of texts that are cut and of suffix-first ones among them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 42, 50, 80

_FRAMES = T.ArrayType(T.StructType().add("units", "long").add("chars", "long").add("bytes", "long").add("data", "binary"))
_ARROW_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


def _word_ends(chunk: np.ndarray, after: int | None) -> np.ndarray:
    """Where words end in a frame; the one at its end counts if a space or nothing comes after."""
    inside = SPACE_WORDS[chunk]
    last = np.empty(len(chunk), bool)
    last[:-1] = inside[:-1] & ~inside[1:]
    last[-1] = inside[-1] and (after is None or not SPACE_WORDS[after])
    return np.flatnonzero(last) + 1


def _code_points(chunk: np.ndarray) -> int:
    return int(np.count_nonzero((chunk & 0xC0) != 0x80))


def _frames_of(text: bytes, compress) -> tuple[list[dict], int, int]:
    """Frames of a text with what is before each, its units and its code points."""
    data, frames, units, chars = np.frombuffer(text, np.uint8), [], 0, 0
    for at in range(0, len(data), FRAME):
        chunk = data[at : at + FRAME]
        frames.append({"units": units, "chars": chars, "bytes": at, "data": compress(chunk.tobytes())})
        units += len(_word_ends(chunk, int(data[at + FRAME]) if at + FRAME < len(data) else None))
        chars += _code_points(chunk)
    return frames, units + (len(data) > 0 and not SPACE_WORDS[data[-1]]), chars


def frame_store(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """row (all other columns), frames, n (units), n_chars, n_bytes (long) and marked (a marker is in the text) of every row."""
    small_batches(docs.sparkSession)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("frames", "n", "n_chars", "n_bytes", "marked")}
            for cell in batch.column("body"):
                body = cell.as_py()
                frames, n, chars = _frames_of(body, compress)
                for k, v in zip(out, (frames, n, chars, len(body), any(m in body for m in (PREFIX, SUFFIX, MIDDLE)))):
                    out[k].append(v)
            kinds = (_ARROW_FRAMES, pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["row", *out])

    schema = T.StructType().add(given.schema["row"]).add("frames", _FRAMES).add("n", "long").add("n_chars", "long").add("n_bytes", "long")
    return given.mapInArrow(rows, schema.add("marked", "boolean"))


def plan(doc_id: Column, *, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> dict[str, Column]:
    """form, and the units at which prefix and middle end (first, second), of a store's row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    cuts = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    return {"form": F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"), "first": F.least(*cuts), "second": F.greatest(*cuts)}


class _Text:
    """Random access to a row of the store."""

    def __init__(self, frames: list[dict], n_units: int, n_chars: int, n_bytes: int, decompress) -> None:
        self.frames, self.decompress, self.total = frames, decompress, (n_units, n_chars, n_bytes)
        self.units = np.array([f["units"] for f in frames], np.int64)
        self.starts = [*(f["bytes"] for f in frames), n_bytes]
        self.opened: dict[int, bytes] = {}

    def open(self, k: int) -> bytes:
        if k not in self.opened:
            self.opened[k] = self.decompress(self.frames[k]["data"])
        return self.opened[k]

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many units; one frame is decompressed."""
        if unit == 0:
            return 0, 0
        n_units, n_chars, n_bytes = self.total
        if unit == n_units:
            return n_bytes, n_chars
        k = int(np.searchsorted(self.units, unit, "left")) - 1
        chunk = np.frombuffer(self.open(k), np.uint8)
        at = int(_word_ends(chunk, None)[unit - self.frames[k]["units"] - 1])
        return self.frames[k]["bytes"] + at, self.frames[k]["chars"] + _code_points(chunk[:at])

    def pieces(self, lo: int, hi: int) -> Iterator[tuple[bytes | None, bytes | None]]:
        """(compressed frame, None) for whole frames of the range, (None, bytes) for parts of cut ones, in order."""
        k = max(0, int(np.searchsorted(self.starts, lo, "right")) - 1)
        while lo < hi:
            start, stop = self.starts[k], min(self.starts[k + 1], hi)
            if lo == start and stop == self.starts[k + 1] and k not in self.opened:
                yield self.frames[k]["data"], None
            else:
                yield None, self.open(k)[lo - start : stop - start]
            lo, k = stop, k + 1


def _written(parts: Iterator[tuple[bytes | None, bytes | None]], compress) -> list[bytes]:
    """Frames of the output: whole ones as they are, parts and markers gathered into frames of their own."""
    frames: list[bytes] = []
    held = bytearray()
    for whole, part in parts:
        if part is not None:
            held += part
        if held and (whole is not None or len(held) >= FRAME):
            frames.append(compress(bytes(held)))
            held.clear()
        if whole is not None:
            frames.append(whole)
    if held:
        frames.append(compress(bytes(held)))
    return frames


def rearrange(store: DataFrame, *, doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """row, n, form, prefix_chars, middle_chars (null if plain) and output (frames in order, array of binary) of every row of a store."""
    small_batches(store.sparkSession)
    given = store.withColumns(plan(F.col(f"row.`{doc_id}`"), seed=seed, rate=rate, spm=spm)).drop("marked")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            outputs, prefixes, middles = [], [], []
            for r in zip(*[batch.column(k) for k in ("form", "frames", "n", "n_chars", "n_bytes", "first", "second")]):
                form, frames, n, n_chars, n_bytes, first, second = [x.as_py() for x in r]
                if form == "plain":
                    outputs.append([f["data"] for f in frames])
                    prefixes.append(None)
                    middles.append(None)
                    continue
                text = _Text(frames, n, n_chars, n_bytes, decompress)
                (a, a_chars), (b, b_chars) = text.cut(first), text.cut(second)
                prefix, suffix = [(PREFIX, 0, a)], [(SUFFIX, b, n_bytes)]
                order = (prefix + suffix if form == "psm" else suffix + prefix) + [(MIDDLE, a, b)]
                outputs.append(_written((p for mark, lo, hi in order for p in ((None, mark), *text.pieces(lo, hi))), compress))
                prefixes.append(a_chars)
                middles.append(b_chars - a_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n"), batch.column("form"), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
                 pa.array(outputs, pa.list_(pa.binary()))], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType().add(store.schema["row"]).add("n", "long").add("form", "string").add("prefix_chars", "long")
    return given.mapInArrow(rows, schema.add("middle_chars", "long").add("output", T.ArrayType(T.BinaryType())))


class _Rebuilt:
    """The text's bytes in their order, from an output streamed in and its form.  The suffix, which comes too early, is held compressed."""

    def __init__(self, form: str, feed, compress) -> None:
        self.feed, self.compress = feed, compress
        self.marks = [] if form == "plain" else [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
        self.now, self.rest, self.suffix = b"", b"", []

    def add(self, chunk: bytes) -> None:
        data = self.rest + chunk
        while self.marks:
            at = data.find(self.marks[0])
            if at < 0:
                keep = min(2, len(data))  # a marker may go on in the next frame
                self._put(data[: len(data) - keep])
                self.rest = data[len(data) - keep :]
                return
            self._put(data[:at])
            self.now, data = self.marks[0], data[at + 3 :]
            del self.marks[0]
        self._put(data)
        self.rest = b""

    def _put(self, data: bytes) -> None:
        if self.now == SUFFIX:
            self.suffix.append(self.compress(data))
        else:
            self.feed(data)

    def end(self, decompress) -> None:
        self._put(self.rest)
        for frame in self.suffix:
            self.feed(decompress(frame))


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``rearrange`` with output_sha256, and restored_sha256 of the text rebuilt from output and form, instead of the output."""
    small_batches(made.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            outs, texts = [], []
            for form, frames in zip(batch.column("form"), batch.column("output")):
                out, text = hashlib.sha256(), hashlib.sha256()
                rebuilt = _Rebuilt(form.as_py(), text.update, compress)
                for frame in frames.values:
                    chunk = decompress(frame.as_py())
                    out.update(chunk)
                    rebuilt.add(chunk)
                rebuilt.end(decompress)
                outs.append(out.hexdigest())
                texts.append(text.hexdigest())
            kept = [c for c in batch.schema.names if c != "output"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(outs), pa.array(texts)], [*kept, "output_sha256", "restored_sha256"])

    schema = T.StructType([f for f in made.schema if f.name != "output"]).add("output_sha256", "string").add("restored_sha256", "string")
    return made.mapInArrow(rows, schema)


def texts(made: DataFrame) -> DataFrame:
    """The rows of ``rearrange`` with the output as a string."""
    small_batches(made.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            whole = [b"".join(decompress(f.as_py()) for f in frames.values) for frames in batch.column("output")]
            yield batch.set_column(batch.schema.get_field_index("output"), "output", pa.array(whole, pa.binary()))

    schema = T.StructType([f if f.name != "output" else T.StructField("output", T.BinaryType()) for f in made.schema])
    return made.mapInArrow(rows, schema).withColumn("output", F.col("output").cast("string"))
