"""SHA-256 of large files by pieces: the state of a digest goes from the task that read one piece to the task that reads the next."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads; a file of more than ROUNDS pieces has larger ones, so that the plan stays short.
PIECE = 256 << 20
ROUNDS = 64
BLOCK = 4 << 20
#: Bytes of OpenSSL's SHA256_CTX.
STATE = 112


@cache
def _openssl() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib uses, if the state of its SHA-256 can be kept (hashlib's own objects can't be)."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        state = _update(lib, _update(lib, None, [b"a" * 99]), [b"b" * 99])
        return lib if _digest(lib, state) == hashlib.sha256(b"a" * 99 + b"b" * 99).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


def _update(lib: ctypes.CDLL, state: bytes | None, blocks) -> bytes:
    if state is None:
        context = ctypes.create_string_buffer(STATE)
        lib.SHA256_Init(context)
    else:
        context = ctypes.create_string_buffer(state, STATE)
    for block in blocks:
        lib.SHA256_Update(context, block, ctypes.c_size_t(len(block)))
    return context.raw


def _digest(lib: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.create_string_buffer(state, STATE))
    return out.raw.hex()


def _blocks(path: str, at: int, end: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(at)
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                raise EOFError(f"{path} has become shorter than it was when listed")
            at += len(block)
            yield block


def advance(row: dict, piece: int) -> dict:
    """The row of a file after its next piece; at its end with the digest."""
    at, size, path = row["at"], row["size_bytes"], local_path(row["path"])
    if at == size:
        return row
    lib = _openssl()
    if lib is None:  # the file goes through this task whole, still by blocks
        digest = hashlib.sha256()
        for block in _blocks(path, 0, size):
            digest.update(block)
        return {**row, "at": size, "sha256": digest.hexdigest()}
    end = min(at + piece, size)
    state = _update(lib, row["state"], _blocks(path, at, end))
    return {**row, "at": end, "state": state, "sha256": _digest(lib, state) if end == size else None}


def local_path(path: str) -> str | None:
    """The name under which any process of a machine finds a file that Spark lists; None for stores that only Spark reads."""
    scheme, _, rest = path.partition(":")
    if scheme != "file":
        return None
    return "/" + rest.lstrip("/")


def sha256_by_pieces(spark: SparkSession, files: list[tuple[str, int]], piece: int = PIECE) -> DataFrame:
    """(path, size_bytes, sha256) of mounted files given by path and size.

    One stage per piece of the longest file. Each task of a stage has one file and reads one piece of it.
    """
    piece = max(piece, -(-max(size for _, size in files) // ROUNDS))
    schema = "file int, path string, size_bytes long, at long, state binary, sha256 string"
    rows = spark.createDataFrame([(i, path, size, 0, None, None) for i, (path, size) in enumerate(files)], schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([advance(r, piece) for r in batch.to_pylist()], schema=batch.schema)

    for _ in range(-(-max(size for _, size in files) // piece)):
        rows = rows.repartitionById(len(files), F.col("file")).mapInArrow(run, schema)
    return rows.select("path", "size_bytes", "sha256")
