"""Large files are hashed by pieces, one task each, with the digests of the whole files."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from triage.sources import artifacts, file_hash


def manifest(spark, root, **given):
    rows = artifacts.hash_manifest(spark, root, "*.bin", **given).collect()
    found = {r.path.rsplit("/", 1)[-1]: (r.size_bytes, r.sha256, r.not_hashed) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def files(tmp_path):
    names = {"short": 999, "one": 1000, "two": 2000, "more": 1001, "a b%41#é": 2500, "many": 5007}
    (tmp_path / "sub").mkdir()
    expected = {}
    for i, (name, size) in enumerate(names.items()):
        data = (hashlib.sha256(name.encode()).digest() * (size // 32 + 1))[:size]
        (tmp_path / ("sub" if i % 2 else "") / f"{name}.bin").write_bytes(data)
        expected[f"{name}.bin"] = (size, hashlib.sha256(data).hexdigest(), "")
    return str(tmp_path), expected


def test_pieces_give_the_digest_of_the_file(spark, files):
    root, expected = files
    assert manifest(spark, root) == expected
    assert manifest(spark, root, piece=1000) == expected
    too_large = {"many.bin": (expected["many.bin"][0], None, artifacts.TOO_LARGE)}
    assert manifest(spark, root, piece=1000, largest=2500) == expected | too_large
    assert manifest(spark, root, piece=1000, largest=500) == {
        k: v if v[0] <= 500 else (v[0], None, artifacts.TOO_LARGE) for k, v in expected.items()}


def test_a_file_over_2_gib_is_hashed_where_asked(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(size)  # no disk is used
    with open(tmp_path / "huge.bin", "rb") as f:
        assert manifest(spark, str(tmp_path), largest=artifacts.ANY_SIZE) == {"huge.bin": (size, hashlib.file_digest(f, "sha256").hexdigest(), "")}


def test_a_task_reads_one_piece_of_one_file(spark, files, monkeypatch):
    root, expected = files
    read = []
    blocks = file_hash._blocks
    monkeypatch.setattr(file_hash, "_blocks", lambda path, at, end: read.append(end - at) or blocks(path, at, end))
    row = {"file": 0, "path": f"file:{root}/a b%41#é.bin", "size_bytes": 2500, "at": 0, "state": None, "sha256": None}
    for at in (1000, 2000, 2500, 2500):
        row = file_hash.advance(row, 1000)
        assert row["at"] == at and (row["sha256"] is not None) == (at == 2500)
    assert read == [1000, 1000, 500] and row["sha256"] == expected["a b%41#é.bin"][1]
    named = [(f"file:{path}", path.stat().st_size) for path in pathlib.Path(root).rglob("*.bin")]
    monkeypatch.setattr(file_hash, "ROUNDS", 2)  # pieces of 2504 bytes
    found = file_hash.sha256_by_pieces(spark, named, 1000).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) == len(named) and {r.sha256 for r in found} == {v[1] for v in expected.values()}


def test_without_openssl_a_file_goes_by_blocks(files, monkeypatch):
    root, expected = files
    monkeypatch.setattr(file_hash, "_openssl", lambda: None)
    row = {"file": 0, "path": f"file://{root}/two.bin", "size_bytes": 2000, "at": 1000, "state": b"x", "sha256": None}
    assert file_hash.advance(row, 1000)["sha256"] == expected["two.bin"][1]


def test_a_file_that_became_shorter_is_an_error(files):
    root, _ = files
    row = {"file": 0, "path": f"file:{root}/two.bin", "size_bytes": 2001, "at": 0, "state": None, "sha256": None}
    with pytest.raises(EOFError):
        file_hash.advance(row, 3000)


def test_a_store_that_only_spark_reads(spark, files):
    root, expected = files
    with open(f"{root}/huge.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    expected = expected | {"huge.bin": ((2 << 30) + 5, None, artifacts.TOO_LARGE)}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{root}")
    assert manifest(spark, "viewfs://store/in", piece=1000, largest=artifacts.ANY_SIZE) == expected
