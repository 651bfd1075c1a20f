"""Captures cut at any byte give the rows and reasons of whole texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import entry
from triage.sources import captures, har_blocks

ODD = ['q"u', "back\\slash", "\\\\", '\\"', "a,b", "{[", "]}", "\n", "é😀", '"entries": [', '"log": {', "x" * 300, ",", "", '\\",{']


def capture(rng, n):
    say = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 6)))
    entries = [{**entry(f"https://h{i}.test/{i}", status=200 + i % 7, req=[("X", say())], text=say()), "log": {"entries": [say()]}, "pages": [[1, {}], say()]}
               for i in range(n)]
    log = {"version": say(), "pages": [{"entries": [{"a": 1}]}, [2], say()], "entries": entries, "after": {"entries": [3, {"log": {}}]}}
    return {"before": [{"log": {"entries": [1]}}], "entries": [{"no": 1}], "log": log, "end": say()}


@pytest.fixture()
def cut(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1024b")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted((r.source_file.rsplit("/", 1)[-1], r.entry_idx, r.url, r.status, str(r.request_headers), r.response_body) for r in df.collect())


def test_any_cut_gives_the_rows_of_whole_texts(spark, tmp_path, cut):
    rng = random.Random(3)
    texts = {f"f{i}.har": json.dumps(capture(rng, n), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for i, n in enumerate((0, 1, 3, 40, 90))}
    good = texts["f3.har"]
    texts |= {"cut.har": good[: len(good) // 2], "junk.har": good + " x", "open.har": good[:-1], "more.har": good + "}", "array.har": "[" + good + "]",
              "none.har": json.dumps({"log": {"entries": {}}, "x": ["y" * 9000] * 5}), "item.har": good.replace('"entries": [{', '"entries": [7, {').replace('"entries":[{', '"entries":[7,{'),
              "bad.har": good.replace('"request": {', '"request": {,', 1).replace('"request":{', '"request":{,', 1), "blank.har": "\n" * 5000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    given = spark.createDataFrame(list(texts.items()), "source_file string, text string")
    want = rows(captures.exchanges_from_har(given))
    reasons = {r.source_file: r.reason for r in captures.har_rejects(given).collect()}
    reasons |= {"junk.har": captures.INVALID, "more.har": captures.INVALID}  # the parser of whole texts stops behind the first value
    want = [r for r in want if r[0] not in reasons]
    assert len(want) == 134
    for size in ("9001b", "40000b"):
        cut(size)
        assert rows(captures.read_har(spark, str(tmp_path))) == want
        assert {r.source_file.rsplit("/", 1)[-1]: r.reason for r in captures.read_har_rejects(spark, str(tmp_path)).collect()} == reasons
    parts = har_blocks._segments(spark, str(tmp_path), large=True).where(F.col("source_file").endswith("f4.har"))
    assert parts.select("block").distinct().count() > 2


def test_depth_beyond_a_split(spark, tmp_path, cut):
    """Strings and nests that cover several splits."""
    body = "z" * 50_000 + '\\"' + "[{" * 2_000 + "," * 5_000
    text = json.dumps({"log": {"entries": [entry("https://a.test/1", text=body), entry("https://a.test/2", text="b")], "x": [[[["," * 9000]]]]}})
    (tmp_path / "a.har").write_text(text)
    cut("16384b")
    assert [r[2:4] for r in rows(captures.read_har(spark, str(tmp_path)))] == [("https://a.test/1", 200), ("https://a.test/2", 200)]
    assert {r.response_body for r in captures.read_har(spark, str(tmp_path)).collect()} == {body, "b"}
