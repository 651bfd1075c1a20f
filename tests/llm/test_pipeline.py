"""The stages against plain loops over what the stage before kept."""

import pathlib
import re
import time

import brute

import corpus_pipeline
from triage.llm import line_chunks, ngram_join, toxicity
from triage.llm.common import discard, land
from triage.session import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "", "en", "s", 0), (None, "some text", "en", "s", 9)], docs.schema)
    docs = docs.unionAll(odd)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert {None, 10**6, 10**6 + 1} <= set(after)
        named = [(i, t) for i, t in before.items() if i is not None]
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.3").collect()}
        if name == "ngram_join":
            want = brute.ngram_join(named, 5, 80)
            assert set(after) == {None} | {i for i, (_, _, c) in want.items() if c == i}
        if name == "decontamination":
            want = brute.decontamination(named, items, 10)
            assert set(after) == {None} | {i for i, w in want.items() if not w[4]}
        if name != "line_dedup":
            assert all(before[i] == t for i, t in after.items())
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 50 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_stages_leave_neither_shuffle_files_nor_tables_that_nothing_reads(spark):
    """Of a stage only what its result reads stays: the keys, chunks and marks of a large corpus would lie beside each other."""
    given = spark.range(400).selectExpr("id as doc_id", "concat_ws('\n', transform(sequence(1, 40), k -> concat('line ', k, ' ', "
                                        "sha2(cast(id % 150 * 100 + k as string), 256)))) as text")
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    here = {p.name for p in shared.iterdir()}
    cut, linked = line_chunks.dedup_lines(given), ngram_join.link(given)
    kept = {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in here}
    assert {"line-gone", "ngram-rows"} <= kept
    assert not kept & {"line-chunks", "line-repeats", "line-extensions", "line-marks", "ngram-sets", "ngram-stars", "ngram-blocks"}
    assert cut.where("n_removed_lines > 0").count() == 250 and linked.where("component_id <> doc_id").count() == 250


def test_landing_frees_its_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before = files()
    landed = land(spark.range(5000).repartition(3, "id"), "shuffled")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and landed.count() == 5000
    discard(landed)
    assert not pathlib.Path(landed.landed_at.removeprefix("file:")).exists()
