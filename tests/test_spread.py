"""Work stays spread over the tasks: no text step goes back to a table's own splits, no hot pair or long rule list meets in one place."""

import pytest
from pyspark.sql import functions as F

from conftest import texts
from triage.operators import endpoints, frontend, reviews, scope
from triage.plans import derived
from triage.sources import artifacts


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def dealt(spark):
    rows = texts(spark, ("a.js", "fetch('/api/a');\nlocalStorage.setItem('k', v);\nel.innerHTML = location.hash;\nparent.postMessage('m', '*');"),
                 ("b.js", "nothing"), ("c.js", None))
    return rows.repartition(3)


@pytest.mark.parametrize("scan", [endpoints.endpoints_from_text, frontend.storage_refs, frontend.dom_leads, frontend.message_leads])
def test_texts_are_tested_where_they_are_scanned(spark, scan):
    found = scan(dealt(spark))
    assert "Filter" not in plan_of(found).split("Repartition")[1]
    assert {r.source_file for r in found.collect()} == {"a.js"}


def test_runtime_config_looks_ahead_only_behind_a_match(spark):
    given = texts(spark, ("a.js", "x\nwindow.__APP_CONFIG__ = {env: 'a'} process.env.B = 2\n"), ("b.js", "config: debug=1"), ("c.js", "none"))
    found = frontend.scan_runtime_config(given)
    assert "(?Udi)(?=((?s:" not in plan_of(found)
    got = sorted((r.source_file, r.line, r.redacted_evidence) for r in found.collect())
    assert got == [("a.js", 2, "process.env.B = 2"), ("a.js", 2, "window.__APP_CONFIG__ = {env: 'a'} process.env.B = 2"), ("b.js", 1, "config: debug=1")]


def test_source_maps_are_parsed_where_they_are_expanded(spark):
    maps = texts(spark, ("a.map", '{"sources":["x.js"],"sourcesContent":["one"]}'), ("b.map", '{"other":1}'), ("c.map", "no json"), ("d.map", None)).repartition(3)
    found = artifacts.read_source_maps(maps)
    assert "Filter" not in plan_of(found).split("Repartition")[1]
    assert [(r.source_file, r.source, r.content) for r in found.collect()] == [("a.map", "x.js", "one")]


def test_events_are_spread_by_their_number(spark, tmp_path):
    spark.range(5 * derived.EVENTS_A_TASK + 1).select(
        F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props")).write.parquet(
        f"{tmp_path}/events.parquet")
    rows = derived.event_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 5 * derived.EVENTS_A_TASK + 1


def test_exchanges_of_one_host_meet_the_outside_hosts_in_parts(spark, exchange):
    from conftest import entry
    found = reviews.third_parties(exchange(("a.har", [entry("https://a.test/x")] + [
        entry(f"https://cdn.other/{i}", text="mail someone@mail.example") for i in range(20)]), ("b.har", [])))
    assert "salt" in plan_of(found)
    assert [(r.source_file, r.host, r.request_count, r.sensitive_categories) for r in found.collect()] == [("a.har", "cdn.other", 20, ["email"])]


def test_many_rules_are_not_sent_to_every_task(spark):
    urls = spark.createDataFrame([(1, "https://h7.test/"), (2, "https://h8.test/x"), (3, "ftp://h7.test/")], "id int, url string")
    rules = spark.range(scope.FEW_RULES + 1).selectExpr("'in' as kind", "cast(id as int) as ord", "concat('h', id, '.test') as rule")
    plan = scope.scope_decide(urls, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert {r.id: (r.allowed, r.matched_rule) for r in scope.scope_decide(urls, rules).collect()} == {
        1: (True, "h7.test"), 2: (True, "h8.test"), 3: (False, "")}
    twice = scope.rule_table(spark, [("in", "h7.test"), ("in", "h7.test"), ("in", " H7.TEST ")])
    assert sorted(r.ord for r in scope.scope_matches(urls, twice).collect()) == [0, 1, 2]
    assert [r.matched_rule for r in scope.scope_decide(urls, twice).where("id = 1").collect()] == ["h7.test"]


def test_changed_texts_are_scanned_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "TEXTS_A_TASK", 1, raising=False)
    given, seen = texts(spark, *[(f"{i}.js", f"fetch('/api/{i}')") for i in range(9)]), []
    inputs = given.select(F.col("source_file").alias("path"), F.sha2("text", 256).alias("sha256"))

    def scan(changed):
        seen.append(changed.rdd.getNumPartitions())
        return {"found": changed.select("source_file", "text")}

    for _ in range(2):
        artifacts.update_inventory(inputs, given, scan, f"{tmp_path}/i")
    assert seen == [9] and artifacts.reload_inventory(inputs, f"{tmp_path}/i", "found").count() == 9


def test_changed_inputs_are_worked_out_once(spark, tmp_path):
    hashed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(text):
        hashed.add(1)
        return f"of {text}"

    given = texts(spark, *[(f"{i}.js", f"fetch('/api/{i}')") for i in range(9)])
    inputs = given.select(F.col("source_file").alias("path"), digest("text").alias("sha256"))
    for n in (9, 18):  # the second run finds nothing changed
        artifacts.update_inventory(inputs, given, lambda changed: {"found": changed.select("source_file", "text")}, f"{tmp_path}/i")
        assert hashed.value == n
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["found", "manifest"]


def test_only_lines_that_name_a_storage_leave_their_text(spark):
    given = texts(spark, ("a.js", "one\nlocalStorage.setItem('k', v); LOCALſtorage.getItem(\"t\")\n\nx\nlocalſtorage('u')\n"), ("b.js", "none"), ("c.js", None))
    found = frontend.storage_refs(given)
    assert "posexplode" not in plan_of(found)
    assert sorted((r.line, r.key) for r in found.collect()) == [(2, "k"), (2, "t"), (5, "u")]
