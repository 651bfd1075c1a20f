"""Correlation of saved results: items → assets and signals → scored leads.

Items of every artifact type share one table (``schemas.INVENTORY_ITEM``), so
signals come from one pass over it.  Scores and categories depend only on counts,
maxima and a closed set of tags; each is a fixed-width aggregate, so an asset that
holds a third of all signals costs no more than any other.  Lists that grow with
an asset (signals, related items, evidence) stay long tables keyed by its id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import TagSet, key_id
from triage.functions.text import redact
from triage.functions.urls import host, normalize_path, path

TAGS = TagSet(rules.TRIAGE_TAGS)
_STRINGS = "array<string>"
_RELATIONS = {
    "endpoint_inventory": "endpoint", "frontend_inventory": "frontend_finding",
    "auth_surface_inventory": "auth_observation", "graphql_inventory": "graphql_operation",
    "authz_matrix": "authz_finding", "evidence_workspace": "evidence_workspace",
}


def _text(*names: str) -> Column:
    """First non-empty of several columns, else empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def asset_key(host_name: Column, raw_path: Column, method: Column) -> Column:
    return F.concat_ws("|", host_name, normalize_path(raw_path), F.upper(method))


def _with_asset(items: DataFrame) -> DataFrame:
    """Add the asset an item speaks about; ``asset_id`` is empty if it names none."""
    blank = F.lit("")
    df = items.withColumn("a_value", _text("url", "asset", "path"))
    df = df.withColumns({
        "a_host": host(F.col("a_value")), "a_method": F.upper(F.coalesce("method", F.lit("UNKNOWN"))),
        "a_path": F.coalesce(F.nullif(path(F.col("a_value")), blank), F.nullif(F.col("path"), blank), F.col("a_value"))})
    df = df.withColumn("a_template", normalize_path(F.col("a_path")))
    key = F.concat_ws("|", "a_host", "a_template", "a_method")
        # coalesce makes the id non-nullable, so joins on it add no null filter to push into the scans
    asset_id = F.coalesce(F.when(F.col("a_path") == "", blank).otherwise(key_id("asset", key)), blank)
    return df.withColumn("asset_id", asset_id).drop("a_value")


def _endpoint_rows(items: DataFrame) -> DataFrame:
    """The last endpoint row per (artifact, id) of GraphQL inventories and matrices."""
    ends = items.filter((F.col("list_name") == "endpoints") & F.col("artifact_type").isin(
        "graphql_inventory", "authz_matrix"))
    payload = F.struct("url", "asset", "path", "method", "risk_tags", "severity", "confidence", "title", "evidence")
    return ends.groupBy("artifact_id", F.col("item_id").alias("endpoint_id")).agg(
        F.max_by(payload, "item_pos").alias("ep"))


def attach_endpoints(items: DataFrame) -> DataFrame:
    """Give operations and matrix results the location of the endpoint they name.

    GraphQL rows take the endpoint's location whole; a matrix result keeps its own
    values and falls back to the endpoint's.
    """
    named = F.col("artifact_type").isin("graphql_inventory", "authz_matrix") & (F.col("list_name") != "endpoints")
    joined = items.filter(named).join(_endpoint_rows(items), ["artifact_id", "endpoint_id"], "left")
    gql = F.col("artifact_type") == "graphql_inventory"
    location = {c: F.when(gql, F.coalesce(F.col(f"ep.{c}"), F.lit(""))).otherwise(F.coalesce(c, F.col(f"ep.{c}")))
                for c in ("url", "asset", "path")}
    location["method"] = F.when(gql, F.col("ep.method")).otherwise(F.coalesce("method", F.col("ep.method")))
    rest = {c: F.when(gql, F.col(c)).otherwise(F.coalesce(c, F.col(f"ep.{c}")))
            for c in ("risk_tags", "severity", "confidence", "evidence")}
    merged = joined.withColumns({**location, **rest}).select(*items.columns)
    others = items.filter(~F.coalesce(named, F.lit(False)))
    return others.unionByName(merged)


def located_items(items: DataFrame) -> DataFrame:
    return _with_asset(attach_endpoints(items))


def _signal_types() -> Column:
    """Types of the signals each item emits, by the kind of artifact it comes from."""
    c = F.col
    kind, tags = c("artifact_type"), F.coalesce("risk_tags", F.array().cast(_STRINGS))
    has_tags = F.size(tags) > 0
    of_list = F.regexp_replace("list_name", "_observations$", "")
    deny = F.lower(F.coalesce("expected", F.lit(""))).contains("deny") & F.lower(
        F.coalesce("observed", F.lit(""))).contains("allow")
    mismatch = deny | F.coalesce("mismatch", F.lit(False))
    none = F.array().cast(_STRINGS)
    return (F.when(kind == "endpoint_inventory", F.filter(tags, lambda t: t.isin(rules.ENDPOINT_SIGNAL_TAGS)))
            .when(kind == "frontend_inventory", F.array(F.coalesce(F.when(c("item_type") != "", c("item_type")), "list_name")))
            .when(kind == "auth_surface_inventory", F.when(has_tags, tags).otherwise(F.array(of_list)))
            .when(kind == "graphql_inventory", F.when(c("list_name") == "endpoints", none).when(has_tags, tags)
                  .otherwise(F.array(F.lit("graphql-manual-review"))))
            .when(kind == "authz_matrix", F.when(c("list_name") == "endpoints", none).otherwise(F.array(
                F.when(mismatch, "authz-mismatch").otherwise(F.coalesce(c("item_type"), F.lit("authz-review"))))))
            .when(kind == "evidence_workspace", F.array(c("item_type")))
            .when(kind.isin("har_report", "finding"), F.array(F.coalesce(
                F.when(c("item_type") != "", c("item_type")), F.lit("har-review"))))
            .otherwise(none))


_TITLES = {
    "endpoint_inventory": lambda t: F.concat(F.lit("Endpoint tagged "), t),
    "frontend_inventory": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Frontend "), t)),
    "auth_surface_inventory": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Auth surface: "), t)),
    "graphql_inventory": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")),
                                              F.concat(F.lit("GraphQL "), t)),
    "authz_matrix": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.lit("Authorization matrix observation")),
    "evidence_workspace": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.lit("Evidence workspace")),
    "har_report": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.lit("HAR/finding review")),
    "finding": lambda t: F.coalesce(F.nullif("title", F.lit("")), F.lit("HAR/finding review")),
}


def signals(located: DataFrame) -> DataFrame:
    """Signals in normal form: known severity and confidence, redacted evidence, tags, id."""
    rows = located.withColumn("signal_type", F.explode(_signal_types()))
    t = F.col("signal_type")
    title = reduce(lambda acc, kv: acc.when(F.col("artifact_type") == kv[0], kv[1](t)), _TITLES.items(),
                   F.when(F.lit(False), F.lit("")))
    tags = F.when(F.size(F.coalesce("risk_tags", F.array().cast(_STRINGS))) > 0,
                  F.array_sort(F.array_distinct("risk_tags"))).otherwise(F.array(t))
    level = lambda col, known, default: F.when(
        F.lower(F.coalesce(col, F.lit(""))).isin(known), F.lower(col)).otherwise(default)
    rows = rows.withColumns({"title": title})
    return rows.select(
        key_id("signal", F.col("artifact_id"), t, F.coalesce("item_id", "title")).alias("signal_id"), "signal_type",
        "title", "source_module", F.col("artifact_id").alias("source_artifact_id"),
        "asset_id", level("severity", rules.SEVERITIES, "info").alias("severity"),
        level("confidence", rules.CONFIDENCES, "medium").alias("confidence"), tags.alias("tags"),
        redact(F.coalesce("evidence", F.lit(""))).alias("redacted_evidence"))


def signals_where(located: DataFrame, *artifact_types: str) -> DataFrame:
    """Signals of some artifact types only."""
    return signals(located.filter(F.col("artifact_type").isin(list(artifact_types))))


def workspace_items(workspaces: DataFrame) -> DataFrame:
    """Evidence workspaces as items, judged ready or as a gap."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    ready = ((F.lower(F.coalesce("status", F.lit(""))) == "ready") & filled("impact") & some("evidence_items")
             & some("reproduction_steps") & filled("severity_rationale") & ~some("quality_warnings"))
    null = lambda t: F.lit(None).cast(t)
    given = lambda c: F.col(c) if c in workspaces.columns else null("string")
    return workspaces.select(
        F.concat(F.lit("workspace:"), "id").alias("artifact_id"), F.lit("evidence_workspace").alias("artifact_type"),
        F.lit("evidence_workspace").alias("source_module"), F.lit("workspaces").alias("list_name"),
        F.lit(0).cast("bigint").alias("item_pos"), F.col("id").alias("item_id"), null("string").alias("url"),
        F.try_element_at("affected_assets", F.lit(1)).alias("asset"), null("string").alias("path"),
        given("method").alias("method"), "title", null("string").alias("name"),
        F.when(ready, "evidence-ready").otherwise("evidence-gap").alias("item_type"),
        given("severity").alias("severity"), "confidence", F.col("tags").alias("risk_tags"),
        null("string").alias("evidence"), null("string").alias("endpoint_id"), null("string").alias("expected"),
        null("string").alias("observed"), null("boolean").alias("mismatch"))


def asset_table(located: DataFrame) -> DataFrame:
    """Assets with the scalars of the first item that names them and their item count."""
    gql = (F.col("artifact_type") == "graphql_inventory") & (F.col("list_name") == "endpoints")
    rows = located.filter((F.col("artifact_type") != "authz_matrix") | (F.col("list_name") != "endpoints"))
    first = rows.groupBy("asset_id").agg(
        F.min_by(F.struct(F.when(gql, "graphql_endpoint").otherwise("endpoint").alias("asset_type"),
                          F.col("a_host").alias("host"), F.col("a_path").alias("path"),
                          F.col("a_method").alias("method"), F.col("a_template").alias("normalized_path")),
                 F.struct("artifact_id", "list_name", "item_pos")).alias("f"), F.count("*").alias("items"))
    # items without an asset share one blank group; it is dropped here, after the aggregate,
    # because a filter on the computed id would be copied down to every scan
    return first.filter("f.path != ''").select("asset_id", "f.asset_type", "f.host", "f.path", "f.method", "f.normalized_path", "items")


def asset_links(located: DataFrame) -> DataFrame:
    """(asset_id, relation, ref_id): items, artifacts, modules and tags of each asset, distinct."""
    relation = reduce(lambda acc, kv: acc.when(F.col("artifact_type") == kv[0], F.lit(kv[1])), _RELATIONS.items(),
                      F.when(F.lit(False), F.lit("")))
    own = ~((F.col("artifact_type") == "graphql_inventory") & (F.col("list_name") == "endpoints"))
    link = lambda kind, ref: F.struct(kind.alias("relation"), ref.alias("ref_id"))
    links = F.concat(
        F.array(F.when(own, link(relation, F.col("item_id"))), link(F.lit("artifact"), F.col("artifact_id")),
                link(F.lit("source_module"), F.col("source_module"))),
        F.transform(F.coalesce("risk_tags", F.array().cast(_STRINGS)), lambda t: link(F.lit("tag"), t)))
    kept = F.filter(F.array_compact(links), lambda x: x["relation"].isNotNull() & (F.coalesce(x["ref_id"], F.lit("")) != ""))
    return located.select("asset_id", F.inline(F.when(F.col("asset_id") != "", kept))).distinct()


def asset_stats(signal_table: DataFrame) -> DataFrame:
    """Everything a score, category and lead need per asset, as fixed-width aggregates."""
    rank = reduce(lambda acc, iv: acc.when(F.col("severity") == iv[1], iv[0]), enumerate(rules.SEVERITIES),
                  F.when(F.lit(False), F.lit(0)))
    weight = reduce(lambda acc, kv: acc.when(F.col("severity") == kv[0], kv[1]), rules.SEVERITY_WEIGHTS.items(),
                    F.when(F.lit(False), F.lit(0)))
    all_tags = F.concat("tags", F.array("signal_type"))
    mapped = F.exists(all_tags, lambda t: t.contains("source-map"))
    bits = F.conv(F.substring(F.sha2("signal_id", 256), 1, 15), 16, 10).cast("bigint")
    rows = signal_table.select(
        "asset_id", rank.alias("rank"), weight.alias("weight"), TAGS.mask_of_array(all_tags).alias("mask"),
        mapped.cast("int").alias("mapped"), (F.col("redacted_evidence") != "").cast("int").alias("shown"), bits.alias("bits"))
    return rows.groupBy("asset_id").agg(
        F.count("*").alias("n_signals"), F.max("weight").alias("weight"), F.max("rank").alias("rank"),
        F.bit_or("mask").alias("mask"), F.max("mapped").alias("mapped"), F.max("shown").alias("shown"),
        F.bit_xor("bits").alias("digest"))


def score(stats: DataFrame) -> Column:
    mask = F.col("mask")
    bonus = lambda points, *names: F.when(TAGS.has(mask, *names), points).otherwise(0)
    total = (F.col("weight") + F.least(F.lit(20), (F.col("n_signals") - 1) * 5) + bonus(20, "authz-mismatch")
             + bonus(10, "state-changing", "sensitive-data", "sensitive-fields") + bonus(12, "cross-tenant", "cross-org")
             + bonus(12, "evidence-ready") - bonus(10, "evidence-gap"))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def priority(value: Column) -> Column:
    first, *rest = rules.PRIORITY_BANDS
    chain = F.when(value >= first[1], first[0])
    for name, low in rest:
        chain = chain.when(value >= low, name)
    return chain.otherwise("informational")


def priority_rank(name: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(name == kv[0], kv[1]), rules.PRIORITY_RANK.items(),
                  F.when(F.lit(False), F.lit(0)))


def is_noise() -> Column:
    return (F.col("n_signals") == 1) & TAGS.has(F.col("mask"), *rules.NOISE_TAGS)


def lead_category() -> Column:
    mask = F.col("mask")
    has = lambda *n: TAGS.has(mask, *n)
    return (F.when(is_noise(), "likely_noise")
            .when(has("authz-mismatch") & has("idor-candidate"), "idor_bola")
            .when((F.col("asset_type") == "graphql_endpoint")
                  & has("object-id-variable", "sensitive-fields", "state-changing"), "graphql_authorization_review")
            .when(F.col("mapped") == 1, "source_map_review")
            .when(has("cookie", "missing-httponly", "missing-secure"), "session_cookie_review")
            .when(has("evidence-ready"), "report_ready_candidate").otherwise("needs_manual_review"))


def reportability() -> Column:
    return (F.when(TAGS.has(F.col("mask"), "evidence-ready"), "report_ready").when(is_noise(), "likely_noise")
            .when(F.col("shown") == 0, "needs_more_evidence").otherwise("needs_manual_validation"))


def scored_assets(assets: DataFrame, stats: DataFrame) -> DataFrame:
    """Every asset with its risk score; one without signals scores 0."""
    return assets.join(stats, "asset_id", "left").select(
        *assets.columns, F.coalesce(score(stats), F.lit(0)).alias("risk_score"))


def leads(assets: DataFrame, stats: DataFrame) -> DataFrame:
    """One lead per asset with signals; both sides hold one row per asset."""
    df = assets.join(stats, "asset_id").withColumn("raw_score", score(stats))
    df = df.withColumn("score", F.when(is_noise(), F.least("raw_score", F.lit(14))).otherwise(F.col("raw_score")))
    severity = F.element_at(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.col("rank") + 1)
    df = df.withColumn("priority", priority(F.col("score")))
    texts = lambda items: F.array(*[F.lit(x) for x in items])
    return df.select(
        key_id("lead", F.col("asset_id"), F.col("n_signals"), F.col("digest")).alias("lead_id"),
        F.concat(F.lit("Manual review: "), "method", F.lit(" "), "host", "normalized_path").alias("title"),
        lead_category().alias("category"), F.col("asset_id").alias("affected_asset_id"), "priority",
        priority_rank(F.col("priority")).alias("priority_rank"),
        F.when(F.col("n_signals") >= 3, "high").otherwise("medium").alias("confidence"),
        severity.alias("severity_estimate"), F.col("n_signals").alias("signal_count"), "score",
        F.concat(F.col("n_signals").cast("string"), F.lit(
            " passive signal(s) correlate to this asset; classification remains conservative until manual validation."))
        .alias("reason"), texts(rules.VALIDATION_STEPS).alias("manual_validation_steps"),
        texts(rules.EVIDENCE_TO_COLLECT).alias("suggested_evidence_to_collect"),
        reportability().alias("reportability"))


def lead_signals(signal_table: DataFrame, lead_table: DataFrame) -> DataFrame:
    """(lead_id, signal_id, source_artifact_id, is_evidence): the long side of a lead."""
    shown = (F.col("redacted_evidence") != "") | (F.col("signal_type") == "evidence-ready")
    return (signal_table.select("asset_id", "signal_id", "source_artifact_id", shown.alias("is_evidence"))
            .join(lead_table.select("lead_id", F.col("affected_asset_id").alias("asset_id")), "asset_id")
            .select("lead_id", "signal_id", "source_artifact_id", "is_evidence"))


def rank_assets(assets: DataFrame, n: int = 10) -> DataFrame:
    return assets.orderBy(F.desc("risk_score"), "asset_id").limit(n)


def rank_leads(lead_table: DataFrame, n: int = 10) -> DataFrame:
    return lead_table.orderBy(F.desc("priority_rank"), "lead_id").limit(n)


def leads_where(lead_table: DataFrame, categories=None, category_contains=None, reportabilities=None,
                priorities=None) -> DataFrame:
    """Leads by category, part of the category name, reportability or priority."""
    out = lead_table
    if categories:
        out = out.filter(F.col("category").isin(list(categories)))
    if category_contains:
        out = out.filter(F.contains("category", F.lit(category_contains)))
    if reportabilities:
        out = out.filter(F.col("reportability").isin(list(reportabilities)))
    if priorities:
        out = out.filter(F.col("priority").isin(list(priorities)))
    return out


LEAD_SLICES = {
    "IDOR/BOLA validation": {"categories": ["idor_bola"]},
    "GraphQL authorization validation": {"category_contains": "graphql"},
    "Frontend exposure validation": {"categories": [
        "source_map_review", "exposed_secret_review", "frontend_config_exposure"]},
    "Auth/session validation": {"categories": ["jwt_review", "session_cookie_review", "auth_flow_review"]},
    "CORS/cache/header validation": {"categories": ["cors_review", "cache_review"]},
    "Evidence needed before reporting": {"reportabilities": ["needs_more_evidence"]},
    "Likely noise to deprioritize": {"reportabilities": ["likely_noise"]},
}


def lead_slices(lead_table: DataFrame) -> DataFrame:
    """(slice, lead_id, title): the named review slices in one pass."""
    def cond(spec):
        tests = [F.col("category").isin(spec["categories"])] if "categories" in spec else []
        if "category_contains" in spec:
            tests.append(F.contains("category", F.lit(spec["category_contains"])))
        if "reportabilities" in spec:
            tests.append(F.col("reportability").isin(spec["reportabilities"]))
        return reduce(lambda a, b: a & b, tests)

    names = F.array_compact(F.array(*[F.when(cond(s), F.lit(n)) for n, s in LEAD_SLICES.items()]))
    return lead_table.select(F.explode(names).alias("slice"), "lead_id", "title")


def triage_summary(artifact_count: DataFrame, assets: DataFrame, signal_table: DataFrame, lead_table: DataFrame,
                   workspaces_ready: DataFrame | None = None) -> DataFrame:
    """(metric, value) counts of a project."""
    def counted(df, metric, cond=None):
        value = F.count("*") if cond is None else F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(metric).alias("metric"), "value")

    lead_counts = lead_table.agg(
        F.count("*").alias("triage_leads"), F.count_if(F.col("reportability") == "report_ready").alias("report_ready"),
        F.count_if(F.col("priority").isin("critical", "high")).alias("high_priority_leads"),
        F.count_if(F.col("reportability") == "needs_more_evidence").alias("needs_more_evidence"))
    lead_rows = lead_counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in lead_counts.columns])))
    parts = [counted(artifact_count, "artifacts"), counted(assets, "assets"), counted(signal_table, "signals"), lead_rows,
             counted(signal_table, "evidence_workspaces_ready", F.col("signal_type") == "evidence-ready")]
    return reduce(DataFrame.unionByName, parts)


def lead_detail(lead_table: DataFrame, assets: DataFrame, signal_table: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Lead → asset → evidence artifacts, one row per lead and artifact."""
    shown = (F.col("redacted_evidence") != "") | (F.col("signal_type") == "evidence-ready")
    evidence = (signal_table.filter(shown).select(F.col("asset_id").alias("affected_asset_id"),
                                                  F.col("source_artifact_id").alias("artifact_id")).distinct())
    located = assets.select(F.col("asset_id").alias("affected_asset_id"), F.concat(
        "method", F.lit(" "), "host", "path").alias("affected_asset"))
    return (lead_table.select("lead_id", "title", "category", "affected_asset_id")
            .join(located, "affected_asset_id", "left").join(evidence, "affected_asset_id", "left")
            .join(artifacts.select("artifact_id", F.col("path").alias("artifact_path")), "artifact_id", "left")
            .select("lead_id", "title", "category", "affected_asset", "artifact_id", "artifact_path"))


def dedupe_artifacts(artifacts: DataFrame, order) -> DataFrame:
    """Of artifacts with the same SHA-256 the latest stays."""
    from triage.operators.authz import upsert_latest

    return upsert_latest(artifacts, ["sha256"], order)


