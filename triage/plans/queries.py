"""The registered queries: every operator over whole tables or data derived from them.

Results leave in plain types (strings, integers, 0/1), lists joined by commas in
their order, so that two engines can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions import text as txt
from triage.functions import urls as U
from triage.functions.jsonwalk import json_keys
from triage.operators import auth_surface as auth
from triage.operators import authz, correlate, endpoints, exchanges, frontend, graphql, quality, reviews, scope
from triage.operators import vocabulary as vocab
from triage.plans import derived as D
from triage.session import shared_dir
from triage.sources import artifacts as art
from triage.sources import captures as cap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SCOPE = [("out", "spam-farm.example.org"), ("out", "*.example.com/fr/*"), ("out", "https://blog.*/"), ("out", "/en/9??"),
         ("in", "*.example.com"), ("in", "*.example.net"), ("in", "https://thther.example.org/en/*"), ("in", "app.example.test")]
# Words of the test language in the roles of source and sink.
NEAR_SOURCES, NEAR_SINKS = ["that", "und", "que"], ["the", "der", "para"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Lists of scalars to text, booleans to 0/1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(c.cast("array<string>"), ",").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(c.cast("int").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# --- redaction ---------------------------------------------------------------------------------

@query
def redact_documents(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", "lang", txt.redact(F.col("text")).alias("redacted"))


@query
def redact_pages(spark, sf):
    return txt.redact_table(D.table(spark, sf, "pages"), ["url", "html"])


@query
def redaction_audit(spark, sf):
    return txt.redaction_audit(D.table(spark, sf, "conversations"), "text", "conv_id", "turn")


@query
def redaction_audit_documents(spark, sf):
    """Documents per language and redaction class."""
    found = txt.redaction_audit(D.table(spark, sf, "documents"), "text", "doc_id", "lang")
    return found.groupBy("lang", "redaction_class").agg(F.count("*").alias("documents"))


@query
def sensitive_documents(spark, sf):
    docs = D.table(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"),
                                    F.count_if(txt.contains_sensitive(F.col("text"))).alias("sensitive"))


@query
def redact_nested(spark, sf):
    """Nested redaction of exchanges, counted by what the secret-named and other header values became."""
    red = txt.redact_struct(D.exchanges(spark, sf))
    rows = red.select(F.explode("request_headers").alias("h"))
    return rows.groupBy(F.col("h.name").alias("name"), F.when(
        F.col("h.value").contains("<redacted"), F.col("h.value")).otherwise("kept").alias("value")).agg(
        F.count("*").alias("headers"))


@query
def redact_records(spark, sf):
    """Nested redaction of records with secret-named fields in structs, lists and maps, every leaf of them."""
    at = lambda key: F.try_element_at("extra", F.lit(key)).alias(f"extra_{key}")
    return txt.redact_struct(D.records(spark, sf)).select(
        "source_file", "entry_idx", "url", "actor.password", "actor.note", F.col("actor.inner")[0]["api_key"].alias("api_key"),
        F.col("actor.inner")[0]["text"].alias("text"), at("session_token"), at("lang"), at("auth"))


@query
def sensitive_material(spark, sf):
    return exchanges.sensitive_material(D.exchanges(spark, sf))


# --- URLs and exchanges ---------------------------------------------------------------------------

@query
def url_parts(spark, sf):
    return D.exchanges(spark, sf).select("source_file", "entry_idx", U.url_parts(F.col("url")).alias("p")).select(
        "source_file", "entry_idx", "p.*")


@query
def normalize_path(spark, sf):
    return D.exchanges(spark, sf).select("source_file", "entry_idx", U.normalize_path(U.path(F.col("url"))).alias("template"))


@query
def query_param_counts(spark, sf):
    """Parameter names with and without blank values."""
    q = U.query(F.col("url"))
    rows = D.exchanges(spark, sf).select(
        F.explode(U.query_params(q)).alias("name"), U.query_params(q, keep_blank=False).alias("filled"))
    return rows.groupBy("name").agg(F.count("*").alias("seen"), F.count_if(F.array_contains("filled", F.col("name"))).alias("filled"))


@query
def flatten_exchange(spark, sf):
    """Header lookups of the flat exchange table."""
    flat_rows = exchanges.flatten_exchange(D.exchanges(spark, sf))
    return flat_rows.select("source_file", "entry_idx", "method", "url", "status", "mime_type",
                            F.try_element_at("request_headers", F.lit("x-api-key")).alias("api_key"),
                            F.try_element_at("response_headers", F.lit("cache-control")).alias("cache_control"),
                            F.try_element_at("response_headers", F.lit("set-cookie")).alias("last_set_cookie"))


@query
def exchange_summary(spark, sf):
    return exchanges.summarize(D.exchanges(spark, sf))


@query
def body_json_keys(spark, sf):
    """Occurrences of each JSON key in request and response bodies, at any depth."""
    ex = D.exchanges(spark, sf)
    keys = F.concat(json_keys(F.col("request_body")), json_keys(F.col("response_body")))
    return ex.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("occurrences"))


@query
def body_leaf_values(spark, sf):
    """Named leaves of request and response bodies per location, name and value."""
    named = exchanges.named_values(D.exchanges(spark, sf)).filter(
        F.col("location").isin("request body", "response body") & ~F.col("name").isin("request_body", "response_body"))
    return named.groupBy("location", "name").agg(F.count("*").alias("leaves"), F.countDistinct("value").alias("distinct_values"))


# --- endpoints -----------------------------------------------------------------------------------------

def _observed(spark, sf):
    return endpoints.endpoints_from_exchanges(D.exchanges(spark, sf))


@query
def endpoint_inventory(spark, sf):
    return flat(endpoints.merge_endpoints(_observed(spark, sf)).drop("risk_mask"))


@query
def endpoint_values(spark, sf):
    return endpoints.endpoint_values(_observed(spark, sf))


@query
def endpoint_value_lists(spark, sf):
    return flat(endpoints.endpoint_arrays(_observed(spark, sf)))


@query
def endpoint_sources(spark, sf):
    return endpoints.endpoint_sources(_observed(spark, sf))


@query
def endpoint_summary(spark, sf):
    return endpoints.endpoint_summary(endpoints.merge_endpoints(_observed(spark, sf)))


@query
def endpoint_hosts(spark, sf):
    return endpoints.endpoint_hosts(endpoints.merge_endpoints(_observed(spark, sf)))


@query
def endpoint_checklist(spark, sf):
    return endpoints.checklist(endpoints.merge_endpoints(_observed(spark, sf)))


@query
def high_interest_endpoints(spark, sf):
    kept = endpoints.high_interest(endpoints.merge_endpoints(_observed(spark, sf)))
    return kept.select("endpoint_id", "method", "host", "normalized_path")


@query
def har_endpoints(spark, sf):
    return endpoints.har_endpoints(D.exchanges(spark, sf))


@query
def har_endpoint_values(spark, sf):
    return endpoints.har_endpoint_values(D.exchanges(spark, sf))


@query
def text_endpoints(spark, sf):
    return _text_endpoints(D.artifacts(spark, sf))


def _text_endpoints(texts):
    found = endpoints.endpoints_from_text(texts)
    return found.select("source_file", "line", "method", "raw_url", "normalized_path", endpoints.RISKS.joined(
        F.col("risk_mask")).alias("risk_tags"), endpoints.OBJECT_IDS.joined(F.col("object_mask")).alias("object_ids"))


@query
def reused_text_endpoints(spark, sf):
    """Endpoints of all texts from an inventory whose first run saw other contents of every second text: only those are scanned again."""
    texts, root = D.artifacts(spark, sf), f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    before = texts.withColumn("text", F.when(F.xxhash64("source_file") % 2 == 0, F.concat("text", F.lit(" fetch('/api/old')"))).otherwise(F.col("text")))
    for state in (before, texts):
        inputs = state.select(F.col("source_file").alias("path"), F.sha2("text", 256).alias("sha256"))
        art.update_inventory(inputs, state, lambda changed: {"text_endpoints": _text_endpoints(changed)}, root)
    return art.reload_inventory(inputs, root, "text_endpoints")


@query
def text_endpoint_inventory(spark, sf):
    return flat(endpoints.merge_endpoints(endpoints.endpoints_from_text(D.artifacts(spark, sf))).drop("risk_mask"))


@query
def api_client_hints(spark, sf):
    return endpoints.api_client_hints(endpoints.endpoints_from_text(D.artifacts(spark, sf)))


# --- reviews ------------------------------------------------------------------------------------------------

@query
def cookie_review(spark, sf):
    return flat(reviews.review_cookies(D.exchanges(spark, sf)))


@query
def cookie_observations(spark, sf):
    return flat(reviews.cookie_observations(D.exchanges(spark, sf)))


@query
def header_review(spark, sf):
    return reviews.review_headers(D.exchanges(spark, sf))


@query
def security_headers(spark, sf):
    return flat(reviews.security_headers(D.exchanges(spark, sf)))


@query
def cors_observations(spark, sf):
    return flat(reviews.cors_observations(D.exchanges(spark, sf)))


@query
def cache_review(spark, sf):
    return reviews.review_cache(D.exchanges(spark, sf))


@query
def cache_observations(spark, sf):
    return flat(reviews.cache_observations(D.exchanges(spark, sf)))


@query
def third_parties(spark, sf):
    return flat(reviews.third_parties(D.exchanges(spark, sf)))


@query
def third_party_urls(spark, sf):
    return reviews.third_party_urls(D.exchanges(spark, sf))


@query
def har_findings(spark, sf):
    ex = D.exchanges(spark, sf)
    return reviews.har_findings(exchanges.sensitive_material(ex), reviews.review_cache(ex))


# --- authentication surface -----------------------------------------------------------------------------------

def _tokens(spark, sf):
    return auth.decode_jwt(auth.jwt_candidates(D.exchanges(spark, sf), D.artifacts(spark, sf)), D.AS_OF)


@query
def jwt_candidates(spark, sf):
    return auth.jwt_candidates(D.exchanges(spark, sf), D.artifacts(spark, sf))


@query
def jwt_metadata(spark, sf):
    return flat(_tokens(spark, sf))


@query
def jwt_merged(spark, sf):
    """Tokens of all files, each from the first file that has it."""
    merged = auth.merge_observations(_tokens(spark, sf))
    return merged.select("id", "source_file", "occurrences", "algorithm", "location")


@query
def jwt_checklist(spark, sf):
    return auth.jwt_checklist(auth.merge_observations(_tokens(spark, sf)))


def _auth_endpoints(spark, sf):
    return auth.auth_endpoints(D.exchanges(spark, sf), D.artifacts(spark, sf))


@query
def auth_endpoints(spark, sf):
    return flat(_auth_endpoints(spark, sf).drop("tag_mask"))


@query
def auth_endpoints_of_inventories(spark, sf):
    """Authentication endpoints of captures and of the saved endpoint inventory of all texts."""
    saved = endpoints.merge_endpoints(endpoints.endpoints_from_text(D.artifacts(spark, sf))).select(
        F.concat(F.lit("inventory/"), "endpoint_id").alias("source_file"), F.lit(0).cast("bigint").alias("entry_idx"), "method", "url")
    return flat(auth.auth_endpoints(D.exchanges(spark, sf), inventories=saved).drop("tag_mask"))


@query
def session_leads(spark, sf):
    return auth.session_leads(_auth_endpoints(spark, sf), reviews.cookie_observations(D.exchanges(spark, sf)))


@query
def auth_summary(spark, sf):
    ex = D.exchanges(spark, sf)
    return auth.auth_summary(cookie_observations=reviews.cookie_observations(ex), security_header_observations=reviews.security_headers(ex),
                             cors_observations=reviews.cors_observations(ex), cache_observations=reviews.cache_observations(ex))


@query
def raw_http_cookies(spark, sf):
    """Cookie observations of raw HTTP texts."""
    ex = cap.raw_http_exchanges(D.raw_http(spark, sf))
    return flat(reviews.cookie_observations(ex).select("source_file", "name", "location", "cookie_type", "risk_tags"))


@query
def raw_http_cache(spark, sf):
    """Header review of raw HTTP texts."""
    ex = cap.raw_http_exchanges(D.raw_http(spark, sf))
    return reviews.review_headers(ex).filter("header = 'cache-control'").select("source_file", "value")


# --- front end ------------------------------------------------------------------------------------------------------

@query
def secret_scan(spark, sf):
    return flat(frontend.scan_secrets(D.artifacts(spark, sf)))


@query
def internal_refs(spark, sf):
    return flat(frontend.scan_internal_refs(D.artifacts(spark, sf)))


@query
def runtime_config(spark, sf):
    return flat(frontend.scan_runtime_config(D.artifacts(spark, sf)))


@query
def storage_refs(spark, sf):
    return frontend.storage_refs(D.artifacts(spark, sf))


@query
def dom_leads(spark, sf):
    return frontend.dom_leads(D.artifacts(spark, sf))


@query
def message_leads(spark, sf):
    return flat(frontend.message_leads(D.artifacts(spark, sf)))


@query
def line_windows(spark, sf):
    """Lines of prose with a sink word and a source word within three lines."""
    near = frontend.near_lines(D.documents(spark, sf), NEAR_SOURCES, NEAR_SINKS)
    return near.select("source_file", "line", "source_pattern", "sink_pattern",
                       F.length("redacted_evidence").alias("window_length"))


@query
def line_table(spark, sf):
    """Lines per document with their total length."""
    rows = txt.lines(D.documents(spark, sf))
    return rows.groupBy("source_file").agg(F.count("*").alias("lines"), F.max("line_no").alias("last_line"),
                                           F.sum(F.length("line")).alias("chars"))


@query
def sourcemap_refs(spark, sf):
    return frontend.sourcemap_refs(D.artifacts(spark, sf))


def _maps(spark, sf):
    return art.read_source_maps(D.source_map_artifacts(spark, sf))


@query
def source_maps(spark, sf):
    return _maps(spark, sf)


@query
def sourcemap_exposure(spark, sf):
    return frontend.sourcemap_exposure(_maps(spark, sf))


@query
def sourcemap_comments(spark, sf):
    return frontend.scan_comments(_maps(spark, sf))


@query
def embedded_source_urls(spark, sf):
    """Endpoints found in the sources embedded in source maps."""
    found = endpoints.endpoints_from_text(art.expand_sources(_maps(spark, sf)))
    return found.select("source_file", "line", "method", "raw_url")


@query
def embedded_findings(spark, sf):
    """All front-end analyses and endpoints of the sources embedded in one source map per text; the maps are parsed once."""
    path = f"{shared_dir(spark)}/embedded-{uuid.uuid4().hex}"
    sources = art.expand_sources(art.read_source_maps(D.artifact_maps(spark, sf)))
    sources.write.parquet(path)
    return frontend.rescan(spark.read.schema(sources.schema).parquet(path))


@query
def frontend_summary(spark, sf):
    a = D.artifacts(spark, sf)
    return frontend.frontend_summary(
        files_analyzed=a, secrets=frontend.scan_secrets(a), runtime_configs=frontend.scan_runtime_config(a),
        source_maps=frontend.sourcemap_refs(a), storage_references=frontend.storage_refs(a),
        dom_review_leads=frontend.dom_leads(a), postmessage_leads=frontend.message_leads(a))


# --- GraphQL -----------------------------------------------------------------------------------------------------------

def _payloads(spark, sf):
    return graphql.gql_payloads(D.exchanges(spark, sf))


def _operations(spark, sf):
    return graphql.gql_operations(graphql.gql_documents(_payloads(spark, sf)))


@query
def gql_endpoints(spark, sf):
    return flat(graphql.gql_merge(graphql.gql_endpoints(D.exchanges(spark, sf), graphql.endpoint_bearing(D.artifacts(spark, sf)))))


@query
def gql_file_operations(spark, sf):
    """Operations of document files."""
    return _flat_operations(graphql.gql_operations(graphql.gql_documents(graphql.gql_payloads(artifacts=D.gql_files(spark, sf)))))


@query
def gql_operations(spark, sf):
    return _flat_operations(_operations(spark, sf))


def _flat_operations(ops):
    types = F.array_join(F.transform("variable_types", lambda v: F.concat(v["name"], F.lit(":"), v["type"])), ",")
    return flat(ops.withColumn("variable_types", types).drop("tag_mask", "side", "pos"))


@query
def gql_variables(spark, sf):
    return flat(graphql.gql_variables(_operations(spark, sf)))


@query
def gql_fragments(spark, sf):
    return flat(graphql.gql_fragments(graphql.gql_documents(_payloads(spark, sf))))


@query
def gql_batches(spark, sf):
    return graphql.gql_batches(_payloads(spark, sf)).select("source_file", "entry_idx", "lead_id", "endpoint_id", "reason")


@query
def gql_errors(spark, sf):
    return graphql.gql_errors(_payloads(spark, sf)).select("source_file", "entry_idx", "category", "evidence")


@query
def gql_schema_sdl(spark, sf):
    return flat(graphql.gql_schema_sdl(D.schema_artifacts(spark, sf)))


@query
def gql_introspection(spark, sf):
    return flat(graphql.gql_introspection(D.introspection_artifacts(spark, sf)))


@query
def gql_leads(spark, sf):
    payloads = _payloads(spark, sf)
    ops = graphql.gql_operations(graphql.gql_documents(payloads))
    schemas = graphql.gql_schema_sdl(D.schema_artifacts(spark, sf))
    return graphql.gql_leads(ops, payloads, schemas)


@query
def gql_summary(spark, sf):
    payloads = _payloads(spark, sf)
    docs = graphql.gql_documents(payloads)
    ops = graphql.gql_operations(docs)
    return graphql.gql_summary(
        endpoints=graphql.gql_merge(graphql.gql_endpoints(D.exchanges(spark, sf))), operations=ops,
        variables=graphql.gql_variables(ops), fragments=graphql.gql_fragments(docs),
        schema_artifacts=graphql.gql_schema_sdl(D.schema_artifacts(spark, sf)))


# --- vocabulary ------------------------------------------------------------------------------------------------------------

def _raw_terms(spark, sf):
    ex = D.exchanges(spark, sf)
    return vocab.terms_from_exchanges(ex).unionByName(vocab.terms_from_text(D.page_artifacts(spark, sf)))


def _terms(spark, sf):
    return vocab.aggregate_terms(_raw_terms(spark, sf))


@query
def exchange_terms(spark, sf):
    """Terms of captures with counts, scores and tags."""
    terms = vocab.aggregate_terms(vocab.terms_from_exchanges(D.exchanges(spark, sf)))
    return flat(terms.select("id", "normalized_value", "category", "occurrences", "frequency_score", "risk_score", "tags"))


@query
def text_terms(spark, sf):
    """Terms of pages, documents and scripts with counts."""
    return vocab.aggregate_terms(vocab.terms_from_text(D.artifacts(spark, sf))).select(
        "normalized_value", "category", "occurrences")


@query
def gql_terms(spark, sf):
    return vocab.aggregate_terms(vocab.terms_from_graphql(_payloads(spark, sf))).select(
        "normalized_value", "category", "occurrences", "value")


@query
def inventory_terms(spark, sf):
    """Terms out of saved tables: the endpoint inventory, the matrix and evidence workspaces."""
    a = D.authz(spark, sf)
    raw = vocab.terms_from_inventories(actors=a["actors"], expected_access=a["expected"],
                                       objects=a["objects"].withColumn("identifiers", F.create_map(F.lit("orderId"), F.col("id"))),
                                       endpoint_templates=a["templates"].withColumn("object_id_candidates", F.array(F.lit("id"))))
    return vocab.aggregate_terms(raw).select("normalized_value", "category", "occurrences")


@query
def saved_table_terms(spark, sf):
    """Terms out of saved endpoint, runtime-config, route and storage tables, here those of all texts and pages."""
    a = D.artifacts(spark, sf)
    routes = D.table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("source_file"), U.path(F.col("url")).alias("path"))
    raw = vocab.terms_from_inventories(endpoints=endpoints.merge_endpoints(endpoints.endpoints_from_text(a)), routes=routes,
                                       runtime_configs=frontend.scan_runtime_config(a), storage_references=frontend.storage_refs(a))
    return vocab.aggregate_terms(raw).select("normalized_value", "category", "occurrences")


@query
def workspace_terms(spark, sf):
    return vocab.aggregate_terms(vocab.terms_from_inventories(workspaces=D.workspaces(spark, sf))).select(
        "normalized_value", "category", "occurrences")


@query
def json_key_terms(spark, sf):
    return vocab.aggregate_terms(vocab.terms_from_json(D.saved_artifacts(spark, sf))).select(
        "normalized_value", "category", "occurrences")


@query
def top_terms(spark, sf):
    return vocab.top_terms(_terms(spark, sf)).select("normalized_value", "category", "risk_score", "occurrences")


@query
def top_terms_per_category(spark, sf):
    return vocab.top_terms_per_category(vocab.aggregate_terms(vocab.terms_from_exchanges(D.exchanges(spark, sf)))).select(
        "category", "rank", "normalized_value", "risk_score", "occurrences")


@query
def term_categories(spark, sf):
    return vocab.category_counts(_terms(spark, sf))


@query
def term_sources(spark, sf):
    return vocab.term_sources(vocab.terms_from_exchanges(D.exchanges(spark, sf)))


@query
def term_summary(spark, sf):
    raw = vocab.terms_from_exchanges(D.exchanges(spark, sf))
    return vocab.term_summary(vocab.aggregate_terms(raw), D.exchanges(spark, sf))


@query
def term_merge(spark, sf):
    """Term tables of captures and of GraphQL payloads merged a second time."""
    a = vocab.aggregate_terms(vocab.terms_from_exchanges(D.exchanges(spark, sf)))
    b = vocab.aggregate_terms(vocab.terms_from_graphql(_payloads(spark, sf)))
    keep = ["normalized_value", "category", "occurrences", "value", "source_type", "context"]
    merged = vocab.merge_terms(a.select(*keep).unionByName(b.select(*keep)))
    return merged.select("normalized_value", "category", "occurrences", "frequency_score")


@query
def term_lists(spark, sf):
    return vocab.term_lists(vocab.aggregate_terms(vocab.terms_from_exchanges(D.exchanges(spark, sf))))


@query
def term_variants(spark, sf):
    return vocab.term_variants(vocab.aggregate_terms(vocab.terms_from_exchanges(D.exchanges(spark, sf))))


# --- authorization ---------------------------------------------------------------------------------------------------------------

@query
def authz_templates(spark, sf):
    return flat(authz.endpoint_templates(endpoints.merge_endpoints(_observed(spark, sf))))


@query
def authz_compare(spark, sf):
    a = D.authz(spark, sf)
    return flat(authz.compare(a["expected"], a["observed"]))


@query
def authz_findings(spark, sf):
    a = D.authz(spark, sf)
    return authz.authz_findings(authz.compare(a["expected"], a["observed"]), a["objects"], a["templates"])


@query
def authz_orphans(spark, sf):
    a = D.authz(spark, sf)
    return authz.orphans(a["expected"], a["actors"], a["objects"], a["templates"])


@query
def authz_checklist(spark, sf):
    a = D.authz(spark, sf)
    return authz.authz_checklist(a["expected"], a["templates"])


# --- correlation -----------------------------------------------------------------------------------------------------------------------

def _located(spark, sf):
    return correlate.located_items(D.inventory_items(spark, sf).unionByName(correlate.workspace_items(D.workspaces(spark, sf))))


def _project(spark, sf):
    located = _located(spark, sf)
    sig = correlate.signals(located)
    assets, stats = correlate.asset_table(located), correlate.asset_stats(sig)
    return located, sig, assets, stats


@query
def triage_signals(spark, sf):
    return flat(correlate.signals(_located(spark, sf)))


@query
def triage_assets(spark, sf):
    _, _, assets, stats = _project(spark, sf)
    return correlate.scored_assets(assets, stats)


@query
def triage_asset_links(spark, sf):
    return correlate.asset_links(_located(spark, sf))


@query
def triage_leads(spark, sf):
    _, _, assets, stats = _project(spark, sf)
    return correlate.leads(assets, stats).drop("manual_validation_steps", "suggested_evidence_to_collect")


@query
def triage_top_leads(spark, sf):
    _, _, assets, stats = _project(spark, sf)
    return correlate.rank_leads(correlate.leads(assets, stats), 10).select("lead_id", "title", "priority", "score")


@query
def triage_top_assets(spark, sf):
    _, _, assets, stats = _project(spark, sf)
    return correlate.rank_assets(correlate.scored_assets(assets, stats), 10)


@query
def triage_lead_slices(spark, sf):
    _, _, assets, stats = _project(spark, sf)
    return correlate.lead_slices(correlate.leads(assets, stats))


@query
def triage_summary(spark, sf):
    located, sig, assets, stats = _project(spark, sf)
    return correlate.triage_summary(located.select("artifact_id").distinct(), assets, sig, correlate.leads(assets, stats))


@query
def triage_lead_detail(spark, sf):
    located, sig, assets, stats = _project(spark, sf)
    files = located.select("artifact_id", F.concat("artifact_id", F.lit(".json")).alias("path")).distinct()
    return correlate.lead_detail(correlate.leads(assets, stats), assets, sig, files)


@query
def triage_lead_signals(spark, sf):
    _, sig, assets, stats = _project(spark, sf)
    return flat(correlate.lead_signals(sig, correlate.leads(assets, stats)))


@query
def artifact_dedupe(spark, sf):
    """Saved artifacts with equal content, the latest path stays."""
    rows = D.saved_artifacts(spark, sf).select(F.sha2("text", 256).alias("sha256"), "source_file")
    return correlate.dedupe_artifacts(rows, F.col("source_file"))


# --- scope -----------------------------------------------------------------------------------------------------------------------------------

def _urls(spark, sf):
    return D.exchanges(spark, sf).select("source_file", "entry_idx", "url")


@query
def scope_decide(spark, sf):
    return flat(scope.scope_decide(_urls(spark, sf), scope.rule_table(spark, SCOPE)))


@query
def scope_matches(spark, sf):
    return scope.scope_matches(_urls(spark, sf), scope.rule_table(spark, SCOPE)).select("source_file", "entry_idx", "kind", "rule")


@query
def scope_policy_decide(spark, sf):
    """Decisions by a policy with a rule for every part."""
    return flat(scope.scope_decide(_urls(spark, sf), D.policy_rules(spark, sf)))


@query
def scope_policy_matches(spark, sf):
    """How many URLs each rule of that policy matches."""
    rules = D.policy_rules(spark, sf).groupBy("kind", "ord", "rule").agg(F.count("*").alias("rows"))
    # equal texts at other places match the same URLs: each text is matched and counted once, then the places join their count
    found = scope.scope_matches(_urls(spark, sf), rules.groupBy("kind", "rule").agg(F.min("ord").alias("ord")))
    counts = found.groupBy("kind", "rule").agg(F.count("*").alias("urls"))
    return rules.join(counts, ["kind", "rule"]).select("kind", "ord", "rule", (F.col("urls") * F.col("rows")).alias("urls"))


# --- quality -------------------------------------------------------------------------------------------------------------------------------------

def _manifest(spark, sf):
    """A file for every document; those of the documents with an odd id lie elsewhere, so their attachments are missing."""
    path = F.col("source_file")
    return D.documents(spark, sf).select(F.when(path.rlike("[13579]\\.txt$"), F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"))


def _drafts(spark, sf):
    return quality.drafts_from_workspaces(D.workspaces(spark, sf)).withColumn("id", F.concat(
        F.lit("submission-"), F.regexp_extract(F.element_at("attachments", 1)["path"], r"\d+", 0)))


@query
def lint_workspaces(spark, sf):
    return quality.lint_workspaces(D.workspaces(spark, sf))


@query
def lint_findings(spark, sf):
    return quality.lint_findings(_findings(spark, sf))


def _findings(spark, sf):
    return D.inventory_items(spark, sf).filter("artifact_type in ('finding', 'har_report')").select(
        F.col("item_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.col("item_type").alias("type"),
        F.lower(F.coalesce("severity", F.lit("info"))).alias("severity"), F.lit("medium").alias("confidence"),
        F.coalesce("asset", "url").alias("asset"), F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.lit("").alias("redacted_evidence"), F.when(F.col("title").isNotNull(), "Some impact").otherwise("").alias("impact"),
        F.lit("Fix").alias("recommendation"))


@query
def lint_drafts(spark, sf):
    return quality.lint_drafts(_drafts(spark, sf), _manifest(spark, sf))


@query
def draft_status(spark, sf):
    drafts = _drafts(spark, sf)
    return quality.draft_status(drafts, quality.lint_drafts(drafts, _manifest(spark, sf)))


@query
def draft_checklist(spark, sf):
    return flat(quality.draft_checklist(_drafts(spark, sf), _manifest(spark, sf)).drop("text", "recommendation"))


@query
def drafts(spark, sf):
    """Drafts of workspaces, leads and findings side by side."""
    _, _, assets, stats = _project(spark, sf)
    rows = (_drafts(spark, sf).unionByName(quality.drafts_from_leads(correlate.leads(assets, stats), assets))
            .unionByName(quality.drafts_from_findings(_findings(spark, sf))))
    return flat(rows.select("id", "title", "vulnerability_class", "severity_estimate", "affected_assets", "source_type", "status"))


# --- sources ---------------------------------------------------------------------------------------------------------------------------------------

@query
def har_scan(spark, sf):
    """Captures as JSON text, parsed back to exchanges."""
    ex = cap.exchanges_from_har(cap.har_text(D.exchanges(spark, sf)))
    return ex.select(F.substring_index("source_file", "#", 1).alias("source_file"),
                     F.substring_index("source_file", "#", -1).cast("bigint").alias("capture"), "entry_idx", "method", "url",
                     "status", F.size("request_headers").alias("request_headers"), F.size("response_headers").alias(
                         "response_headers"), F.length("request_body").alias("request_length"),
                     F.length("response_body").alias("response_length"), "mime_type")


@query
def har_rejects(spark, sf):
    """Capture texts broken in five ways by the event's properties, and the reason each is rejected."""
    e = D.event_rows(spark, sf)
    bad = e.selectExpr("source_file || '#' || ids as source_file", """case k % 7
        when 0 then ' ' when 1 then '{"log": {' || ids when 2 then '[' || ids || ']' when 3 then '{"log":{"version":"1"}}'
        when 4 then '{"log":{"entries":[' || ids || ']}}' when 5 then '{"log":{"entries":[{"request":{}}]}}'
        else '{"log":{"entries":[{"request":{},"response":{"status":"x' || ids || '"}}]}}' end as text""")
    good = cap.har_text(D.exchanges(spark, sf))
    return cap.har_rejects(bad.unionByName(good))


@query
def classify_inputs(spark, sf):
    mixed = (D.saved_artifacts(spark, sf).unionByName(D.raw_http(spark, sf)).unionByName(D.artifacts(spark, sf))
             .unionByName(D.schema_artifacts(spark, sf)))
    return flat(art.classify_inputs(mixed))


@query
def graphql_inputs(spark, sf):
    """The inputs of the GraphQL analysis among scripts, documents, pages, schemas and saved results."""
    mixed = D.artifacts(spark, sf).unionByName(D.schema_artifacts(spark, sf)).unionByName(D.saved_artifacts(spark, sf))
    return art.graphql_bearing(mixed).select("source_file", "suffix")


@query
def artifact_types(spark, sf):
    return art.detect_artifact_type(D.saved_artifacts(spark, sf))


@query
def content_manifest(spark, sf):
    """Size and SHA-256 of every document and page as file content."""
    files = D.documents(spark, sf).unionByName(D.page_artifacts(spark, sf)).select(
        F.col("source_file").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return art.manifest_of(files)


@query
def evidence_items(spark, sf):
    files = D.documents(spark, sf).unionByName(D.scripts(spark, sf)).select(
        F.col("source_file").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return flat(art.evidence_items(files))


@query
def hash_manifest(spark, sf):
    """The files of the given tables, hashed as they lie, however large."""
    return art.hash_manifest(spark, sf, "*.parquet", largest=art.ANY_SIZE).select(
        F.substring_index("path", "/", -1).alias("file"), "size_bytes", "sha256")


@query
def scope_rule_table(spark, sf):
    """Ordered rules of one profile per supplier."""
    profiles = D.table(spark, sf, "supplier").select(
        F.array(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.test")), F.lit("*.example.test")).alias(
            "in_scope"), F.array(F.concat(F.lit("admin"), F.col("s_suppkey").cast("string"), F.lit(".example.test"))).alias("out_of_scope"))
    return art.profile_rules(profiles)


