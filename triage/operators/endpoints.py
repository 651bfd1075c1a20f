"""Endpoint inventory: observations, groups, tags and checklists.

Tag-like sets (risk tags, auth indicators, object ids) are bit masks, so a group
with a third of all rows still costs one fixed-width buffer per task.  Sets with
open vocabularies (parameter, key and header names, status codes, MIME types,
sources) are long tables keyed by the endpoint id; no row ever holds a list that
grows with its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.jsonwalk import distinct_json_keys
from triage.functions.tags import TagSet, key_id, let
from triage.functions.text import pattern_hits, redact
from triage.functions.urls import (
    OBJECT_IDS, RISKS, host, netloc, normalize_path, object_id_mask, path, query, query_params, risk_mask, scheme,
)

AUTH = TagSet(rules.AUTH_INDICATORS)
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def auth_mask(headers: Column, has_cookies: Column) -> Column:
    """Ways an exchange authenticates, as a mask over ``AUTH``."""
    def some(test):
        return F.exists(headers, test)

    lower = lambda h: F.lower(h["name"])
    found = AUTH.mask({
        "bearer token": some(lambda h: (lower(h) == "authorization") & F.lower(h["value"]).startswith("bearer ")),
        "basic auth": some(lambda h: (lower(h) == "authorization") & F.lower(h["value"]).startswith("basic ")),
        "API key": some(lambda h: lower(h).contains("api") & lower(h).contains("key")),
        "CSRF token": some(lambda h: lower(h).contains("csrf") | lower(h).contains("xsrf")),
        "cookie auth": some(lambda h: lower(h) == "cookie") | has_cookies,
    })
    return F.when(found == 0, AUTH.mask({"unauthenticated observed": F.lit(True)})).otherwise(found)


def auth_indicators(headers: Column, has_cookies: Column) -> Column:
    return AUTH.array(auth_mask(headers, has_cookies))


def _describe(df: DataFrame) -> DataFrame:
    """Fill the derived endpoint columns from ``raw_url`` and the name sets."""
    df = df.withColumns({"scheme": scheme(F.col("raw_url")), "host": host(F.col("raw_url")),
                         "raw_path": path(F.col("raw_url"))})
    df = df.withColumn("path", F.when(F.col("raw_path") == "", "/").otherwise(F.col("raw_path")))
    df = df.withColumns({
        "normalized_path": normalize_path(F.col("path")),
        "query_params": F.array_sort(F.array_union(F.col("query_params"), query_params(query(F.col("raw_url"))))),
        "url": F.when(F.col("scheme") != "", F.concat("scheme", F.lit("://"), netloc(F.col("raw_url")), "path"))
        .otherwise(F.col("path")),
    })
    df = df.withColumns({
        "low_path": F.lower("path"),
        "low_names": F.transform(F.concat("query_params", "body_params", "json_keys"), lambda n: F.lower(n))})
    df = df.withColumn("object_mask", object_id_mask(F.col("low_names"), F.col("normalized_path")))
    df = df.withColumn("risk_mask", risk_mask(F.col("low_path"), F.col("method"), F.col("object_mask"), F.col("scheme")))
    return df.withColumn("endpoint_id", key_id("ep", F.col("method"), F.col("host"), F.col("normalized_path"))
                         ).drop("raw_path", "low_path", "low_names")


def _distinct_names(pairs: Column) -> Column:
    names = F.transform(pairs, lambda p: F.coalesce(p["name"], F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def endpoints_from_exchanges(exchanges: DataFrame) -> DataFrame:
    """One endpoint observation per exchange."""
    c = F.col
    keys = F.array_sort(F.array_union(distinct_json_keys(c("request_body")), distinct_json_keys(c("response_body"))))
    headers = F.concat(c("request_headers"), c("response_headers"))
    return _describe(exchanges.select(
        "source_file", "entry_idx", F.lit(0).alias("pos"), c("url").alias("raw_url"),
        F.upper("method").alias("method"), _distinct_names(c("query_string")).alias("query_params"),
        _distinct_names(c("form_params")).alias("body_params"), keys.alias("json_keys"),
        F.array_sort(F.array_distinct(F.transform(headers, lambda h: h["name"]))).alias("header_names"),
        c("status"), c("mime_type"), F.lit(None).cast("int").alias("line"), F.lit("har").alias("source_type"),
        auth_mask(c("request_headers"), F.size("request_cookies") > 0).alias("auth_mask")))


def endpoints_from_text(artifacts: DataFrame) -> DataFrame:
    """Endpoint-like strings of scripts, pages and text.

    Every call site counts; an absolute URL or a quoted path counts once per file
    and only if no earlier kind has claimed the same string.
    """
    text = F.col("text")
    kind = "array<struct<raw:string,method:string,line:int>>"

    def hit(raw, method, line):
        return F.struct(raw.alias("raw"), method.alias("method"), line.alias("line"))

    calls = F.transform(pattern_hits(text, rules.CALL_SITE, (1, 2, 3)), lambda m: hit(
        m["g3"], F.when(m["g2"] != "", F.upper(m["g2"]))
        .when(F.lower(m["g1"]).contains("eventsource"), F.lit("GET")).otherwise(F.lit("UNKNOWN")), m["line"]))
    plain = lambda group: lambda m: hit(m[group], F.lit("UNKNOWN"), m["line"])
    absolute = F.transform(pattern_hits(text, rules.ABSOLUTE_URL, (0,)), plain("g0"))
    quoted = F.transform(pattern_hits(text, rules.QUOTED_PATH, (2,)), plain("g2"))

    def of(hits: Column, is_call: bool) -> Column:
        return F.transform(hits.cast(kind), lambda x: F.struct(x["raw"].alias("raw"), x["method"].alias("method"), x["line"].alias("line"), F.lit(is_call).alias("call")))

    def claimed(hits: Column) -> Column:
        """Calls, and of the other strings the first place of each that no kind before has; one sort by string, one back by place."""
        places = F.transform(hits, lambda x, i: F.struct(x["raw"].alias("raw"), i.alias("pos"), x["method"].alias("method"), x["line"].alias("line"), x["call"].alias("call")))
        kept = let(F.array_sort(places), lambda ps: F.filter(ps, lambda x, i: x["call"] | (i == 0) | (F.get(ps, i - 1)["raw"] != x["raw"])))
        return F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"), x["method"].alias("method"), x["line"].alias("line"))))

    scanned = artifacts.select(
        "source_file", "suffix", F.concat(of(calls, True), of(absolute, False), of(quoted, False)).alias("hits"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.FORM_NAME), F.lit(1)))).alias("forms"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.ID_NAME), F.lit(1)))).alias("ids"))
    # no filter on the hits: Catalyst would copy it, and every scan in it, down to the table's own splits; explode drops texts without any
    rows = scanned.select("source_file", "suffix", "forms", "ids", F.explode(claimed(F.col("hits"))).alias("h")).select(
        "source_file", "suffix", "forms", "ids", F.col("h.pos").alias("pos"), "h")
    return _describe(rows.select(
        "source_file", F.lit(0).cast("bigint").alias("entry_idx"), "pos", F.col("h.raw").alias("raw_url"),
        F.col("h.method").alias("method"), _none().alias("query_params"),
        F.when(F.col("suffix").isin(".html", ".htm"), F.col("forms")).otherwise(_none()).alias("body_params"),
        F.col("ids").alias("json_keys"), _none().alias("header_names"), F.lit(None).cast("int").alias("status"),
        F.lit(None).cast("string").alias("mime_type"), F.col("h.line").alias("line"),
        F.ltrim(F.col("suffix"), F.lit(".")).alias("source_type"),
        AUTH.mask({"unknown": F.lit(True)}).alias("auth_mask")))


def object_ids(names: Column, normalized: Column) -> Column:
    return OBJECT_IDS.array(object_id_mask(F.transform(names, lambda n: F.lower(n)), normalized))


def risk_tags(raw_path: Column, method: Column, object_mask: Column, url_scheme: Column) -> Column:
    return RISKS.array(risk_mask(F.lower(raw_path), method, object_mask, url_scheme))


def merge_endpoints(observed: DataFrame) -> DataFrame:
    """One row per (method, host, normalized path); scalars come from the first observation."""
    order = F.struct("source_file", "entry_idx", "pos")
    merged = observed.groupBy("method", "host", "normalized_path").agg(
        F.count("*").alias("occurrences"), F.bit_or("risk_mask").alias("risk_mask"),
        F.bit_or("auth_mask").alias("auth_mask"), F.bit_or("object_mask").alias("object_mask"),
        F.min_by(F.struct("endpoint_id", "scheme", "path", "url", "source_file"), order).alias("first"))
    return merged.select(
        "first.endpoint_id", "method", "first.scheme", "host", "first.path", "normalized_path", "first.url",
        "first.source_file", "occurrences", AUTH.array(F.col("auth_mask")).alias("auth_indicators"),
        OBJECT_IDS.array(F.col("object_mask")).alias("object_id_candidates"),
        RISKS.array(F.col("risk_mask")).alias("risk_tags"), "risk_mask")


def endpoint_values(observed: DataFrame) -> DataFrame:
    """Distinct open-vocabulary values per endpoint: (endpoint_id, field, value, observations)."""
    def tagged(field: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    single = lambda c: F.array_compact(F.array(c))
    pairs = F.concat(*[tagged(f, F.col(f)) for f in ("query_params", "body_params", "json_keys", "header_names")],
                     tagged("status_codes", single(F.col("status").cast("string"))),
                     tagged("mime_types", single(F.col("mime_type"))))
    return (observed.select("endpoint_id", F.explode(pairs).alias("p"))
            .groupBy("endpoint_id", "p.field", "p.value").agg(F.count("*").alias("observations")))


def endpoint_sources(observed: DataFrame) -> DataFrame:
    """Where each endpoint was seen, one row per observation, redacted."""
    return observed.select("endpoint_id", F.col("source_type").alias("type"), "source_file", "entry_idx",
                           redact(F.col("raw_url")).alias("url"), "line")


def endpoint_arrays(observed: DataFrame) -> DataFrame:
    """The long value table folded into sorted arrays, one row per endpoint and field.

    For consumers that need the list form; distinct values are reduced before the fold.
    """
    return (endpoint_values(observed).groupBy("endpoint_id", "field")
            .agg(F.array_sort(F.collect_list("value")).alias("values")))


def har_endpoints(exchanges: DataFrame) -> DataFrame:
    """(method, host, raw path) groups with their first URL and request count."""
    u = F.col("url")
    raw = F.when(path(u) == "", "/").otherwise(path(u))
    return (exchanges.select(F.upper("method").alias("method"), host(u).alias("host"), raw.alias("path"),
                             F.concat(scheme(u), F.lit("://"), netloc(u), raw).alias("endpoint_url"),
                             F.struct("source_file", "entry_idx").alias("o"))
            .groupBy("method", "host", "path")
            .agg(F.min_by("endpoint_url", "o").alias("url"), F.count("*").alias("count")))


def har_endpoint_values(exchanges: DataFrame) -> DataFrame:
    """Query parameters (blank values dropped), statuses and MIME types of those groups."""
    u = F.col("url")

    def tagged(field, values):
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    mime = F.when(F.col("mime_type") == "", "unknown").otherwise(F.col("mime_type"))
    pairs = F.concat(tagged("query_parameters", query_params(query(u), keep_blank=False)),
                     tagged("status_codes", F.array(F.col("status").cast("string"))),
                     tagged("mime_types", F.array(mime)))
    return (exchanges.select(F.upper("method").alias("method"), host(u).alias("host"),
                             F.when(path(u) == "", "/").otherwise(path(u)).alias("path"), F.explode(pairs).alias("p"))
            .groupBy("method", "host", "path", "p.field", "p.value").agg(F.count("*").alias("observations")))


def high_interest(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(F.arrays_overlap("risk_tags", F.array(*[F.lit(t) for t in rules.HIGH_INTEREST_TAGS])))


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    """Endpoint, host and tagged-endpoint counts of a merged inventory."""
    return endpoints.agg(
        F.count("*").alias("endpoint_count"),
        F.countDistinct(F.when(F.col("host") != "", F.col("host"))).alias("host_count"),
        F.coalesce(F.sum(F.when(F.size("risk_tags") > 0, 1).otherwise(0)), F.lit(0)).alias("high_interest_count"))


def endpoint_hosts(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter("host != ''").select("host").distinct()


def checklist(endpoints: DataFrame) -> DataFrame:
    """Endpoint × tag × review question with its priority."""
    questions = [F.struct(F.lit(t).alias("category"), F.lit(q).alias("question"),
                          F.lit("high" if t in rules.HIGH_PRIORITY_QUESTION_TAGS else "medium").alias("priority"))
                 for t, qs in rules.ENDPOINT_QUESTIONS.items() for q in qs]
    asked = F.filter(F.array(*questions), lambda q: F.array_contains(F.col("risk_tags"), q["category"]))
    return (endpoints.select("endpoint_id", F.inline(asked))
            .withColumn("reason", F.concat(F.lit("Endpoint is tagged "), "category", F.lit("."))))


def api_client_hints(routes: DataFrame) -> DataFrame:
    """Routes found in code that name a host or carry a risk tag."""
    return (routes.filter((F.col("host") != "") | (F.col("risk_mask") != 0))
            .select("source_file", F.coalesce("line", F.lit(1)).alias("line"), "method",
                    redact(F.col("url")).alias("url")))
