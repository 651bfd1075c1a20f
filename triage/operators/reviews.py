"""Cookie, header, CORS, cache, third-party and finding reviews of exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import TagSet, contains_any, let, present
from triage.functions.text import CATEGORIES, redact
from triage.functions.urls import host, path, root_domain
from triage.operators.exchanges import header, header_or_empty, sensitive_material, unique_headers

COOKIE_RISKS = TagSet(rules.COOKIE_RISKS)
#: Parts into which the exchanges of a capture and host are dealt for a join.
SALTS = 64
_STRINGS = "array<string>"


def _after(text: Column, sep: str) -> Column:
    """The part after the first separator, empty without one."""
    return F.regexp_extract(text, rf"(?s)^[^{sep}]*{sep}(.*)$", 1)


def parse_set_cookie(raw: Column) -> Column:
    """struct(name, value, attributes, flags); attribute and flag names in lower case."""
    parts = F.transform(F.split(raw, ";"), lambda p: F.trim(p))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    attributes = F.transform(F.filter(rest, lambda p: p.contains("=")), lambda p: F.struct(
        F.lower(F.substring_index(p, "=", 1)).alias("name"), _after(p, "=").alias("value")))
    flags = F.transform(F.filter(rest, lambda p: ~p.contains("=")), F.lower)
    return F.struct(F.substring_index(parts[0], "=", 1).alias("name"), _after(parts[0], "=").alias("value"),
                    attributes.alias("attributes"), flags.alias("flags"))


def _attribute(parsed: Column, name: str) -> Column:
    last = F.try_element_at(F.filter(parsed["attributes"], lambda a: a["name"] == name), F.lit(-1))
    return F.coalesce(last["value"], F.lit(""))


def cookie_type(name: Column, variant: str = "review") -> Column:
    """Class of a cookie by its name; the two analyses order their rules differently."""
    low = F.lower(name)
    csrf = contains_any(low, ["csrf", "xsrf"])
    auth = contains_any(low, ["auth", "token", "jwt"])
    if variant == "review":
        return (F.when(contains_any(low, ["session", "sid", "sess"]), "session").when(auth, "auth")
                .when(csrf, "csrf").when(contains_any(low, ["analytics", "track", "_ga", "_gid"]), "tracking")
                .when(contains_any(low, ["pref", "theme", "locale", "lang"]), "preference").otherwise("unknown"))
    return (F.when(csrf, "csrf").when(low.contains("sess"), "session").when(auth, "auth")
            .when(contains_any(low, ["ga", "track"]), "tracking")
            .when(contains_any(low, ["theme", "pref"]), "preference").otherwise("unknown"))


def set_cookies(exchanges: DataFrame) -> Column:
    """Raw text of every Set-Cookie header, then of every recorded response cookie."""
    headers = F.transform(F.filter("response_headers", lambda h: F.lower(h["name"]) == "set-cookie"),
                          lambda h: F.coalesce(h["value"], F.lit("")))
    recorded = F.transform("response_cookies", lambda k: F.concat(
        F.coalesce(k["name"], F.lit("")), F.lit("="), F.coalesce(k["value"], F.lit(""))))
    return F.concat(headers, recorded)


def review_cookies(exchanges: DataFrame) -> DataFrame:
    """One row per (file, name, source, URL, SameSite); of equal keys the last one stays."""
    def seen(source: str, raws: Column) -> Column:
        return F.transform(raws, lambda r, i: F.struct(F.lit(source).alias("source"), r.alias("raw"),
                                                       i.alias("pos")))

    cookie_names = F.transform("request_cookies", lambda k: F.coalesce(k["name"], F.lit("")))
    header_names = F.filter(F.transform(F.split(header_or_empty(F.col("request_headers"), "cookie"), ";"),
                                        lambda p: F.trim(F.substring_index(p, "=", 1))), lambda n: n != "")
    seen_all = F.concat(seen("request cookie", cookie_names), seen("request Cookie header", header_names),
                        seen("response Set-Cookie header", set_cookies(exchanges)))
    rows = (exchanges.withColumn("source_url", redact(F.col("url")))
            .select("source_file", "entry_idx", "source_url", F.explode(seen_all).alias("s"))
            .select("source_file", "entry_idx", "source_url", "s.source", "s.raw", "s.pos"))
    response = F.col("source") == "response Set-Cookie header"
    rows = rows.withColumn("c", parse_set_cookie(F.col("raw")))
    c = F.col("c")
    flag = lambda name: response & (F.array_contains(c["flags"], name)
                                    | F.exists(c["attributes"], lambda a: a["name"] == name))
    attr = lambda name: F.when(response, _attribute(c, name)).otherwise("")
    rows = rows.select(
        "source_file", "entry_idx", "pos", "source_url", "source",
        F.when(response, c["name"]).otherwise(F.col("raw")).alias("name"), flag("secure").alias("secure"),
        flag("httponly").alias("http_only"), attr("samesite").alias("same_site"), attr("domain").alias("domain"),
        attr("path").alias("path"), attr("expires").alias("expires"), attr("max-age").alias("max_age"))
    rows = rows.withColumn("cookie_type", cookie_type(F.col("name")))
    sensitive = F.col("cookie_type").isin("session", "auth")
    notes = present(
        (~F.col("secure"), "Secure attribute is missing (warning)."),
        (sensitive & ~F.col("http_only"), "HttpOnly is missing on a likely sensitive cookie (warning)."),
        (~sensitive & ~F.col("http_only"), "HttpOnly attribute is missing (informational)."),
        (F.col("same_site") == "", "SameSite attribute is missing (informational)."))
    is_response = F.col("source") == "response Set-Cookie header"
    rows = rows.withColumn("observations", F.when(is_response, notes).otherwise(F.array().cast(_STRINGS)))
    payload = ["cookie_type", "secure", "http_only", "domain", "path", "expires", "max_age", "observations"]
    kept = rows.groupBy("source_file", "name", "source", "source_url", "same_site").agg(
        F.max_by(F.struct(*payload), F.struct("entry_idx", "pos")).alias("k"))
    return kept.select("source_file", "name", "source", "source_url", "same_site", "k.*")


def cookie_observations(exchanges: DataFrame) -> DataFrame:
    """Risk tags per cookie as seen: request headers, recorded cookies and every Set-Cookie."""
    c = F.col
    blank = F.lit("")

    def seen(location: str, response: bool, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(
            F.lit(location).alias("location"), F.lit(response).alias("response"), x["name"].alias("name"),
            x["raw"].alias("raw")))

    def named(raws: Column) -> Column:
        return F.transform(F.filter(raws, lambda r: r.contains("=")), lambda r: F.struct(
            F.substring_index(F.trim(r), "=", 1).alias("name"), r.alias("raw")))

    def value(x: Column) -> Column:
        return F.coalesce(x, blank)

    header_chunks = F.split(header_or_empty(c("request_headers"), "cookie"), ";")
    set_cookie = F.transform(F.filter("response_headers", lambda h: F.lower(h["name"]) == "set-cookie"),
                             lambda h: value(h["value"]))
    requested = F.transform(F.filter("request_cookies", lambda k: value(k["name"]) != ""), lambda k: F.struct(
        k["name"].alias("name"), F.concat(k["name"], F.lit("="), value(k["value"])).alias("raw")))
    recorded = F.transform(F.filter("response_cookies", lambda k: value(k["name"]) != ""), lambda k: F.struct(
        k["name"].alias("name"),
        F.concat(k["name"], F.lit("="), value(k["value"]), F.lit("; Path="), value(k["path"]),
                 F.when(k["secure"], "; Secure").otherwise(""), F.when(k["httpOnly"], "; HttpOnly").otherwise(""),
                 F.when(value(k["sameSite"]) != "", F.concat(F.lit("; SameSite="), k["sameSite"])).otherwise("")
                 ).alias("raw")))
    all_seen = F.concat(seen("request Cookie header", False, named(header_chunks)),
                        seen("response Set-Cookie header", True, named(set_cookie)),
                        seen("HAR request cookie", False, requested), seen("HAR response cookie", True, recorded))
    rows = exchanges.select("source_file", "entry_idx", F.inline(all_seen))
    rows = rows.withColumn("k", parse_set_cookie(c("raw"))).withColumn("cookie_type", cookie_type(c("name"), "surface"))
    k, name, response = c("k"), c("name"), c("response")
    rows = rows.withColumns({
        "secure": F.array_contains(k["flags"], "secure"), "httponly": F.array_contains(k["flags"], "httponly"),
        "samesite": _attribute(k, "samesite"), "domain": _attribute(k, "domain"), "path": _attribute(k, "path"),
        "expires": _attribute(k, "expires"), "max_age": _attribute(k, "max-age").try_cast("bigint"),
        "prefix": F.when(name.startswith("__Host-"), "__Host-").when(name.startswith("__Secure-"), "__Secure-")
        .otherwise("")})
    sensitive = c("cookie_type").isin("session", "auth")
    mask = COOKIE_RISKS.mask({
        "missing-secure": response & sensitive & ~c("secure"),
        "missing-httponly": response & sensitive & ~c("httponly"),
        "missing-samesite": response & sensitive & (c("samesite") == ""),
        "broad-domain": c("domain").startswith("."),
        "host-prefix-misuse": (c("prefix") == "__Host-") & (~c("secure") | (c("domain") != "") | (c("path") != "/")),
        "secure-prefix-misuse": (c("prefix") == "__Secure-") & ~c("secure"),
        "csrf-cookie-indicator": c("cookie_type") == "csrf",
        "sensitive-request-cookie": ~response & sensitive})
    return rows.withColumn("mask", mask).select(
        F.concat(F.lit("cookie-"), F.substring(F.sha2(F.concat("source_file", "location", "name", "raw"), 256), 1, 12)
                 ).alias("id"),
        "source_file", "entry_idx", "name", "location", "cookie_type", "domain", "path",
        F.when(response, c("secure")).alias("secure"), F.when(response, c("httponly")).alias("httponly"),
        "samesite", "expires", "max_age", "prefix", COOKIE_RISKS.array(c("mask")).alias("risk_tags"),
        F.when(c("mask") != 0, "low").otherwise("info").alias("severity"),
        F.concat("name", F.lit("=<redacted-cookie-value>")).alias("redacted_evidence"))


def review_headers(exchanges: DataFrame) -> DataFrame:
    """Observed security headers and the expected ones that are absent, one row each."""
    def row(name, value, classification, observation) -> Column:
        return F.struct(name.alias("header"), value.alias("value"), classification.alias("classification"),
                        observation.alias("observation"))

    def observed(h) -> Column:
        wildcard = (h["name"] == "access-control-allow-origin") & (h["value"] == "*")
        return row(h["name"], redact(h["value"]), F.when(wildcard, "needs manual review").otherwise("informational"),
                   F.when(wildcard, "Wildcard CORS origin observed; assess with credentials and data sensitivity.")
                   .otherwise("Header observed; validate its policy in application context."))

    def missing(name) -> Column:
        return row(name, F.lit("<missing>"), F.lit("informational"), F.lit(
            "Header not observed in this response; applicability requires manual review."))

    def review(hs) -> Column:
        seen = F.filter(hs, lambda h: h["name"].isin(rules.REVIEWED_HEADERS))
        absent = F.array_except(F.array(*[F.lit(n) for n in rules.EXPECTED_HEADERS]), F.transform(hs, lambda h: h["name"]))
        return F.concat(F.transform(seen, observed), F.transform(absent, missing))

    found = let(unique_headers(F.col("response_headers")), review)
    return (exchanges.withColumn("source_url", redact(F.col("url")))
            .select("source_file", "entry_idx", "source_url", F.inline(found)))


def security_headers(exchanges: DataFrame) -> DataFrame:
    """Security headers present in a response, with content-policy weaknesses."""
    kept = F.filter(unique_headers(F.col("response_headers")), lambda h: h["name"].isin(rules.OBSERVED_SECURITY_HEADERS))
    rows = exchanges.select("source_file", "entry_idx", "url", "status", F.inline(kept)).withColumnRenamed(
        "name", "header_name")
    low = F.lower("value")
    weak = present(
        (low.contains("'unsafe-inline'"), "csp-unsafe-inline"), (low.contains("'unsafe-eval'"), "csp-unsafe-eval"),
        (low.contains("*"), "csp-wildcard"), (~low.contains("object-src"), "csp-missing-object-src"),
        (~low.contains("frame-ancestors"), "csp-missing-frame-ancestors"))
    tags = F.when(F.col("header_name") == "content-security-policy", weak).otherwise(F.array().cast(_STRINGS))
    clean = redact(F.col("value"))
    return (rows.withColumns({"risk_tags": tags, "clean": clean}).select(
        F.concat(F.lit("header-"), F.substring(F.sha2(F.concat(
            "source_file", F.col("entry_idx").cast("string"), "header_name", "value"), 256), 1, 12)).alias("id"),
        "source_file", "entry_idx", "url", F.col("status").alias("status_code"), "header_name",
        F.substring("clean", 1, 300).alias("value_summary"), "risk_tags",
        F.when(F.size("risk_tags") > 0, "low").otherwise("info").alias("severity"),
        F.concat("header_name", F.lit(": "), "clean").alias("redacted_evidence")))


def _list(text: Column) -> Column:
    return F.filter(F.split(text, "[ ,]+"), lambda x: x != "")


def cors_observations(exchanges: DataFrame) -> DataFrame:
    """Responses that name an allowed origin, with the risky combinations."""
    resp, req = F.col("response_headers"), F.col("request_headers")
    rows = exchanges.select(
        "source_file", "entry_idx", "url", header(resp, "access-control-allow-origin").alias("allow_origin"),
        (F.lower(header_or_empty(resp, "access-control-allow-credentials")) == "true").alias("allow_credentials"),
        header_or_empty(req, "origin").alias("request_origin"), header_or_empty(resp, "vary").alias("vary"),
        _list(header_or_empty(resp, "access-control-allow-methods")).alias("allow_methods"),
        _list(header_or_empty(resp, "access-control-allow-headers")).alias("allow_headers"),
        _list(header_or_empty(resp, "access-control-expose-headers")).alias("expose_headers"),
    ).filter("allow_origin is not null")
    c = F.col
    wildcard = c("allow_origin") == "*"
    reflected = (c("request_origin") != "") & (c("allow_origin") == c("request_origin"))
    tags = present(
        (wildcard, "wildcard-origin"), (c("allow_origin") == "null", "null-origin"),
        (c("allow_credentials"), "credentials-allowed"),
        (wildcard & c("allow_credentials"), "wildcard-with-credentials"),
        (reflected, "reflected-looking-origin"),
        (reflected & ~F.lower("vary").contains("origin"), "missing-vary-origin"),
        (F.array_contains("allow_methods", "*") | (F.size("allow_methods") > 5), "broad-methods"))
    return (rows.withColumn("risk_tags", tags).withColumn(
        "severity", F.when(F.size("risk_tags") > 0, "low").otherwise("info")).withColumn(
        "id", F.concat(F.lit("cors-"), F.substring(F.sha2(F.concat(
            "source_file", c("entry_idx").cast("string"), "allow_origin"), 256), 1, 12))).drop("request_origin"))


def review_cache(exchanges: DataFrame) -> DataFrame:
    """API-like or JSON responses that may be cached too freely."""
    url = F.col("url")
    relevant = (contains_any(F.lower(path(url)), rules.CACHE_PATH_WORDS)
                | F.lower("mime_type").contains("json"))
    control = F.col("cache_control")
    low = F.lower(control)
    age = F.regexp_extract(low, r"(?U)max-age\s*=\s*(\d+)", 1)
    long_lived = F.coalesce(age.try_cast("decimal(38,0)") >= 86400, age != "")
    note = (F.when(control == "", "No Cache-Control header observed on an API or sensitive-looking response.")
            .when(low.contains("public"),
                  "Cache-Control permits public caching of an API or sensitive-looking response.")
            .when(long_lived, "A long cache max-age was observed on an API or sensitive-looking response."))
    return (exchanges.filter(relevant)
            .select("source_file", "entry_idx", "url",
                    header_or_empty(F.col("response_headers"), "cache-control").alias("cache_control"))
            .withColumn("observation", note).filter("observation is not null")
            .select("source_file", "entry_idx", redact(url).alias("source_url"),
                    F.lit("needs manual review").alias("classification"), "observation",
                    redact(F.when(control == "", "<missing>").otherwise(control)).alias("cache_control")))


def is_sensitive_context(exchanges: DataFrame) -> Column:
    return F.concat("url", "response_body").rlike(rules.SENSITIVE_CONTEXT)


def cache_observations(exchanges: DataFrame) -> DataFrame:
    """Cache metadata of responses in a sensitive context."""
    resp = F.col("response_headers")
    rows = exchanges.select(
        "source_file", "entry_idx", "url", "status", is_sensitive_context(exchanges).alias("sensitive_context"),
        header_or_empty(resp, "cache-control").alias("cache_control"),
        header_or_empty(resp, "pragma").alias("pragma"), header_or_empty(resp, "expires").alias("expires"),
        F.when(F.col("mime_type") != "", F.col("mime_type")).otherwise(header_or_empty(resp, "content-type"))
        .alias("content_type")).filter("sensitive_context")
    control = F.col("cache_control")
    age = F.regexp_extract(control, r"(?Ui)max-age=(\d+)", 1)
    tags = present(
        (control == "", "sensitive-response-missing-cache-control"),
        (F.lower(control).contains("public"), "sensitive-response-public-cache"),
        (F.coalesce(age.try_cast("decimal(38,0)") > 3600, age != ""), "sensitive-response-long-max-age"))
    return (rows.withColumn("risk_tags", tags).filter(F.size("risk_tags") > 0).select(
        F.concat(F.lit("cache-"), F.substring(F.sha2(F.concat(
            "source_file", F.col("entry_idx").cast("string"), "url"), 256), 1, 12)).alias("id"),
        "source_file", "entry_idx", "url", F.col("status").alias("status_code"), "cache_control", "pragma", "expires",
        "content_type", "sensitive_context", "risk_tags", F.lit("low").alias("severity")))


def _hosts(exchanges: DataFrame) -> DataFrame:
    return exchanges.select("source_file", "entry_idx", F.upper("method").alias("method"), "url",
                            host(F.col("url")).alias("host"))


def primary_hosts(exchanges: DataFrame) -> DataFrame:
    """Host of the first entry of each capture.

    Entries are reduced to one row per (file, host) first, so the second grouping
    sees a capture's hosts, not its entries.
    """
    per_host = _hosts(exchanges).groupBy("source_file", "host").agg(F.min("entry_idx").alias("first_idx"))
    return per_host.groupBy("source_file").agg(F.min_by("host", "first_idx").alias("primary_host"))


def _outside(per_host: DataFrame, exchanges: DataFrame) -> DataFrame:
    outside = (F.col("host") != "") & (root_domain(F.col("host")) != root_domain(F.col("primary_host")))
    return per_host.join(primary_hosts(exchanges), "source_file").filter(outside).drop("primary_host")


def third_parties(exchanges: DataFrame) -> DataFrame:
    """Hosts outside a capture's root domain: requests, methods, leaked categories; their URLs are ``third_party_urls``.

    All exchanges are scanned for sensitive values: what is found belongs to the host of its redacted URL, and redaction can
    take a host's place (``me@app.test`` and a host written as ``<redacted-email>``).  Both sides are reduced to one row per file and
    host before they are joined.
    """
    rows = _hosts(exchanges)
    counted = rows.groupBy("source_file", "host", "method").agg(F.count("*").alias("n"))
    per_host = counted.groupBy("source_file", "host").agg(
        F.sum("n").alias("request_count"), F.array_sort(F.collect_set("method")).alias("methods"))
    # what is found for one host of a large capture is reduced in parts first
    found = sensitive_material(exchanges).select(
        "source_file", host(F.col("source_url")).alias("host"), F.pmod(F.xxhash64("source_url", "name"), F.lit(SALTS)).alias("salt"),
        CATEGORIES.mask({n: F.col("category") == n for n in CATEGORIES.names}).alias("m"))
    leaked = found.groupBy("source_file", "host", "salt").agg(F.bit_or("m").alias("m")).groupBy("source_file", "host").agg(F.bit_or("m").alias("m"))
    return _outside(per_host, exchanges).join(leaked, ["source_file", "host"], "left").select(
        "source_file", "host", "request_count", "methods",
        CATEGORIES.array(F.coalesce("m", F.lit(0).cast("long"))).alias("sensitive_categories"))


def third_party_urls(exchanges: DataFrame) -> DataFrame:
    """The distinct redacted URLs behind ``third_parties``: (source_file, host, source_url, requests)."""
    per_url = (_hosts(exchanges).groupBy("source_file", "host", redact(F.col("url")).alias("source_url"))
               .agg(F.count("*").alias("requests")))
    per_host = per_url.select("source_file", "host").distinct()
    kept = _outside(per_host, exchanges)
    return per_url.join(kept, ["source_file", "host"], "left_semi")


def _finding_id(*parts) -> Column:
    return F.concat(F.lit("HAR-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10)))


def har_findings(sensitive: DataFrame, cache: DataFrame) -> DataFrame:
    """Sensitive-material and cache reviews as findings with fixed wording."""
    leaks = sensitive.select(
        _finding_id("category", "location", "source_url").alias("id"), "source_file",
        F.concat(F.lit("Sensitive material observed in "), "location").alias("title"),
        F.col("category").alias("type"), F.lit("info").alias("severity"), F.lit("high").alias("confidence"),
        F.col("source_url").alias("asset"),
        F.concat("name", F.lit(": "), "redacted_value").alias("redacted_evidence"),
        F.lit("Captured HAR data may expose sensitive material if shared or stored insecurely.").alias("impact"),
        F.lit("Confirm necessity, rotate exposed test values when appropriate, and share only redacted captures.")
        .alias("recommendation"), "location")
    cached = cache.select(
        _finding_id(F.lit("cache-review"), "observation", "source_url").alias("id"), "source_file",
        F.lit("Response caching needs manual review").alias("title"), F.lit("risky-cache").alias("type"),
        F.lit("info").alias("severity"), F.lit("medium").alias("confidence"), F.col("source_url").alias("asset"),
        F.col("observation").alias("redacted_evidence"),
        F.lit("Shared or long-lived caching may expose response data depending on application context.")
        .alias("impact"),
        F.lit("Review response sensitivity and intended intermediary/browser caching behavior.")
        .alias("recommendation"), F.lit("response header").alias("location"))
    return leaks.unionByName(cached)
