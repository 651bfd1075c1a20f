"""Tokens, authentication endpoints and session review leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import TagSet, key_id, present, word_rules
from triage.functions.urls import netloc, path, scheme

AUTH_TAGS = TagSet(list(rules.AUTH_TAG_WORDS))
_STRINGS = "array<string>"
_LOCATIONS = ["request URL", "HAR request", "HAR response", "local file"]


def _tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rules.JWT_TOKEN), F.lit(0))
    return F.when(text.contains("eyJ"), found).otherwise(F.array().cast(_STRINGS))


def _pairs_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["name"], p["value"])), "\n")


def jwt_candidates(exchanges: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """Distinct token candidates per file: (source_file, token, location, occurrences).

    The first location (URL, request, response) names a token of a capture; text
    files keep the count of repeats.
    """
    parts = []
    if exchanges is not None:
        c = F.col
        request = F.concat_ws("\n", "url", "request_body", _pairs_text(c("request_headers")),
                              _pairs_text(c("query_string")), _pairs_text(c("request_cookies")),
                              _pairs_text(c("form_params")))
        response = F.concat_ws("\n", "response_body", _pairs_text(c("response_headers")), F.array_join(
            F.transform("response_cookies", lambda k: F.concat_ws(" ", k["name"], k["value"])), "\n"))

        def spot(rank, text):
            return F.transform(_tokens(text), lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("token")))

        spots = [spot(i, t) for i, t in enumerate([c("url"), request, response])]
        parts.append(exchanges.select("source_file", F.lit(True).alias("capture"), F.inline(F.concat(*spots))))
    if artifacts is not None:
        parts.append(artifacts.select("source_file", F.lit(False).alias("capture"), F.lit(3).alias("rank"),
                                      F.explode(_tokens(F.col("text"))).alias("token")))
    rows = reduce(DataFrame.unionByName, parts)
    seen = rows.groupBy("source_file", "capture", "token").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return seen.select("source_file", "token",
                       F.element_at(F.array(*[F.lit(x) for x in _LOCATIONS]), F.col("rank") + 1).alias("location"),
                       F.when(F.col("capture"), 1).otherwise(F.col("n")).cast("bigint").alias("occurrences"))


def _part(token: Column, index: int) -> Column:
    raw = F.substring_index(F.substring_index(token, ".", index), ".", -1)
    standard = F.translate(raw, "-_", "+/")
    text = F.try_to_binary(standard, F.lit("base64"))
    return F.try_validate_utf8(F.coalesce(text, F.try_to_binary(F.rpad(
        standard, F.ceil(F.length(standard) / 4) * 4, F.lit("=")), F.lit("base64"))).cast("string"))


def _text(v: Column, *names: str) -> Column:
    got = [F.try_variant_get(v, f"$.{n}", "string") for n in names]
    return F.coalesce(*got, F.lit(""))


def _list(v: Column, *names: str) -> Column:
    """A claim as a list: arrays as they are, text split on blanks and commas; the first name present."""
    def one(name):
        as_array = F.try_variant_get(v, f"$.{name}", _STRINGS)
        as_text = F.try_variant_get(v, f"$.{name}", "string")
        is_array = F.get_json_object(F.to_json(F.try_variant_get(v, f"$.{name}", "variant")), "$[0]").isNotNull()
        return F.when(is_array, as_array).otherwise(F.filter(F.split(as_text, "[ ,]+"), lambda x: x != ""))
    return F.coalesce(*[one(n) for n in names], F.array().cast(_STRINGS))


def _epoch(v: Column, name: str) -> Column:
    """Whole epoch seconds of a claim; NULL if absent, not a number, or outside years 1 to 9999."""
    seconds = F.try_variant_get(v, f"$.{name}", "double").cast("decimal(38,6)").try_cast("bigint")
    return F.when(seconds.between(-62135596800, 253402300799), seconds)


def decode_jwt(candidates: DataFrame, as_of: str) -> DataFrame:
    """Header and claims of each token, without any signature check, and its risk tags.

    ``as_of`` is the reference time of expiry tags, so that a run can be repeated.
    """
    decoded = candidates.withColumns({
        "h": F.try_parse_json(_part(F.col("token"), 1)), "p": F.try_parse_json(_part(F.col("token"), 2))})
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    decoded = decoded.filter(is_object(F.col("h")) & is_object(F.col("p")))
    h, p = F.col("h"), F.col("p")
    keys = F.json_object_keys(F.to_json(p))
    both = lambda *names: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(
        F.col("claim_keys"), n))
    digest = F.sha2("token", 256)
    claims = decoded.withColumn("claim_keys", keys).select(
        key_id("jwt", F.col("token")).alias("id"), F.substring(digest, 1, 16).alias("token_fingerprint"),
        "source_file", "location", "occurrences", _text(h, "alg").alias("algorithm"),
        _text(h, "typ").alias("token_type"), _text(h, "kid").alias("key_id"), _text(p, "iss").alias("issuer"),
        F.array_contains("claim_keys", "sub").alias("subject_present"), _list(p, "aud").alias("audience"),
        _epoch(p, "iat").alias("iat"), _epoch(p, "nbf").alias("nbf"), _epoch(p, "exp").alias("exp"),
        F.array_sort(F.array_union(_list(p, "scope"), _list(p, "scp"))).alias("scopes"),
        _list(p, "roles", "role").alias("roles"), _list(p, "permissions").alias("permissions"),
        both("tenant", "tenantId").alias("tenant_claims"), both("org", "orgId").alias("org_claims"),
        both("email", "username", "name").alias("sensitive_claims"),
        F.array_sort(F.array_except("claim_keys", F.array(*[F.lit(x) for x in rules.STANDARD_CLAIMS])))
        .alias("custom_claim_keys"),
        F.concat(F.lit("<redacted-jwt:"), F.substring(digest, 1, 12), F.lit(">")).alias("redacted_evidence"))
    return jwt_risks(claims, as_of)


def jwt_risks(claims: DataFrame, as_of: str) -> DataFrame:
    """Risk tags and severity of decoded tokens at the time ``as_of``."""
    c = F.col
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    lifetime = c("exp") - c("iat")
    low_place = F.lower("location")
    tags = present(
        (c("exp").isNull(), "missing-exp"), (lifetime > 86400, "long-lifetime"), (c("exp") < now, "expired"),
        (F.floor((c("exp") - now) / 86400) > 365, "far-future-expiry"),
        (F.exists("roles", lambda r: r.rlike("(?i)admin|owner|superuser")), "admin-like-role"),
        (F.size("sensitive_claims") > 0, "sensitive-claims"), (F.size("audience") == 0, "missing-audience"),
        (c("issuer") == "", "missing-issuer"),
        (low_place.contains("url") | low_place.contains("query"), "token-in-url"),
        (F.lower("algorithm").isin("none", "hs256", "hs384", "hs512"), "unusual-algorithm-manual-review"),
        (F.size("tenant_claims") > 0, "tenant-claims"), (F.size("org_claims") > 0, "org-claims"))
    tagged = claims.withColumns({"lifetime_seconds": lifetime, "risk_tags": tags})
    severity = (F.when(F.array_contains("risk_tags", "token-in-url"), "medium")
                .when(F.size("risk_tags") > 0, "low").otherwise("info"))
    return tagged.withColumns({"severity": severity, "confidence": F.lit("high")})


def auth_endpoints(exchanges: DataFrame | None = None, artifacts: DataFrame | None = None,
                   inventories: DataFrame | None = None, legacy_key: bool = False) -> DataFrame:
    """Authentication-related URLs of captures, saved endpoint inventories and plain text.

    One row per (method, host, path), taken from the first source; ``legacy_key``
    leaves the host out of the identity.
    """
    parts = []
    if exchanges is not None:
        parts.append(exchanges.select("source_file", F.col("entry_idx").alias("ord"), "method", "url"))
    if inventories is not None:
        parts.append(inventories.select("source_file", F.col("entry_idx").alias("ord"), "method", "url"))
    if artifacts is not None:
        found = F.regexp_extract_all("text", F.lit(rules.URLS_IN_TEXT), F.lit(0))
        parts.append(artifacts.select("source_file", F.posexplode(found).alias("ord", "url"))
                     .select("source_file", F.col("ord").cast("bigint").alias("ord"),
                             F.lit("UNKNOWN").alias("method"), "url"))
    u = F.col("url")
    # one pattern over all words keeps the other URLs away from the tag rules
    words = "|".join(w for ws in rules.AUTH_TAG_WORDS.values() for w in ws)
    rows = (reduce(DataFrame.unionByName, parts).withColumn("low", F.lower(u)).filter(F.col("low").rlike(words))
            .withColumn("mask", AUTH_TAGS.mask(word_rules(F.col("low"), rules.AUTH_TAG_WORDS))))
    where = F.when(path(u) == "", u).otherwise(path(u))
    rows = rows.select("source_file", "ord", "method", where.alias("path"), netloc(u).alias("host"),
                       scheme(u).alias("scheme"), "url", "mask")
    keys = ["method", "path"] if legacy_key else ["method", "host", "path"]
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct("source_file", "scheme", "host", "url", "mask"), F.struct("source_file", "ord")).alias("f"),
        F.count("*").alias("occurrences"))
    ident = ("method", "path") if legacy_key else ("method", "f.host", "path")
    return first.select(
        F.concat(F.lit("auth-endpoint-"), F.substring(F.sha2(F.concat(*ident), 256), 1, 12)).alias("id"),
        "method", "f.scheme", "f.host", "path", "f.url", "f.source_file", "occurrences",
        AUTH_TAGS.array(F.col("f.mask")).alias("risk_tags"), F.col("f.mask").alias("tag_mask"))


def session_leads(endpoints: DataFrame, cookies: DataFrame) -> DataFrame:
    """Review questions raised by the tags and cookie types present: (ord, question)."""
    n = len(rules.ALWAYS_ASKED)
    seen = (endpoints.agg(F.coalesce(F.bit_or("tag_mask"), F.lit(0).cast("long")).alias("mask"), F.lit(False).alias("csrf"))
            .unionByName(cookies.agg(F.lit(0).cast("long").alias("mask"), F.coalesce(
                F.bool_or(F.col("cookie_type") == "csrf"), F.lit(False)).alias("csrf")))
            .agg(F.bit_or("mask").alias("mask"), F.bool_or("csrf").alias("csrf")))

    def row(order, question):
        return F.struct(F.lit(order).alias("ord"), F.lit(question).alias("question"))

    asked = [row(i, q) for i, q in enumerate(rules.ALWAYS_ASKED)]
    asked += [F.when(AUTH_TAGS.has(F.col("mask"), t), row(n + i, q)) for i, (t, q) in enumerate(rules.SESSION_QUESTIONS)]
    asked.append(F.when(F.col("csrf"), row(n + len(rules.SESSION_QUESTIONS), rules.CSRF_QUESTION)))
    return (seen.select(F.inline(F.array_compact(F.array(*asked))))
            .groupBy("question").agg(F.min("ord").alias("ord")).select("ord", "question"))


def merge_observations(observed: DataFrame) -> DataFrame:
    """Per id keep the rows of the first file that has it.

    Rows are first reduced to one per (id, file) with a count, so repeats inside a
    file stay as ``occurrences`` and a hot id is a handful of rows per task.
    """
    payload = [c for c in observed.columns if c not in ("id", "source_file", "occurrences")]
    has_count = "occurrences" in observed.columns
    count = F.sum("occurrences") if has_count else F.count("*")
    per_file = observed.groupBy("id", "source_file").agg(
        count.alias("n"), F.min_by(F.struct(*payload), F.to_json(F.struct(*payload))).alias("p"))
    first = per_file.groupBy("id").agg(F.min_by(F.struct("source_file", "n", "p"), "source_file").alias("f"))
    return first.select("id", "f.source_file", F.col("f.n").alias("occurrences"), "f.p.*")


def auth_summary(**tables: DataFrame) -> DataFrame:
    """(observation_kind, observations) per table."""
    counts = [t.agg(F.count("*").alias("observations")).select(F.lit(k).alias("observation_kind"), "observations")
              for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def jwt_checklist(tokens: DataFrame) -> DataFrame:
    """One review item per token and risk tag."""
    return (tokens.select("token_fingerprint", F.explode("risk_tags").alias("tag"))
            .select("token_fingerprint", "tag", F.concat(
                F.lit("Review "), F.replace("tag", F.lit("-"), F.lit(" ")), F.lit(" signal for token "),
                "token_fingerprint", F.lit(".")).alias("item")))
