"""Vocabulary of a target: terms, scores, tags and word lists.

Tokens are counted as raw text first (a hash aggregate that shrinks in every
task before the shuffle); cleaning, filtering and classifying then run once per
distinct spelling instead of once per token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triage import rules
from triage.functions.jsonwalk import json_keys
from triage.functions.tags import TagSet, contains_any, is_in, key_id, word_rules
from triage.functions.text import strip
from triage.functions.urls import path, unquote

TERM_TAGS = TagSet(list(rules.TERM_TAG_WORDS))


def _unquoted(text: Column) -> Column:
    return F.trim(strip(unquote(text)), F.lit("\"'`"))


def normalize_term(text: Column) -> Column:
    """Percent-decode, trim, drop quotes, collapse blanks, lower-case; '+' stays."""
    return F.lower(F.regexp_replace(_unquoted(text), r"(?U)\s+", " "))


def split_term(text: Column) -> Column:
    """Words of a camelCase or separated term, in lower case."""
    camel = F.regexp_replace(_unquoted(text), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.transform(F.filter(F.split(camel, r"(?U)[/_.\-\s:{}\[\]()]+"), lambda w: w != ""), F.lower)


def is_useful(normalized: Column) -> Column:
    n = normalized
    return ((n != "") & ~is_in(n, rules.STOPWORDS) & F.length(n).between(2, 180) & ~n.rlike(r"^\p{Nd}+\z")
            & ~(n.rlike("bearer|eyj|secret|password|token|api|session") & n.rlike(rules.SECRET_LOOKING_TERM))
            & ~n.startswith("<redacted-"))


def classify_term(normalized: Column, default: Column) -> Column:
    first, *rest = rules.TERM_CATEGORY_WORDS
    chain = F.when(contains_any(normalized, first[1]), first[0])
    for category, words in rest:
        chain = chain.when(contains_any(normalized, words), category)
    return chain.otherwise(default)


def frequency_score(count: Column) -> Column:
    return F.least(F.lit(100), F.bround(20 * F.log2(count + 1)).cast("int"))


def term_risk(normalized: Column) -> Column:
    parts = [F.when(normalized.contains(w), weight).otherwise(0) for w, weight in rules.RISK_WORDS.items()]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, parts))


def term_tag_mask(normalized: Column, category: Column) -> Column:
    conds = word_rules(normalized, rules.TERM_TAG_WORDS)
    owned = (category == "object_name") | normalized.endswith("id")
    conds["graphql"] = conds["graphql"] | category.startswith("graphql")
    conds["idor"] = conds["idor"] | owned
    conds["bola"] = conds["bola"] | owned
    return TERM_TAGS.mask(conds)


def _terms(values: Column, category: str, context: str, classify: bool = False) -> Column:
    """Values of one kind; the kind is stated once per list, not once per value."""
    return F.struct(values.cast("array<string>").alias("values"), F.lit(category).alias("category"),
                    F.lit(classify).alias("classify"), F.lit(context).alias("context"))


def _one(value: Column) -> Column:
    return F.array(value)


def _parts(values: Column, context: str) -> Column:
    return _terms(F.flatten(F.transform(values, split_term)), "route_segment", context, True)


def _emit(df: DataFrame, source_type: Column, *kinds: Column) -> DataFrame:
    lists = df.select("source_file", source_type.alias("source_type"), F.inline(F.array(*kinds)))
    return lists.select("source_file", "source_type", "category", "classify", "context", F.explode("values").alias("value"))


def _names(pairs: str) -> Column:
    return F.transform(pairs, lambda p: p["name"])


def terms_from_exchanges(exchanges: DataFrame) -> DataFrame:
    """Raw terms of captures: paths, segments, parameter, header and cookie names, body keys."""
    c = F.col
    p = path(c("url"))
    return _emit(
        exchanges, F.lit("har"),
        _terms(_one(F.when(p == "", "/").otherwise(p)), "endpoint_path", "request URL"),
        _parts(_one(p), "request route"), _terms(_names("query_string"), "query_param", "query"),
        _terms(_names("request_headers"), "header_name", "request header"),
        _terms(_names("request_cookies"), "cookie_name", "request cookie"),
        _terms(_names("response_headers"), "header_name", "response header"),
        _terms(_names("response_cookies"), "cookie_name", "response cookie"),
        _terms(_names("form_params"), "body_param", "request body"),
        _terms(json_keys(c("request_body")), "json_key", "JSON key", True),
        _terms(json_keys(c("response_body")), "response_key", "JSON key", True))


def _found(pattern: str, group: int, *words: str) -> Column:
    """All matches in ``text``; the pattern runs only where one of the words occurs (lower-cased words anywhere)."""
    got = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    if not words:
        return got
    return F.when(contains_any(F.col("lowered"), words), got).otherwise(F.array().cast("array<string>"))


def terms_from_text(artifacts: DataFrame) -> DataFrame:
    """Raw terms of texts: paths, form fields, properties, headers, cookies, storage keys, identifiers."""
    headers = ("x-", "authorization", "content-type", "accept-language")
    operations = ("query", "mutation", "subscription")
    routes = F.transform(_found(rules.TERM_PATH, 1, "/"), lambda r: F.rtrim(r, F.lit(".,;)")))
    dotted = (".", "'", '"')
    properties = F.zip_with(_found(rules.TERM_PROPERTY, 1, *dotted), _found(rules.TERM_PROPERTY, 2, *dotted),
                            lambda a, b: F.when(a != "", a).otherwise(b))
    source_type = F.when(F.col("suffix") == "", "text").otherwise(F.ltrim("suffix", F.lit(".")))
    found = artifacts.withColumn("lowered", F.lower("text")).withColumn("routes", routes)
    return _emit(
        found, source_type,
        _terms(F.col("routes"), "endpoint_path", "path"), _parts(F.col("routes"), "path segment"),
        _terms(_found(rules.TERM_FORM_FIELD, 1, "<input", "<select", "<textarea"), "form_field", "HTML form field"),
        _terms(properties, "json_key", "object property", True),
        _terms(_found(rules.TERM_HEADER, 0, *headers), "header_name", "header-like name"),
        _terms(_found(rules.TERM_COOKIE, 1, "cookie"), "cookie_name", "cookie-like name"),
        _terms(_found(rules.TERM_STORAGE_KEY, 1, "storage"), "object_name", "browser storage key", True),
        _terms(_found(rules.TERM_GQL_OPERATION, 2, *operations), "graphql_operation", "GraphQL operation"),
        _terms(_found(rules.TERM_GQL_VARIABLE, 1, "$"), "graphql_variable", "GraphQL variable"),
        _terms(_found(rules.TERM_IDENTIFIER, 0), "javascript_identifier", "identifier", True))


def terms_from_json(artifacts: DataFrame) -> DataFrame:
    """Keys of JSON artifacts at any depth."""
    return _emit(artifacts, F.lit("json"), _terms(json_keys(F.col("text")), "json_key", "JSON key", True))


def terms_from_graphql(payloads: DataFrame) -> DataFrame:
    """Operation and variable names of GraphQL payloads and their documents."""
    def only(kind, values):
        return F.when(F.col("kind") == kind, values).otherwise(F.array().cast("array<string>"))

    return _emit(
        payloads, F.lit("har"),
        _terms(only("document", _found(rules.TERM_GQL_OPERATION, 2)), "graphql_operation", "GraphQL operation"),
        _terms(only("document", _found(rules.TERM_GQL_VARIABLE, 1)), "graphql_variable", "GraphQL variable"),
        _terms(only("variable", _one(F.col("text"))), "graphql_variable", "GraphQL variables"),
        _terms(only("operation", _one(F.col("text"))), "graphql_operation", "GraphQL operation"))


def terms_from_inventories(**tables: DataFrame) -> DataFrame:
    """Raw terms out of saved tables: endpoints, runtime_configs, routes, storage_references,
    actors, objects, endpoint_templates, expected_access, workspaces."""
    c = F.col
    empty = F.array().cast("array<string>")
    out = []

    def add(name, source_type, *arrays):
        if name in tables:
            df = tables[name]
            if "source_file" not in df.columns:
                df = df.withColumn("source_file", F.lit(name))
            out.append(_emit(df, F.lit(source_type), *[a(df) for a in arrays]))

    def field(name, category, context, classify=False):
        return lambda df: _terms(_one(c(name)), category, context, classify)

    def listed(name, category, context, classify=False):
        return lambda df: _terms(F.coalesce(c(name), empty) if name in df.columns else empty, category, context, classify)

    def parts(name, context):
        return lambda df: _parts(_one(c(name)), context)

    add("endpoints", "endpoint_inventory",
        *[f for n in ("path", "normalized_path") for f in (field(n, "endpoint_path", n), parts(n, n))],
        *[listed(n, cat, n, n == "risk_tags") for n, cat in (
            ("query_params", "query_param"), ("body_params", "body_param"), ("json_keys", "json_key"),
            ("header_names", "header_name"), ("object_id_candidates", "object_name"), ("risk_tags", "unknown"))])
    add("runtime_configs", "frontend_inventory", listed("config_keys", "json_key", "runtime config key", True),
        field("title", "object_name", "finding title", True))
    add("routes", "frontend_inventory", field("path", "endpoint_path", "route"), parts("path", "route"))
    add("storage_references", "frontend_inventory", field("key", "object_name", "storage key", True))
    add("actors", "authz_matrix", field("role", "role_permission_term", "actor role"))
    add("objects", "authz_matrix", field("object_type", "object_name", "object type", True),
        lambda df: _terms(F.map_keys("identifiers"), "object_name", "identifier key"))
    add("endpoint_templates", "authz_matrix", field("path_template", "endpoint_path", "endpoint template"),
        parts("path_template", "template segment"), listed("object_id_candidates", "object_name", "authz vocabulary", True),
        listed("risk_tags", "object_name", "authz vocabulary", True))
    add("expected_access", "authz_matrix", field("boundary_type", "organization_term", "boundary type", True))
    if "workspaces" in tables:
        ws = tables["workspaces"].withColumn("source_file", c("id"))
        asset_paths = F.transform("affected_assets", lambda a: F.when(path(a) == "", a).otherwise(path(a)))
        out.append(_emit(
            ws, F.lit("evidence_workspace"), _parts(asset_paths, "affected asset"),
            _terms(_one(c("title")), "object_name", "title", True),
            _terms(_one(c("finding_type")), "object_name", "finding_type", True),
            _terms(F.coalesce("tags", empty), "unknown", "tag", True),
            _terms(F.transform("evidence_items", lambda e: e["title"]), "object_name", "evidence title", True)))
        texts = F.concat(F.transform("evidence_items", lambda e: e["redacted_evidence_text"]),
                         F.transform("reproduction_steps", lambda s: s["action"]))
        from triage.functions.text import redact

        out.append(terms_from_text(ws.select("source_file", F.lit("").alias("suffix"), F.explode(texts).alias("text"))
                                   .filter("text is not null").withColumn("text", redact(c("text")))))
    return reduce(DataFrame.unionByName, out)


def aggregate_terms(raw: DataFrame) -> DataFrame:
    """One row per (normalized value, category) with its count, scores and tags."""
    counted = (raw.filter("value is not null")
               .groupBy("value", "category", "classify", "source_type", "context")
               .agg(F.count("*").alias("occurrences")))
    return _finish(counted)


def _useful_form(value: Column) -> Column:
    """Array of the normalized value, empty if it is not useful.

    Exploded rather than filtered: a filter on the normalized value would be moved
    under the projection and normalize once per test.
    """
    return F.filter(F.array(normalize_term(value)), lambda n: is_useful(n))


def _clean(counted: DataFrame) -> DataFrame:
    rows = counted.withColumn("value", strip(F.col("value")))
    rows = rows.withColumn("normalized_value", F.explode(_useful_form(F.col("value"))))
    return rows.withColumn("category", F.when(
        F.col("classify"), classify_term(F.col("normalized_value"), F.col("category"))).otherwise(F.col("category")))


def _finish(counted: DataFrame) -> DataFrame:
    order = F.struct("value", "source_type", "context")
    merged = _clean(counted).groupBy("normalized_value", "category").agg(
        F.sum("occurrences").alias("occurrences"), F.min(order).alias("f"))
    return score_terms(merged.select("normalized_value", "category", "occurrences", "f.*"))


def score_terms(terms: DataFrame) -> DataFrame:
    n = F.col("normalized_value")
    mask = term_tag_mask(n, F.col("category"))
    return terms.withColumns({
        "id": key_id("vocab", n, F.col("category")), "frequency_score": frequency_score(F.col("occurrences")),
        "risk_score": term_risk(n), "tag_mask": mask}).withColumn("tags", TERM_TAGS.array(F.col("tag_mask")))


def term_sources(raw: DataFrame) -> DataFrame:
    """(normalized_value, category, source_file, occurrences): where each term comes from."""
    counted = (raw.filter("value is not null").groupBy("source_file", "value", "category", "classify")
               .agg(F.count("*").alias("occurrences")))
    return _clean(counted).groupBy("normalized_value", "category", "source_file").agg(
        F.sum("occurrences").alias("occurrences"))


def merge_terms(terms: DataFrame) -> DataFrame:
    """Second-level merge of term tables that were aggregated per file or per run."""
    merged = terms.groupBy("normalized_value", "category").agg(
        F.sum("occurrences").alias("occurrences"), F.min(F.struct("value", "source_type", "context")).alias("f"))
    return score_terms(merged.select("normalized_value", "category", "occurrences", "f.*"))


def top_terms(terms: DataFrame, by: str = "risk", n: int = 25) -> DataFrame:
    """The n first terms by (risk, occurrences, term) or by (frequency, term)."""
    order = ([F.desc("risk_score"), F.desc("occurrences")] if by == "risk" else [F.desc("frequency_score")])
    return terms.orderBy(*order, F.asc("normalized_value"), F.asc("category")).limit(n)


def top_terms_per_category(terms: DataFrame, n: int = 25) -> DataFrame:
    """The n first terms of each category; the rank limit is applied before the shuffle."""
    w = W.partitionBy("category").orderBy(F.desc("risk_score"), F.desc("occurrences"), "normalized_value")
    return terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("category").agg(F.count("*").alias("terms"), F.sum("occurrences").alias("occurrences"))


def term_summary(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """(metric, value): terms, occurrences, sources analyzed."""
    a = terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    b = sources.select("source_file").distinct().agg(F.count("*").alias("n"))
    pairs = a.select(F.inline(F.array(F.struct(F.lit("terms").alias("metric"), F.col("terms").alias("value")),
                                      F.struct(F.lit("occurrences").alias("metric"), F.col("occurrences").alias("value")))))
    return pairs.unionByName(b.select(F.lit("sources_analyzed").alias("metric"), F.col("n").alias("value")))


def _list_names(category: Column, mask: Column) -> Column:
    named = [F.when(F.lit(name == "all") | is_in(category, cats), F.lit(name)) if cats or name == "all" else None
             for name, cats in rules.WORDLISTS.items()]
    tagged = [F.when(TERM_TAGS.has(mask, t), F.lit(t)) for t in rules.TAG_WORDLISTS]
    exact = F.when(~is_in(category, [*rules.WORDLISTS, *rules.TAG_WORDLISTS]), category)
    return F.array_compact(F.array(*[n for n in named if n is not None], *tagged, exact))


def term_lists(terms: DataFrame) -> DataFrame:
    """(list, term) for every word list a term belongs to, distinct."""
    return (terms.select(F.explode(_list_names(F.col("category"), F.col("tag_mask"))).alias("list"),
                         normalize_term(F.col("value")).alias("term")).distinct())


def select_terms(terms: DataFrame, name: str, mutations: bool = False) -> DataFrame:
    """One word list, distinct and sorted, optionally with spelling variants."""
    member = terms.filter(F.array_contains(_list_names(F.col("category"), F.col("tag_mask")), name))
    out = member.select(normalize_term(F.col("value")).alias("term"))
    if mutations:
        out = out.unionByName(term_variants(member).select(normalize_term(F.col("variant")).alias("term")))
    return out.filter(is_useful(F.col("term"))).distinct().orderBy("term")


def export_lists(terms: DataFrame) -> DataFrame:
    """The rows of the named export files."""
    wanted = {v: k for k, v in rules.EXPORTED_WORDLISTS.items()}
    pairs = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    return (term_lists(terms).filter(is_in(F.col("list"), list(wanted)))
            .select(pairs[F.col("list")].alias("list"), "term"))


def term_variants(terms: DataFrame) -> DataFrame:
    """camelCase, snake_case, kebab-case, flat, upper and singular/plural forms of each term."""
    words = terms.select("normalized_value", "category", "value", split_term(F.col("value")).alias("w")).filter(
        F.size("w") > 0)
    tail = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.initcap)
    camel = F.concat(F.col("w")[0], F.array_join(tail, ""))
    df = words.withColumns({"camel": camel, "flat": F.array_join("w", "")})
    plural = F.when(F.col("camel").endswith("s") & (F.length("camel") > 3),
                    F.expr("substring(camel, 1, length(camel) - 1)")).otherwise(F.concat("camel", F.lit("s")))
    forms = F.array_distinct(F.array("camel", F.array_join("w", "_"), F.array_join("w", "-"), "flat", F.upper("flat"),
                                     plural))
    useful = F.filter(forms, lambda v: is_useful(normalize_term(v)))
    return df.select("normalized_value", "category", F.explode(useful).alias("variant"))
