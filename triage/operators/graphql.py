"""GraphQL endpoints, operations, variables, schemas and review leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.gqltext import document_blocks, payload_parts
from triage.functions.tags import TagSet, contains_any, key_id, word_rules
from triage.functions.text import redact
from triage.functions.urls import host, netloc, path, scheme
from triage.schemas import JSON_LIMITS

AUTH = TagSet(["bearer token", "authorization header", "cookie auth", "CSRF token", "API key",
               "unauthenticated observed", "unknown"])
OP_TAGS = TagSet([*rules.GQL_TAG_WORDS, "manual-authorization-review", "state-changing-mutation",
                  "object-id-candidate", "sensitive-field-selection"])
_STRINGS = "array<string>"
_PAYLOAD_TEST = '"(?:query|errors|variables|operationName)"'
_OP_TEST = "(?Ui)" + rules.GQL_OPERATION_HEAD


def endpoint_bearing(artifacts: DataFrame, text: str = "text") -> DataFrame:
    """Cheap pre-test before the search for endpoints: every text in which GQL_ENDPOINT can match."""
    return artifacts.filter(contains_any(F.lower(F.col(text)), ["/graphql", "/gql", "/query"]))


def is_sensitive(name: Column) -> Column:
    low = F.lower(name)
    words = [w.lower() for w in rules.GQL_SENSITIVE]
    return low.isin(words) | contains_any(low, [w for w in words if len(w) > 4])


def is_object_id(name: Column) -> Column:
    low = F.lower(name)
    return low.isin([n.lower() for n in rules.GQL_OBJECT_IDS]) | low.endswith("id")


def _auth_mask(headers: Column) -> Column:
    def some(test):
        return F.exists(headers, lambda h: test(F.lower(h["name"]), F.lower(h["value"])))

    plain = lambda n: (n != "authorization") & (n != "cookie")
    csrf = lambda n: n.contains("csrf") | n.contains("xsrf")
    found = AUTH.mask({
        "bearer token": some(lambda n, v: (n == "authorization") & v.startswith("bearer ")),
        "authorization header": some(lambda n, v: (n == "authorization") & ~v.startswith("bearer ")),
        "cookie auth": some(lambda n, v: n == "cookie"),
        "CSRF token": some(lambda n, v: plain(n) & csrf(n)),
        "API key": some(lambda n, v: plain(n) & ~csrf(n) & n.contains("api") & n.contains("key"))})
    return F.when(found == 0, AUTH.mask({"unauthenticated observed": F.lit(True)})).otherwise(found)


def _endpoint_columns(df: DataFrame) -> DataFrame:
    u = F.col("raw_url")
    where = F.when(path(u) == "", "/graphql").otherwise(path(u))
    clean = F.when(scheme(u) != "", F.concat(scheme(u), F.lit("://"), netloc(u), where)).otherwise(where)
    return df.select("source_file", "entry_idx", "pos", F.upper("method").alias("method"), host(u).alias("host"),
                     where.alias("path"), redact(clean).alias("url"), "auth_mask").withColumn(
        "endpoint_id", key_id("gql-endpoint", F.col("method"), F.col("host"), F.col("path")))


def gql_endpoints(exchanges: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """GraphQL endpoint observations of captures and texts."""
    parts = []
    if exchanges is not None:
        parts.append(exchanges.filter(F.col("url").rlike(rules.GQL_ENDPOINT)).select(
            "source_file", "entry_idx", F.lit(0).alias("pos"), F.col("url").alias("raw_url"), "method",
            _auth_mask(F.col("request_headers")).alias("auth_mask")))
    if artifacts is not None:
        found = F.regexp_extract_all("text", F.lit(rules.GQL_ENDPOINT), F.lit(0))
        parts.append(artifacts.select("source_file", F.posexplode(found).alias("pos", "raw_url")).select(
            "source_file", F.lit(0).cast("bigint").alias("entry_idx"), "pos", "raw_url",
            F.lit("UNKNOWN").alias("method"), AUTH.mask({"unknown": F.lit(True)}).alias("auth_mask")))
    return _endpoint_columns(reduce(DataFrame.unionByName, parts))


def gql_merge(endpoints: DataFrame) -> DataFrame:
    """One row per (method, host, path) with its count and the union of auth indicators."""
    merged = endpoints.groupBy("method", "host", "path").agg(
        F.count("*").alias("occurrences"), F.bit_or("auth_mask").alias("auth_mask"),
        F.min_by(F.struct("endpoint_id", "url", "source_file"),
                 F.struct("source_file", "entry_idx", "pos")).alias("f"))
    return merged.select("f.endpoint_id", "method", "host", "path", "f.url", "f.source_file", "occurrences",
                         AUTH.array(F.col("auth_mask")).alias("auth_indicators"))


def _payload_rows(exchanges: DataFrame) -> DataFrame:
    """Bodies that may carry payloads, one row per body, with the endpoint of the exchange."""
    is_endpoint = F.col("url").rlike(rules.GQL_ENDPOINT)
    u = F.col("url")
    endpoint_id = F.when(is_endpoint, key_id("gql-endpoint", F.upper("method"), host(u), F.when(
        path(u) == "", "/graphql").otherwise(path(u)))).otherwise("")
    bodies = F.array(F.struct(F.lit(0).alias("side"), F.col("request_body").alias("body")),
                     F.struct(F.lit(1).alias("side"), F.col("response_body").alias("body")))
    may = lambda b: b.rlike(_PAYLOAD_TEST)
    kept = F.filter(bodies, lambda x: may(x["body"]) | ((x["side"] == 0) & x["body"].rlike(_OP_TEST)))
    return exchanges.select("source_file", "entry_idx", endpoint_id.alias("endpoint_id"), F.inline(kept))


def gql_payloads(exchanges: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """Documents, batches and error lists found at any depth of JSON payloads."""
    parts = []
    if exchanges is not None:
        rows = _payload_rows(exchanges)
        raw = (F.col("side") == 0) & F.col("w").isNull() & F.col("body").rlike(_OP_TEST)
        whole = F.array(F.struct(F.lit("document").alias("kind"), F.col("body").alias("text"),
                                 F.lit("").alias("operation_name"), F.lit(1).alias("n")))
        walked = rows.withColumn("w", payload_parts(F.col("body")))
        parts.append(walked.select("source_file", "entry_idx", "side", "endpoint_id",
                                   F.posexplode(F.when(raw, whole).otherwise(F.col("w"))).alias("pos", "d")))
    if artifacts is not None:
        first = F.regexp_extract("text", rules.GQL_ENDPOINT, 0)
        where = F.when(path(first) == "", "/graphql").otherwise(path(first))
        endpoint_id = F.when(first != "", key_id("gql-endpoint", F.lit("UNKNOWN"), host(first), where)).otherwise("")
        texts = artifacts.select("source_file", F.lit(0).cast("bigint").alias("entry_idx"), "suffix",
                                 endpoint_id.alias("endpoint_id"), "text")
        whole = texts.filter(F.col("text").rlike(_OP_TEST) | F.col("text").rlike("(?i)fragment")).select(
            "source_file", "entry_idx", F.lit(0).alias("side"), "endpoint_id", F.lit(-1).alias("pos"),
            F.struct(F.lit("document").alias("kind"), F.col("text").alias("text"),
                     F.lit("").alias("operation_name"), F.lit(1).alias("n")).alias("d"))
        may = F.col("text").rlike(_PAYLOAD_TEST)
        walked = texts.filter((F.col("suffix") == ".json") & may).withColumn("w", payload_parts(F.col("text")))
        parts += [whole, walked.select("source_file", "entry_idx", F.lit(0).alias("side"), "endpoint_id",
                                       F.posexplode("w").alias("pos", "d"))]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("source_file", "entry_idx", "side", "pos", "endpoint_id", "d.kind", "d.text",
                       "d.operation_name", "d.n")


def gql_documents(payloads: DataFrame) -> DataFrame:
    return payloads.filter("kind = 'document'").drop("kind", "n")


def gql_fields(block: Column) -> Column:
    """Sorted distinct identifiers of a selection, without variables, spreads and keywords."""
    bare = F.regexp_replace(F.regexp_replace(block, r"(?U)\$[A-Za-z_]\w*", ""), r"(?U)\.\.\.[A-Za-z_]\w*", "")
    words = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?U)\b[A-Za-z_]\w*\b"), F.lit(0)))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(rules.GQL_KEYWORDS) & ~w.isin(rules.GQL_SCALARS))
    return F.array_sort(kept)


def _blocks(documents: DataFrame) -> DataFrame:
    return (documents.withColumn("b", F.explode(document_blocks(F.col("text"))))
            .select("source_file", "entry_idx", "side", "pos", "endpoint_id", "operation_name", "b.*"))


def gql_operations(documents: DataFrame) -> DataFrame:
    """Operations with variables, fields, fragments, sensitive names and tags."""
    rows = _blocks(documents).filter("kind = 'operation'")
    c = F.col
    declared = F.arrays_zip(F.regexp_extract_all("args", F.lit(rules.GQL_VARIABLE), F.lit(1)).alias("name"),
                            F.regexp_extract_all("args", F.lit(rules.GQL_VARIABLE), F.lit(2)).alias("type"))
    used = F.array_distinct(F.regexp_extract_all("block", F.lit(rules.GQL_VARIABLE), F.lit(1)))
    rows = rows.withColumns({
        "variable_types": declared, "fields": gql_fields(c("block")),
        "fragments": F.array_sort(F.array_distinct(F.regexp_extract_all(
            "block", F.lit(r"(?U)\.\.\.([A-Za-z_]\w*)"), F.lit(1)))),
        "operation": F.when(c("name") != "", c("name")).otherwise(c("operation_name"))})
    rows = rows.withColumn("variables", F.array_sort(F.array_union(
        used, F.transform("variable_types", lambda v: v["name"]))))
    rows = rows.withColumns({"sensitive_fields": F.filter("fields", is_sensitive),
                             "object_id_candidates": F.filter("variables", is_object_id)})
    combined = F.lower(F.concat_ws(" ", "name", F.array_join("fields", " ")))
    conds = word_rules(combined, rules.GQL_TAG_WORDS)
    conds |= {"manual-authorization-review": F.lit(True), "state-changing-mutation": c("op_type") == "mutation",
              "object-id-candidate": F.size("object_id_candidates") > 0,
              "sensitive-field-selection": F.size("sensitive_fields") > 0}
    return rows.withColumn("tag_mask", OP_TAGS.mask(conds)).select(
        key_id("gql-operation", c("source_file"), c("op_type"), c("name"), c("start")).alias("operation_id"),
        "source_file", "entry_idx", "side", "pos", "start", "endpoint_id", c("op_type").alias("operation_type"),
        c("operation").alias("operation_name"), "variables", "variable_types", "fields", "fragments",
        "sensitive_fields", "object_id_candidates", "tag_mask", OP_TAGS.array(c("tag_mask")).alias("risk_tags"),
        redact(F.col("block")).alias("redacted_evidence"))


def gql_fragments(documents: DataFrame) -> DataFrame:
    return _blocks(documents).filter("kind = 'fragment'").select(
        "source_file", "entry_idx", "name", gql_fields(F.col("block")).alias("fields"),
        redact(F.col("block")).alias("redacted_evidence"))


def gql_variables(operations: DataFrame) -> DataFrame:
    """Distinct variables; the type comes from the first operation that has the variable."""
    order = F.struct("source_file", "entry_idx", "side", "pos", "start")
    rows = operations.select("variable_types", order.alias("o"), F.explode("variables").alias("name"))
    declared = F.try_element_at(F.filter("variable_types", lambda v: v["name"] == F.col("name")), F.lit(-1))["type"]
    merged = (rows.select("name", F.coalesce(declared, F.lit("")).alias("t"), "o")
              .groupBy("name").agg(F.min_by("t", "o").alias("value_type"), F.count("*").alias("operations")))
    return merged.withColumns({"sensitive": is_sensitive(F.col("name")),
                               "object_id_candidate": is_object_id(F.col("name"))})


#: Block strings, strings and comments of schema text, whichever begins first.
_SDL_ASIDE = r'(?s)""".*?(?:"""|\z)|"(?:\\.|[^"\\\n])*+"|#[^\n\r]*'


def gql_schema_sdl(artifacts: DataFrame) -> DataFrame:
    """Type names and root fields of schema text; what descriptions and comments say is no schema."""
    text = F.col("code")
    types = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.GQL_TYPE_NAME), F.lit(1))))
    roots = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(rules.GQL_ROOT_TYPE), F.lit(1)), F.lower).alias("root"),
        F.regexp_extract_all(text, F.lit(rules.GQL_ROOT_TYPE), F.lit(2)).alias("body"))

    def names(kind):
        bodies = F.filter("roots", lambda r: r["root"] == kind)
        last = F.try_element_at(bodies, F.lit(-1))["body"]
        got = F.regexp_extract_all(F.coalesce(last, F.lit("")), F.lit(rules.GQL_ROOT_FIELD), F.lit(1))
        return F.array_sort(F.array_distinct(got))

    may = lambda x: x.rlike(rules.GQL_TYPE_NAME) | x.rlike(rules.GQL_ROOT_TYPE)
    coded = artifacts.filter(F.col("text").rlike(r"(?i)type|interface|input|enum|union|scalar")).withColumn("code", F.regexp_replace("text", _SDL_ASIDE, ""))
    df = coded.filter(may(text)).select(
        "source_file", "text", types.alias("type_names"), roots.alias("roots")).withColumns(
        {f"{k}_names": names(k) for k in ("query", "mutation", "subscription")})
    fields = F.array_sort(F.array_union(F.array_union("query_names", "mutation_names"), F.col("subscription_names")))
    return df.select(
        key_id("gql-schema", F.col("source_file"), "sdl").alias("id"), "source_file",
        F.lit("schema_sdl").alias("artifact_type"), "type_names", "query_names", "mutation_names",
        "subscription_names", F.filter("type_names", is_sensitive).alias("sensitive_types"),
        F.filter(fields, is_sensitive).alias("sensitive_fields"),
        redact(F.col("text")).alias("redacted_evidence"))


_TYPE = "struct<name:string,fields:array<struct<name:string>>>"
_SCHEMA = (f"struct<types:array<{_TYPE}>,queryType:struct<name:string>,mutationType:struct<name:string>,"
           "subscriptionType:struct<name:string>>")


def gql_introspection(artifacts: DataFrame) -> DataFrame:
    """Types and root fields of stored introspection results."""
    parsed = F.from_json("text", f"__schema {_SCHEMA}, data struct<__schema:{_SCHEMA}>", JSON_LIMITS)
    df = artifacts.filter(F.contains("text", F.lit("__schema"))).select(
        "source_file", F.coalesce(parsed.getField("data").getField("__schema"), parsed.getField("__schema")).alias("s"))
    named = F.filter("s.types", lambda t: t["name"].isNotNull())

    def field_names(types):
        each = F.transform(types, lambda t: F.transform(F.coalesce(t["fields"], F.array().cast(
            "array<struct<name:string>>")), lambda f: f["name"]))
        return F.array_sort(F.array_distinct(F.array_compact(F.flatten(each))))

    def root(kind):
        of_root = F.filter("types", lambda t: t["name"] == F.col(f"s.{kind}Type.name"))
        return F.coalesce(field_names(of_root), F.array().cast(_STRINGS))

    df = df.filter("s is not null").withColumn("types", F.coalesce(named, F.array().cast(f"array<{_TYPE}>")))
    names = F.array_sort(F.array_distinct(F.transform("types", lambda t: t["name"])))
    return df.select(
        key_id("gql-schema", F.col("source_file"), "introspection").alias("id"), "source_file",
        F.lit("introspection_json").alias("artifact_type"), names.alias("type_names"),
        root("query").alias("query_names"), root("mutation").alias("mutation_names"),
        root("subscription").alias("subscription_names"), F.filter(names, is_sensitive).alias("sensitive_types"),
        F.filter(field_names(F.col("types")), is_sensitive).alias("sensitive_fields"),
        F.lit("Local __schema artifact (values omitted).").alias("redacted_evidence"))


def _lead(category, title, severity, reason, question="", endpoint=None, operation=None, evidence="") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    endpoint = F.col("endpoint_id") if endpoint is None else endpoint
    operation = F.col("operation_id") if operation is None else operation
    ident = key_id("gql-lead", lit(category), endpoint, operation, lit(title))
    return F.struct(ident.alias("lead_id"), lit(category).alias("category"), lit(title).alias("title"),
                    endpoint.alias("endpoint_id"), operation.alias("operation_id"), lit(severity).alias("severity"),
                    lit(reason).alias("reason"), lit(question).alias("question"), lit(evidence).alias("evidence"))


def gql_batches(payloads: DataFrame) -> DataFrame:
    """Requests that carry more than one query."""
    reason = F.concat(F.lit("A local artifact contains "), F.col("n").cast("string"),
                      F.lit(" GraphQL operations in one request."))
    lead = _lead("batching_indicator", "Observed GraphQL batch", "info", reason, operation=F.lit(""))
    return payloads.filter("kind = 'batch'").select("source_file", "entry_idx", "side", "pos", F.inline(F.array(lead)))


def gql_errors(payloads: DataFrame) -> DataFrame:
    """Error lists that tell about stacks, paths or resolvers."""
    lead = _lead("excessive_error_detail", "Verbose GraphQL error details", "low",
                 "Captured errors include resolver, path, location, extension, exception, or stack details.",
                 operation=F.lit(""), evidence=redact(F.col("text")))
    return (payloads.filter((F.col("kind") == "errors") & F.col("text").rlike(rules.GQL_ERROR_DETAIL))
            .select("source_file", "entry_idx", "side", "pos", F.inline(F.array(lead))))


def gql_leads(operations: DataFrame, payloads: DataFrame | None = None,
              schemas: DataFrame | None = None) -> DataFrame:
    """Review leads; of equal ids the last one stays."""
    c = F.col
    label = F.when(c("operation_name") != "", c("operation_name")).otherwise(c("operation_type"))
    mutation = c("operation_type") == "mutation"
    joined = lambda name: F.array_join(name, ", ")
    found = [
        F.when(F.size("object_id_candidates") > 0, _lead(
            "idor_bola_candidate", F.concat(F.lit("Object ID variables in "), label),
            F.when(mutation, "medium").otherwise("low"),
            F.concat(F.lit("Observed object identifier variables: "), joined("object_id_candidates"), F.lit(".")),
            "Can Actor A access an object owned by Actor B using the observed object ID variable?")),
        F.when(F.size("sensitive_fields") > 0, _lead(
            "sensitive_field_exposure", F.concat(F.lit("Sensitive fields selected by "), label), "low",
            F.concat(F.lit("Selected fields need role and ownership review: "), joined("sensitive_fields"), F.lit(".")),
            "Are sensitive fields filtered by role and object ownership?")),
        F.when(mutation, _lead(
            "state_changing_mutation", F.concat(F.lit("State-changing mutation: "), F.when(
                c("operation_name") != "", c("operation_name")).otherwise("unnamed")), "medium",
            "Mutations change server-side state and require manual authorization review.",
            "Can a lower-privileged actor run this mutation directly?"))]
    for tag in rules.GQL_TAG_WORDS:
        words = tag.replace("-", " ")
        found.append(F.when(OP_TAGS.has(c("tag_mask"), tag), _lead(
            tag.replace("-", "_"), F.concat(F.lit(f"{words.title()}: "), label), "low",
            f"Observed operation names or fields indicate {words} review.")))
    parts = [operations.select("source_file", "entry_idx", "side", "pos", F.inline(F.array_compact(F.array(*found))))]
    if payloads is not None:
        parts += [gql_batches(payloads), gql_errors(payloads)]
    if schemas is not None:
        severity = F.when(F.size("sensitive_fields") + F.size("sensitive_types") > 0, "low").otherwise("info")
        lead = _lead("introspection_artifact", "Local GraphQL schema/introspection artifact", severity,
                     "A locally captured schema artifact can guide authorized manual review.",
                     endpoint=F.lit(""), operation=F.lit(""), evidence=F.col("redacted_evidence"))
        parts.append(schemas.select("source_file", F.lit(0).cast("bigint").alias("entry_idx"), F.lit(2).alias("side"),
                                    F.lit(0).alias("pos"), F.inline(F.array(lead))))
    rows = reduce(DataFrame.unionByName, parts)
    payload = ["category", "title", "endpoint_id", "operation_id", "severity", "reason", "question", "evidence"]
    last = rows.groupBy("lead_id").agg(F.max_by(
        F.struct(*payload), F.struct("source_file", "entry_idx", "side", "pos", "reason")).alias("l"))
    return last.select("lead_id", "l.*")


def gql_summary(**tables: DataFrame) -> DataFrame:
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(k).alias("list_name"), "rows")
              for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
