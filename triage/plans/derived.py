"""Review inputs derived from the test tables.

The tables hold no captures, so captures, scripts, matrices and saved results are
computed from their rows, over whole tables and whole texts.  Scalar columns are
plain SQL that Spark and a second engine both read; ``FUNCS`` holds the few
spellings that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.schemas import PAIRS

FUNCS = {
    "spark": {"k": "cast(get_json_object(props, '$.k') as int)", "b64": r"translate(base64(encode({}, 'utf-8')), '\r\n', '')"},
    "duckdb": {"k": "cast(json_extract_string(props, '$.k') as int)", "b64": "to_base64(encode({}))"},
}

AS_OF = "2024-02-01 00:00:00"
_B64URL = "replace(replace(replace({}, '+', '-'), '/', '_'), '=', '')"


def event_stages(dialect: str) -> list[list[tuple[str, str]]]:
    """Select lists, applied one after the other to ``events``."""
    f = FUNCS[dialect]
    b64 = lambda text: _B64URL.format(f["b64"].format(text))
    first = [
        ("i", "event_id"), ("u", "user_id"), ("t", "event_type"), ("k", f["k"]), ("ids", "cast(event_id as varchar(20))"),
        ("us", "cast(user_id as varchar(20))"), ("props", "props")]
    base = [
        ("i", "i"), ("u", "u"), ("k", "k"), ("ids", "ids"), ("us", "us"), ("ks", "cast(k as varchar(20))"), ("props", "props"),
        ("t", "case when t = 'click' and k % 5 = 0 then 'graphql' else t end"),
        ("org", "cast(u % 7 as varchar(20))"),
        ("host", "case when i % 10 = 0 then 'cdn.partner-files.net' when i % 10 = 1 then 'metrics.tracker.io' "
                 "else 'app.example.test' end"),
        ("source_file", "'capture-' || cast(case when i % 3 = 0 then 0 else u % 20 end as varchar(20)) || '.har'"),
        ("jwt", b64("case when k % 2 = 0 then '{\"alg\":\"HS256\",\"typ\":\"JWT\"}' else "
                    "'{\"alg\":\"RS256\",\"typ\":\"JWT\",\"kid\":\"k1\"}' end") + " || '.' || " +
         b64("'{\"sub\":\"u' || us || '\",\"iat\":1704067200,' || case when k % 7 <> 0 then '\"exp\":' || "
             "cast(1704067200 + k * 36000 as varchar(20)) || ',' else '' end || "
             "case when k % 3 = 0 then '\"email\":\"u@mail.example\",' else '' end || "
             "case when k % 4 = 0 then '\"aud\":\"web\",\"iss\":\"https://id.example.test\",' else '' end || "
             "'\"roles\":[\"' || case when k % 11 = 0 then 'Admin' else 'member' end || '\"],\"tenantId\":\"t' || "
             "cast(u % 7 as varchar(20)) || '\",\"scope\":\"read write\",\"custom_k\":' || cast(k as varchar(20)) || '}'")
         + " || '.c2lnbmF0dXJl'"),
    ]
    keep = [(n, n) for n, _ in base]
    second = keep + [
        ("method", "case when t = 'purchase' and k % 4 = 0 then 'PUT' when t in ('signup', 'purchase', 'graphql') "
                   "then 'POST' else 'GET' end"),
        ("path", "case t when 'view' then '/api/users/' || us when 'error' then '/api/users/' || us || '/profile' "
                 "when 'purchase' then '/api/orgs/org-' || org || '/invoices/' || ids "
                 "when 'signup' then case when k % 2 = 0 then '/auth/login' else '/auth/password/reset' end "
                 "when 'graphql' then '/api/graphql' "
                 "else case when k % 10 = 3 then '/static/app.js' else '/search' end end"),
        ("qs", "case when t = 'click' then '?q=term' || ks || '&page=' || cast(k % 9 as varchar(20)) || '&email=user' || us "
               "|| '%40mail.example' when t = 'view' and k % 13 = 0 then '?token=' || jwt "
               "when t = 'error' then '?debug=&trace=' || ks else '' end"),
        ("gql", "case when k % 10 = 0 then 'mutation UpdateUser($userId: ID!, $role: String) "
                "{ updateUser(id: $userId, role: $role) { id email tenantName ...UserBits } } "
                "fragment UserBits on User { phone }' else 'query Invoices' || org || '($orgId: ID!) "
                "{ invoices(org: $orgId) { total currency label(text: \"a } b' || case when k % 50 = 1 then repeat(' word', 300) else '' end || "
                "'\") last' || ks || ' } }' end"),
    ]
    third = [(n, n) for n, _ in second] + [
        ("url", "'https://' || host || path || qs"),
        ("status", "case when t = 'error' then 500 when method = 'POST' then 201 else 200 end"),
        ("rq_auth", "case when i % 2 = 0 then 'Bearer ' || jwt when i % 14 = 7 then 'Basic dXNlcjpwYXNz' end"),
        ("rq_apikey", "case when i % 5 = 3 then 'key-' || us || '-abcdef' end"),
        ("rq_csrf", "case when method = 'POST' then 'csrf' || ks end"),
        ("rq_cookie", "case when i % 3 = 0 then 'session_id=s' || us || 'abc; theme=dark; _ga=GA1.' || ks end"),
        ("rq_origin", "case when i % 4 = 0 then 'https://app.example.test' end"),
        ("rs_cache", "case i % 6 when 0 then 'no-store' when 1 then 'public, max-age=172800' "
                     "when 2 then 'private, max-age=7200' when 3 then 'max-age=86400' end"),
        ("rs_hsts", "case when i % 3 <> 0 then 'max-age=31536000' end"),
        ("rs_csp", "case i % 8 when 0 then 'default-src ''self''; script-src ''unsafe-inline'' *' "
                   "when 1 then 'default-src ''self''; object-src ''none''; frame-ancestors ''none''' end"),
        ("rs_xcto", "case when i % 5 <> 0 then 'nosniff' end"),
        ("rs_acao", "case i % 12 when 0 then '*' when 4 then 'https://app.example.test' when 8 then 'null' end"),
        ("rs_acac", "case when i % 24 in (0, 4) then 'true' end"),
        ("rs_vary", "case when i % 36 = 4 then 'Origin' end"),
        ("rs_acam", "case when i % 24 = 12 then 'GET, POST, PUT, PATCH, DELETE, OPTIONS' end"),
        ("sc1", "case when i % 8 = 1 then 'session_id=s' || us || 'abc; Path=/; HttpOnly; Secure; SameSite=Lax' "
                "when i % 4 = 1 then 'session_id=s' || us || 'abc; Path=/; HttpOnly' end"),
        ("sc2", "case when i % 9 = 2 then '__Host-auth=t' || ks || '; Secure; Path=/; Domain=.example.test' end"),
        ("rq_ck", "case when i % 7 = 0 then 'c' || ks end"), ("rs_ck", "case when i % 11 = 0 then 'v' || ks end"),
        ("request_body",
         "case t when 'signup' then 'username=user' || us || '&password=pw' || ks || '&next=%2Fhome' "
         "when 'purchase' then '{\"order\":{\"id\":' || ids || ',\"accountId\":\"acc-' || us || '\",\"items\":[{\"sku\":\"s-' "
         "|| ks || '\",\"qty\":' || cast(k % 5 as varchar(20)) || '},{\"sku\":\"x ' || chr(92) || '\"y' || chr(92) || '\": 1\"}]},\"gift\":true,\"note\":null}' "
         "when 'graphql' then case when k % 15 = 0 then '[' else '' end || '{\"query\":\"' || "
         "replace(gql, '\"', chr(92) || '\"') || '\",\"operationName\":\"\",\"variables\":{\"orgId\":\"o' || org || '\"}}' || "
         "case when k % 15 = 0 then ',{\"query\":\"{ viewer { id } }\"}]' else '' end else '' end"),
        ("response_body",
         "case when t = 'error' then '{\"errors\":[{\"message\":\"boom ' || ks || '\",\"path\":[\"user\"]}]}' "
         "when t = 'click' then '{\"results\":[],\"total\":' || ks || '}' else '{\"id\":' || us || ',\"profile\":"
         "{\"email\":\"user' || us || '@mail.example\",\"roleId\":' || ks || '},\"phone\":\"555-010-' || "
         "cast(1000 + k as varchar(20)) || '\"}' end"),
        ("mime_type", "case when i % 50 = 0 then '' when path = '/static/app.js' then 'application/javascript' "
                      "else 'application/json' end"),
    ]
    return [first, base, second, third]


def staged(df: DataFrame, stages) -> DataFrame:
    for stage in stages:
        df = df.selectExpr(*[f"{e.replace('varchar(20)', 'string')} as {n}" for n, e in stage])
    return df


def staged_sql(source: str, stages) -> str:
    sql = source
    for stage in stages:
        sql = f"(select {', '.join(f'{e} as {n}' for n, e in stage)} from {sql})"
    return sql


#: Events that one task derives its rows from: a stored event has a few bytes, what is derived from it a thousand times the work.
EVENTS_A_TASK = 50_000


def table(spark: SparkSession, sf: str, name: str, rows_a_task: int | None = None) -> DataFrame:
    """A test table, spread over the cores when its file has fewer splits than there are cores.

    A large table has more splits than cores and is left as it is scanned, unless ``rows_a_task`` asks for more parts: splits go by bytes
    and hold whole row groups, so those of a narrow table hold millions of rows.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.sparkContext.defaultParallelism
    if rows_a_task:
        parts = max(parts, -(-df.count() // rows_a_task))  # the count reads footers only
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return staged(table(spark, sf, "events", EVENTS_A_TASK), event_stages("spark"))


def _pairs(*named) -> F.Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(c).alias("value")))
                                     for n, c in named]))


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Exchanges of every event (API calls) and every page (page loads with the whole HTML)."""
    cookies = "array<struct<name:string,value:string,path:string,secure:boolean,httpOnly:boolean,sameSite:string>>"
    e = event_rows(spark, sf).withColumn("json", F.lit("application/json"))
    signup = F.col("t") == "signup"
    none = F.array().cast(PAIRS)
    lang = F.when(F.col("t") == "click", F.array(F.struct(F.lit("lang").alias("name"), F.lit("en").alias("value"))))
    form = F.when(signup, F.array(
        F.struct(F.lit("username").alias("name"), F.concat(F.lit("user"), "us").alias("value")),
        F.struct(F.lit("remember").alias("name"), F.lit("1").alias("value"))))
    kept = F.when(F.col("rs_ck").isNotNull(), F.array(F.struct(
        F.lit("pref").alias("name"), F.col("rs_ck").alias("value"), F.lit("/").alias("path"), F.lit(True).alias("secure"),
        F.lit(False).alias("httpOnly"), F.lit("Lax").alias("sameSite"))))
    calls = e.select(
        "source_file", F.col("i").alias("entry_idx"), "method", "url", F.col("status").cast("int").alias("status"),
        _pairs(("Host", "host"), ("Authorization", "rq_auth"), ("X-Api-Key", "rq_apikey"), ("X-CSRF-Token", "rq_csrf"),
               ("Cookie", "rq_cookie"), ("Origin", "rq_origin")).alias("request_headers"),
        _pairs(("Content-Type", "json"), ("Cache-Control", "rs_cache"), ("Strict-Transport-Security", "rs_hsts"),
               ("Content-Security-Policy", "rs_csp"), ("X-Content-Type-Options", "rs_xcto"),
               ("Access-Control-Allow-Origin", "rs_acao"), ("Access-Control-Allow-Credentials", "rs_acac"),
               ("Vary", "rs_vary"), ("Access-Control-Allow-Methods", "rs_acam"), ("Set-Cookie", "sc1"),
               ("Set-Cookie", "sc2")).alias("response_headers"),
        F.coalesce(lang, none).alias("query_string"), _pairs(("csrf_token", "rq_ck")).alias("request_cookies"),
        F.coalesce(kept.cast(cookies), F.array().cast(cookies)).alias("response_cookies"), "request_body",
        F.coalesce(form, none).alias("form_params"), "mime_type", "response_body")
    loads = table(spark, sf, "pages").select(
        F.concat(F.lit("pages-"), (F.col("page_id") % 5).cast("string"), F.lit(".har")).alias("source_file"),
        F.col("page_id").alias("entry_idx"), F.lit("GET").alias("method"), "url", F.lit(200).alias("status"),
        none.alias("request_headers"),
        F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value"))).alias("response_headers"),
        none.alias("query_string"), none.alias("request_cookies"), F.array().cast(cookies).alias("response_cookies"),
        F.lit("").alias("request_body"), none.alias("form_params"), F.lit("text/html").alias("mime_type"),
        F.col("html").alias("response_body"))
    return calls.unionByName(loads)


SCRIPT = (
    "'// bundle ' || ids || chr(10) || 'const apiKey = \"sk-' || us || 'abcdef' || ks || '\";' || chr(10) || "
    "'fetch(\"/api/users/' || us || '\");' || chr(10) || "
    "case when k % 3 = 0 then 'axios.post(\"https://' || host || '/api/orgs/acme' || org || '/invoices\", {\"invoiceId\": 1});' "
    "else 'new WebSocket(\"wss://live.example.test/feed' || org || '\");' end || chr(10) || "
    "'localStorage.setItem(\"session_token\", v' || ks || ');' || chr(10) || "
    "case when k % 4 = 0 then 'el.innerHTML = location.hash;' else 'let a' || ks || ' = 1;' end || chr(10) || "
    "case when k % 5 = 0 then 'window.addEventListener(\"message\", function (event) {' || chr(10) || '  run(event.data);' || "
    "chr(10) || '});' else 'parent.postMessage(\"hi\", \"*\");' end || chr(10) || "
    "case when k % 6 = 0 then 'window.__APP_CONFIG__ = {env: \"dev\", debug: true, feature_x: 1}' || chr(10) else '' end || "
    "case when k % 7 = 0 then 'const host = \"https://internal.example.test/x' || org || '\"; // 10.2.' || org || '.7' || chr(10) "
    "else '' end || '//# sourceMappingURL=app.' || org || '.js.map'"
)


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """One script per event."""
    return event_rows(spark, sf).selectExpr(
        "'scripts/' || ids || '.js' as source_file", "'.js' as suffix", f"{SCRIPT} as text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "'docs/' || cast(doc_id as string) || '.txt' as source_file", "'.txt' as suffix", "text")


def page_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(
        "'pages/' || cast(page_id as string) || '.html' as source_file", "'.html' as suffix", "html as text")


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts of all events, all documents and all pages as text artifacts."""
    return scripts(spark, sf).unionByName(documents(spark, sf)).unionByName(page_artifacts(spark, sf))


def source_map_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """One source map per document: the document embedded, and a second source without content."""
    d = F.struct(
        F.array(F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".js")), F.lit("src/empty.js")).alias("sources"),
        F.array(F.col("text"), F.lit(None)).alias("sourcesContent"), F.lit("/app").alias("sourceRoot"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("maps/"), F.col("doc_id").cast("string"), F.lit(".map")).alias("source_file"),
        F.lit(".map").alias("suffix"), F.to_json(d, {"ignoreNullFields": "false"}).alias("text"))


RAW_HTTP = (
    "case when i % 2 = 0 then method || ' ' || path || ' HTTP/1.1' || chr(10) || 'Host: ' || host || chr(10) || "
    "'Cookie: session_id=s' || us else 'HTTP/1.1 ' || cast(status as varchar(20)) || ' OK' || chr(10) || "
    "'Set-Cookie: auth_token=t' || ks || '; Path=/' || chr(10) || 'Cache-Control: public, max-age=' || ks end"
)


def raw_http(spark: SparkSession, sf: str) -> DataFrame:
    """One raw request or response text per event."""
    return event_rows(spark, sf).selectExpr(
        "'raw/' || ids || '.http' as source_file", "'.http' as suffix", f"{RAW_HTTP.replace('varchar(20)', 'string')} as text")


SAVED = (
    "case k % 10 when 0 then '{\"endpoints\":[],\"hosts\":[],\"project_name\":\"p' || ids || '\"}' "
    "when 1 then '{\"secrets\":[],\"source_maps\":[]}' when 2 then '{\"jwt_observations\":[],\"cookie_observations\":[]}' "
    "when 3 then '{\"operations\":[],\"schema_artifacts\":[]}' when 4 then '{\"terms\":[],\"categories\":{}}' "
    "when 5 then '{\"actors\":[],\"objects\":[],\"expected_access\":[]}' "
    "when 6 then '{\"evidence_items\":[],\"reproduction_steps\":[]}' when 7 then '{\"title\":\"t\",\"severity\":\"low\",\"asset\":\"a\"}' "
    "when 8 then '{\"har_findings\":[]}' else '{\"other\":' || ids || '}' end"
)


def saved_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """One saved JSON result per event, its kind by the event's properties."""
    return event_rows(spark, sf).selectExpr(
        "'saved/' || ids || '.json' as source_file", "'.json' as suffix", f"{SAVED} as text")


SDL = (
    "'# type Old { was: String } isn''t read' || chr(10) || chr(34) || chr(34) || chr(34) || 'Not read: } {' || chr(10) || '  token: a type Ghost' "
    "|| chr(34) || chr(34) || chr(34) || chr(10) || "
    "'type Supplier' || s || ' {' || chr(10) || '  id: ID!' || chr(10) || '  email: String' || chr(10) || '}' || chr(10) || "
    "'type Query {' || chr(10) || '  supplier' || s || '(id: ID!): Supplier' || s || chr(10) || '  ownerOf' || s || ': String' "
    "|| chr(10) || '}' || chr(10) || 'enum Role' || s || ' { A B }'"
)


def schema_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """One GraphQL schema text per supplier."""
    return (table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as s")
            .selectExpr("'schema/' || s || '.graphql' as source_file", "'.graphql' as suffix", f"{SDL} as text"))


def introspection_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """One stored introspection result per supplier."""
    text = ("'{\"data\":{\"__schema\":{\"queryType\":{\"name\":\"Query\"},\"mutationType\":null,\"types\":[{\"name\":\"Query\","
            "\"fields\":[{\"name\":\"node' || s || '\"},{\"name\":\"email' || s || '\"}]},{\"name\":\"Session' || s || "
            "'\",\"fields\":null}]}}}'")
    return (table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as s")
            .selectExpr("'schema/' || s || '.json' as source_file", "'.json' as suffix", f"{text} as text"))


# --- authorization matrix ----------------------------------------------------------------------

EXPECTED = [[
    ("actor_id", "'actor-' || cast(l_partkey as varchar(20))"), ("object_id", "'object-' || cast(l_orderkey as varchar(20))"),
    ("endpoint_template_id", "'tpl-' || cast(l_linenumber as varchar(20))"),
    ("expected_result", "case l_returnflag when 'A' then 'allow' when 'N' then 'deny' else 'unknown' end"),
    ("boundary_type", "case l_suppkey % 5 when 0 then 'tenant' when 1 then 'organization' when 2 then 'role' "
                      "when 3 then 'user' else 'unknown' end"),
    ("reason", "'line ' || l_linestatus"), ("o1", "l_extendedprice"), ("o2", "l_suppkey")]]
OBSERVED = [[
    ("actor_id", "'actor-' || cast(l_partkey as varchar(20))"), 
    # some lines were never tested, some with another object than their rule's
    ("object_id", "case when l_discount < 0.02 then 'other-' else 'object-' end || cast(l_orderkey as varchar(20))"),
    ("endpoint_template_id", "'tpl-' || cast(l_linenumber as varchar(20))"),
    ("observed_result", "case when l_discount = 0.02 then 'not_tested' when l_tax = 0 then 'unknown' when l_linestatus = 'O' then 'allowed' else 'denied' end"),
    ("evidence_reference", "case when l_quantity > 25 then 'ev-' || cast(l_suppkey as varchar(20)) else '' end"),
    ("o1", "l_extendedprice"), ("o2", "l_suppkey")]]
OBJECTS = [[
    ("id", "'object-' || cast(o_orderkey as varchar(20))"), ("object_type", "'order'"),
    ("display_name", "'Order ' || cast(o_orderkey as varchar(20))"), ("owner_actor_id", "'actor-' || cast(o_custkey as varchar(20))"),
    ("sensitivity", "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' else 'medium' end")]]
ACTORS = [[
    ("id", "'actor-' || cast(c_custkey as varchar(20))"), ("name", "c_name"), ("role", "c_mktsegment"),
    ("organization", "'org-' || cast(c_nationkey as varchar(20))")]]
TEMPLATES = [[
    ("id", "'tpl-' || cast(n as varchar(20))"),
    ("method", "case n % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'GET' else 'TRACE' end"),
    ("path_template", "'/api/orders/{id}/lines/' || cast(n as varchar(20))"),
    ("tag", "case when n = 2 then 'admin' when n = 6 then 'state-changing' else 'billing' end")]]


def authz(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Matrix tables: customers act on orders; each line is a rule and an observation."""
    from triage.functions.tags import key_id
    from triage.operators.authz import KEYS, upsert_latest

    lines = table(spark, sf, "lineitem")
    order = F.struct("o1", "o2", "w")
    expected = staged(lines, EXPECTED).withColumn("w", F.concat("expected_result", "reason"))
    observed = staged(lines, OBSERVED).withColumn(
        "w", F.concat("observed_result", "evidence_reference"))
    expected = upsert_latest(expected, KEYS, order).withColumn("id", key_id("expect", *[F.col(k) for k in KEYS]))
    observed = upsert_latest(observed, KEYS, order).withColumn("id", key_id("observed", *[F.col(k) for k in KEYS]))
    templates = staged(lines.select(F.col("l_linenumber").alias("n")).distinct(), TEMPLATES).withColumn(
        "risk_tags", F.array("tag"))
    return {"expected": expected, "observed": observed, "objects": staged(table(spark, sf, "orders"), OBJECTS),
            "actors": staged(table(spark, sf, "customer"), ACTORS), "templates": templates}


# --- saved results for correlation -----------------------------------------------------------------

ITEM_KIND = ("case i % 8 when 0 then 'endpoint_inventory' when 1 then 'frontend_inventory' when 2 then 'auth_surface_inventory' "
             "when 3 then 'graphql_inventory' when 4 then 'graphql_inventory' when 5 then 'authz_matrix' when 6 then 'har_report' "
             "else 'finding' end")
ITEM_STAGES = [
    [("i", "i"), ("u", "u"), ("k", "k"), ("ids", "ids"), ("us", "us"), ("ks", "ks"), ("org", "org"), ("host", "host"),
     ("method", "method"), ("path", "path"), ("artifact_type", ITEM_KIND),
     ("list_name", "case i % 8 when 0 then 'endpoints' when 1 then case when k % 2 = 0 then 'secrets' else 'source_maps' end "
                   "when 2 then 'cookie_observations' when 3 then 'endpoints' when 4 then 'operations' "
                   "when 5 then 'observed_results' else 'findings' end")],
    [("artifact_id", "artifact_type || '-' || org"), ("artifact_type", "artifact_type"), ("source_module", "artifact_type"),
     ("list_name", "list_name"), ("item_pos", "i"),
     ("item_id", "case when i % 8 = 1 and k % 3 = 0 then null when i % 8 = 3 then 'gep-' || cast(u % 50 as varchar(20)) "
                 "else 'item-' || ids end"),
     ("url", "case when i % 8 in (0, 2, 6) then 'https://' || host || path "
             "when i % 8 = 3 then 'https://app.example.test/api/graphql/' || cast(u % 50 as varchar(20)) end"),
     ("asset", "case when i % 8 = 1 then 'https://' || host || '/static/app' || org || '.js' "
               "when i % 8 = 7 then 'https://' || host || path end"),
     ("path", "case when i % 8 = 5 then path end"),
     ("method", "case when i % 8 in (0, 5, 6) then method when i % 8 = 3 then 'POST' end"),
     ("title", "case when i % 8 = 7 then 'Finding ' || ids when i % 8 = 1 and k % 2 = 0 then 'Exposed key' end"),
     ("name", "case when i % 8 = 4 then 'Op' || ks end"),
     ("item_type", "case when i % 8 = 1 then case when k % 2 = 1 then 'source-map-exposure' else 'api-key' end "
                   "when i % 8 = 6 then 'risky-cache' when i % 8 = 7 then 'xss' end"),
     ("severity", "case k % 6 when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' when 4 then 'CRITICAL' "
                  "end"),
     ("confidence", "case when k % 2 = 0 then 'high' else 'weird' end"),
     ("tag1", "case i % 8 when 0 then 'idor-candidate' when 2 then case when k % 3 = 0 then 'missing-httponly' else 'missing-secure' "
              "end when 4 then case when k % 5 = 0 then 'sensitive-fields' end end"),
     ("tag2", "case when i % 8 = 0 and k % 2 = 0 then 'state-changing' when i % 8 = 0 then 'search' end"),
     ("evidence", "case when k % 4 = 0 then 'mail user' || us || '@mail.example' end"),
     ("endpoint_id", "case when i % 8 = 4 then 'gep-' || cast(u % 60 as varchar(20)) end"),
     ("expected", "case when i % 8 = 5 then 'deny' end"),
     ("observed", "case when i % 8 = 5 then case when k % 3 = 0 then 'allowed' else 'denied' end end"),
     ("mismatch", "case when i % 8 = 5 then k % 20 = 1 end")]]


def inventory_items(spark: SparkSession, sf: str) -> DataFrame:
    """One saved result item per event."""
    rows = staged(event_rows(spark, sf), ITEM_STAGES)
    return rows.withColumn("risk_tags", F.array_compact(F.array("tag1", "tag2"))).drop("tag1", "tag2")


WORKSPACE = [[
    ("id", "'ws-' || cast(doc_id as varchar(20))"), ("text", "text"), ("doc_id", "doc_id"), ("n_chars", "n_chars"),
    ("title", "case when doc_id % 4 = 0 then 'Bug' else 'Report on ' || source || ' in ' || lang end"),
    ("impact", "case when doc_id % 3 = 0 then '' else text end"),
    ("severity", "case when doc_id % 5 = 0 then 'high' when doc_id % 5 = 1 then 'critical' else 'low' end"),
    ("remediation", "case when doc_id % 2 = 0 then 'Fix ' || lang else ' ' end"),
    ("status", "case when doc_id % 6 = 1 then 'ready' else 'draft' end"),
    ("asset", "case when doc_id % 7 <> 0 then 'https://app.example.test/docs/' || cast(doc_id as varchar(20)) end"),
    ("rationale", "case when doc_id % 2 = 1 then 'Because maybe ' || lang else '' end")]]


def workspaces(spark: SparkSession, sf: str) -> DataFrame:
    """One evidence workspace per document: its text is both impact and evidence."""
    w = staged(table(spark, sf, "documents"), WORKSPACE)
    c = F.col
    item = F.struct(
        F.lit("e1").alias("id"), F.lit("note").alias("type"), F.lit("Evidence").alias("title"),
        F.concat(F.lit("docs/"), c("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"),
        c("text").alias("evidence_text"), F.lit("").alias("redacted_evidence_text"), F.lit("").alias("description"))
    step = F.struct(F.lit("step-001").alias("id"), F.lit(1).alias("ord"), F.lit("Open the page").alias("action"),
                    F.lit("").alias("expected_result"), F.lit("").alias("actual_result"))
    return w.select(
        "id", "title", F.lit("idor").alias("finding_type"), F.array_compact(F.array("asset")).alias("affected_assets"),
        c("severity").alias("severity_estimate"), F.lit("medium").alias("confidence"), "status",
        F.array().cast("array<string>").alias("tags"), F.lit("").alias("scope_notes"), F.lit("Denied").alias("expected_behavior"),
        F.lit("Allowed").alias("actual_behavior"), "impact", c("rationale").alias("severity_rationale"), "remediation",
        F.when(c("doc_id") % 8 != 0, F.array(step)).otherwise(F.array().cast(
            "array<struct<id:string,ord:int,action:string,expected_result:string,actual_result:string>>")).alias("reproduction_steps"),
        F.array(item).alias("evidence_items"), F.array().cast("array<string>").alias("quality_warnings"))


# A scope policy with one rule for every part, in all the forms that rules have.
_N, _K = "cast(p_partkey % 1000 as varchar(20))", "cast(p_partkey as varchar(20))"
POLICY_RULE = f"""case p_partkey % 12 when 0 then '/en/' || {_N} when 1 then '/fr/' || cast(p_partkey % 100 as varchar(20)) || '*'
 when 2 then 'thther.example.org/en/' || {_N} || '*' when 3 then '*.example.net/de/' || {_N} || '?' when 4 then 'https://m.ththth.example.net/en/' || {_N}
 when 5 then 'h' || {_K} || '.example.org' when 6 then '*.T' || {_K} || '.example.net.' when 7 then 'https://*.example.com/es/' || {_N} || '[./]*'
 when 8 then '*/admin/*' || {_K} || '*' when 9 then 'blog.*/es/' || {_N} when 10 then ' https://*.example.org/[!e]?/' || {_N} || '/ '
 else case when p_partkey % 500 = 11 then '*.example.net' else 'api.example.test/v' || cast(p_partkey % 50 as varchar(20)) || '/*' end end"""


def policy_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("case when p_partkey % 5 < 2 then 'out' else 'in' end as kind", "p_partkey as ord", f"{POLICY_RULE} as rule")


def artifact_maps(spark: SparkSession, sf: str) -> DataFrame:
    """One source map for every text artifact, which embeds it under its own name."""
    m = F.struct(F.array("source_file").alias("sources"), F.array("text").alias("sourcesContent"))
    return artifacts(spark, sf).select(F.concat(F.lit("maps/"), "source_file", F.lit(".map")).alias("source_file"), F.lit(".map").alias("suffix"),
                                       F.to_json(m).alias("text"))


def gql_files(spark: SparkSession, sf: str) -> DataFrame:
    """The operation of every GraphQL event as a document file of its own."""
    return event_rows(spark, sf).where("t = 'graphql'").selectExpr("'gql/' || ids || '.graphql' as source_file", "'.graphql' as suffix", "gql as text")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records with secret-named fields and keys at several depths."""
    return event_rows(spark, sf).selectExpr(
        "source_file", "i as entry_idx", "url", "named_struct('password', 'p' || us, 'note', 'mail ' || us || '@mail.example', 'inner', "
        "array(named_struct('api_key', 'k' || ks, 'text', rq_auth))) as actor", "map('session_token', 't' || ks, 'lang', 'en', 'auth', rq_auth) as extra")
