"""The registered queries as SQL for a second engine (DuckDB), on the same tables.

Patterns are rewritten for RE2, which has no look-around: a boundary becomes a
captured neighbour that the replacement puts back.
"""

from __future__ import annotations

from triage import rules
from triage.plans import derived as D
from triage.plans.queries import NEAR_SINKS, NEAR_SOURCES

SQL: dict[str, str] = {}
W = r"\pL\pN_"
EVENTS = D.staged_sql("events", D.event_stages("duckdb"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def case_tags(pairs) -> str:
    """Sorted comma-joined names whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"case when {c} then {q(n)} end" for n, c in sorted(pairs)) + ")"


def ordered_tags(pairs, sep=",") -> str:
    return f"concat_ws({q(sep)}, " + ", ".join(f"case when {c} then {q(n)} end" for n, c in pairs) + ")"


def has_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def id12(prefix: str, expr: str) -> str:
    return f"({q(prefix + '-')} || substr(sha256({expr}), 1, 12))"


# --- redaction -------------------------------------------------------------------------------------

_KEYS1 = ("api[_-]?key|apikey|access[_-]?token|client[_-]?secret|secret|password|passwd|session[_-]?id|sessionid")
_KEYS2 = "csrf|xsrf|oauth[_-]?code|authorization[_-]?code|refresh[_-]?token"
_EMAIL = (rf"(^|[^{W}])([A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})($|[^{W}])")
_PHONE = rf"(^|[^{W}])((?:\+?1[-.\s]?)?(?:\(\d{{3}}\)|\d{{3}})[-.\s]?\d{{3}}[-.\s]?\d{{4}})($|[^{W}])"
_JWT = rf"(^|[^{W}])(eyJ[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{4,}}[A-Za-z0-9_])"
_STEPS = [
    (r"(?i)(authorization\s*:\s*bearer\s+)\S+", r"\1<redacted-token>"),
    (rf"(?i)(^|[^{W}])(bearer\s+)\S+", r"\1\2<redacted-token>"),
    (_JWT, r"\1<redacted-jwt>"),
    (r"(?im)^(\s*(?:set-)?cookie\s*:\s*)[^\n]+$", r"\1<redacted-cookie>"),
    (rf"""(?i)(^|[^{W}])((?:{_KEYS1})\s*[=:]\s*["']?)([^"'\s,;&}}]+)""", r"\1\2<redacted-secret>"),
    (rf"""(?i)(^|[^{W}])((?:{_KEYS2})\s*[=:]\s*["']?)([^"'\s,;&}}]+)""", r"\1\2<redacted-secret>"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "<redacted-private-key>"),
    (_EMAIL, r"\1<redacted-email>\3"), (_EMAIL, r"\1<redacted-email>\3"),
    (_PHONE, r"\1<redacted-phone>\3"), (_PHONE, r"\1<redacted-phone>\3"),
]
_CLASS_TESTS = [
    ("API key or session secret", _STEPS[4][0]), ("JWT", _JWT), ("OAuth, CSRF, or refresh token", _STEPS[5][0]),
    ("bearer token", _STEPS[1][0]), ("cookie", _STEPS[3][0]), ("email address", _EMAIL), ("phone number", _PHONE),
    ("private key", _STEPS[6][0])]


def redact(x: str) -> str:
    for pattern, new in _STEPS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return x


def classes(x: str) -> str:
    """List of the classes found in a text."""
    items = ", ".join(f"case when {rx(x, p)} then {q(n)} end" for n, p in _CLASS_TESTS)
    return f"list_filter([{items}], lambda z: z is not null)"


SQL["redact_documents"] = f"select doc_id, lang, {redact('text')} as redacted from documents"
SQL["redact_pages"] = f"select page_id, {redact('url')} as url, {redact('html')} as html from pages"
SQL["redaction_audit"] = (f"select conv_id, turn, unnest({classes('text')}) as redaction_class from conversations")
SQL["redaction_audit_documents"] = (
    f"select lang, redaction_class, count(*) as documents from (select lang, unnest({classes('text')}) as redaction_class "
    "from documents) group by all")
SQL["sensitive_documents"] = (
    f"select lang, count(*) as documents, count(*) filter (where {redact('text')} <> text) as sensitive "
    "from documents group by lang")


# --- exchanges -----------------------------------------------------------------------------------------

def scheme(x):
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def netloc(x):
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def host(x):
    return f"lower(regexp_extract({netloc(x)}, '^(?:[^@]*@)*([^:]*)', 1))"


def path(x):
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query_of(x):
    return f"regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1)"


def decode(x):
    return f"url_decode(replace({x}, '+', ' '))"


def norm(p: str) -> str:
    words = ", ".join(q(w) for w in rules.RESOURCE_WORDS)
    uuid = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    step = (f"case when x = '' or starts_with(x, '{{') then x when {rx('x', uuid)} then '{{uuid}}' "
            f"when {rx('x', '^[0-9]+$')} then '{{id}}' "
            f"when lower(regexp_extract(acc, '([^/]*)$', 1)) in ({words}) and {rx('x', '^[A-Za-z0-9][A-Za-z0-9_-]{2,}$')} "
            "then '{slug}' else x end")
    static = rx(p, r"(?i)[^/]\.(js|css|png|jpg|jpeg|svg|woff|woff2|map)/*$")
    return (f"case when {static} then {p} else list_reduce(string_split({p}, '/'), lambda acc, x: acc || '/' || {step}) end")


EX = f"""(
select i as entry_idx, *, 'application/json' as ct from {EVENTS}
union all by name
select 'pages-' || cast(page_id % 5 as varchar) || '.har' as source_file, page_id as entry_idx, 'GET' as method, url,
 200 as status, 'text/html' as mime_type, '' as request_body, html as response_body, 'text/html' as ct from pages)"""
BASE = f"""with ex as (select *, {scheme('url')} as scheme, {netloc('url')} as nl, {host('url')} as h,
 case when {path('url')} = '' then '/' else {path('url')} end as p, {query_of('url')} as qry,
 {redact('url')} as rurl from {EX})"""

REQ_HEADERS = [("Host", "host"), ("Authorization", "rq_auth"), ("X-Api-Key", "rq_apikey"), ("X-CSRF-Token", "rq_csrf"),
               ("Cookie", "rq_cookie"), ("Origin", "rq_origin")]
RESP_HEADERS = [("Content-Type", "ct"), ("Cache-Control", "rs_cache"), ("Strict-Transport-Security", "rs_hsts"),
                ("Content-Security-Policy", "rs_csp"), ("X-Content-Type-Options", "rs_xcto"),
                ("Access-Control-Allow-Origin", "rs_acao"), ("Access-Control-Allow-Credentials", "rs_acac"),
                ("Vary", "rs_vary"), ("Access-Control-Allow-Methods", "rs_acam"), ("Set-Cookie", "sc1"), ("Set-Cookie", "sc2")]
RESP_BY_NAME = {n.lower(): c for n, c in RESP_HEADERS}


def pairs_of(x: str, keep_blank=True) -> str:
    """Pieces of a form text as a list of (name, value) structs."""
    keep = "z <> ''" if keep_blank else "regexp_matches(z, '(?s)^[^=]*=.')"
    value = "case when contains(z, '=') then substr(z, strpos(z, '=') + 1) else '' end"
    return (f"list_transform(list_filter(string_split({x}, '&'), lambda z: {keep}), lambda z: "
            f"{{'name': {decode('split_part(z, chr(61), 1)')}, 'value': {decode(value)}}})")


def leaves(body: str) -> str:
    """Rows (source_file, entry_idx, url, name, value) of JSON leaves of a body column."""
    value = ("case k.type when 'NULL' then 'None' when 'BOOLEAN' then case when k.value->>'$' = 'true' then 'True' else 'False' "
             "end else k.value->>'$' end")
    return (f"select source_file, entry_idx, url, rurl, regexp_extract(k.fullkey, '\\.\"?([^.\\[\\]\"]+)\"?(\\[\\d+\\])*$', 1) as name, "
            f"{value} as value from (select * from ex where json_valid({body})) e, json_tree(e.{body}) k "
            "where k.type not in ('OBJECT', 'ARRAY')")


def _nv() -> str:
    cols = "source_file, entry_idx, url, rurl"
    parts = [f"select {cols}, 'request URL' as location, 'request_url' as name, url as value from ex",
             f"select {cols}, 'query parameter', z.name, z.value from (select {cols}, unnest({pairs_of('qry')}) as z from ex)",
             f"select {cols}, 'query parameter', 'lang', 'en' from ex where t = 'click'"]
    parts += [f"select {cols}, 'request header', {q(n)}, {c} from ex where {c} is not null" for n, c in REQ_HEADERS]
    parts += [f"select {cols}, 'response header', {q(n)}, {c} from ex where {c} is not null" for n, c in RESP_HEADERS]
    parts += [f"select {cols}, 'cookie', 'csrf_token', rq_ck from ex where rq_ck is not null",
              f"select {cols}, 'cookie', 'pref', rs_ck from ex where rs_ck is not null"]
    for side in ("request", "response"):
        body = f"{side}_body"
        parts += [f"select {cols}, '{side} body', '{body}', {body} from ex",
                  f"select {cols}, '{side} body', name, value from ({leaves(body)})",
                  f"select {cols}, '{side} body', z.name, z.value from (select {cols}, unnest({pairs_of(body)}) as z from ex "
                  f"where not json_valid({body}))"]
    parts += [f"select {cols}, 'request body', 'username', 'user' || us from ex where t = 'signup'",
              f"select {cols}, 'request body', 'remember', '1' from ex where t = 'signup'"]
    return " union all ".join(parts)


def category_conditions():
    low = "lower(name)"
    return {
        "bearer_token": f"contains({low}, 'authorization') and {rx('value', rf'(?i)(^|[^{W}])bearer\s+\S+')}",
        "jwt": rx("value", _JWT),
        "api_key": f"((contains({low}, 'api') and contains({low}, 'key')) or " + rx(
            "(name || '=' || value)", rf"""(?i)(^|[^{W}])(api[_-]?key|apikey|client[_-]?secret|access[_-]?token|refresh[_-]?token)"""
            r"""\s*[=:]\s*["']?[^"'\s,;&}]+""") + ")",
        "session": f"contains({low}, 'session')",
        "csrf_token": f"(contains({low}, 'csrf') or contains({low}, 'xsrf'))",
        "oauth_authorization_code": f"((contains({low}, 'oauth') and contains({low}, 'code')) or {low} in ('code', "
                                    "'authorization_code'))",
        "refresh_token": f"(contains({low}, 'refresh') and contains({low}, 'token'))",
        "email": rx("value", _EMAIL), "phone_number": rx("value", _PHONE),
        "sensitive_key_value": "(value <> '' and " + rx(
            "name", "(?i)(api[_-]?key|authorization|auth|bearer|csrf|xsrf|oauth|code|refresh[_-]?token|access[_-]?token|secret|"
            "password|passwd|session|token)") + ")",
    }


def sensitive_ctes() -> str:
    conds = ", ".join(f"case when {c} then {q(n)} end" for n, c in category_conditions().items())
    return (f", nv as ({_nv()}), sens as (select distinct source_file, location, rurl as source_url, name, category from "
            f"(select *, unnest(list_filter([{conds}], lambda z: z is not null)) as category from nv))")


def ph(category: str) -> str:
    return f"'<redacted-' || replace({category}, '_', '-') || '>'"


SQL["sensitive_material"] = BASE + sensitive_ctes() + f" select *, {ph('category')} as redacted_value from sens"
SQL["redact_records"] = BASE + f""" select source_file, entry_idx, {redact('url')} as url, '<redacted-secret>' as password,
 {redact("'mail ' || us || '@mail.example'")} as note, '<redacted-secret>' as api_key, {redact('rq_auth')} as text, '<redacted-secret>' as extra_session_token,
 'en' as extra_lang, {redact('rq_auth')} as extra_auth from ex where source_file not like 'pages-%'"""
SQL["redact_nested"] = BASE + (
    ", hv as (" + " union all ".join(f"select {q(n)} as name, {redact(c)} as v from ex where {c} is not null" for n, c in REQ_HEADERS)
    + ") select name, case when contains(v, '<redacted') then v else 'kept' end as value, count(*) as headers from hv group by all")
SQL["url_parts"] = BASE + f" select source_file, entry_idx, scheme, nl as netloc, h as host, {path('url')} as path, qry as query from ex"
SQL["normalize_path"] = BASE + f" select source_file, entry_idx, {norm('p')} as template from ex"
SQL["query_param_counts"] = BASE + (
    f", a as (select source_file, entry_idx, unnest(list_distinct(list_transform({pairs_of('qry')}, lambda z: z.name))) as name, "
    f"list_transform({pairs_of('qry', False)}, lambda z: z.name) as filled from ex) "
    "select name, count(*) as seen, count(*) filter (where list_contains(filled, name)) as filled from a group by name")
SQL["flatten_exchange"] = BASE + (
    " select source_file, entry_idx, method, url, status, mime_type, rq_apikey as api_key, rs_cache as cache_control, "
    "coalesce(sc2, sc1) as last_set_cookie from ex")
SQL["exchange_summary"] = BASE + (
    " select 'method' as dimension, method as value, count(*) as entries from ex group by all union all "
    "select 'status', cast(status as varchar), count(*) from ex group by all union all "
    "select 'mime_type', case when mime_type = '' then 'unknown' else mime_type end, count(*) from ex group by all")


def keys_of(body: str) -> str:
    return (f"select source_file, entry_idx, k.key as key from (select * from ex where json_valid({body})) e, json_tree(e.{body}) k "
            "where k.key is not null and not regexp_matches(k.fullkey, '\\]$')")


SQL["body_json_keys"] = BASE + (
    f" select key, count(*) as occurrences from ({keys_of('request_body')} union all {keys_of('response_body')}) group by key")
SQL["body_leaf_values"] = BASE + (
    f", nv as ({_nv()}) select location, name, count(*) as leaves, count(distinct value) as distinct_values from nv "
    "where location in ('request body', 'response body') and name not in ('request_body', 'response_body') group by all")

# --- endpoints ---------------------------------------------------------------------------------------------

_NAMES_BY_LOW = {n.lower(): n for n in rules.OBJECT_ID_NAMES}


def object_ids(names: str, template: str) -> str:
    pairs = [(n, f"list_contains({names}, {q(n.lower())})") for n in rules.OBJECT_ID_NAMES]
    pairs += [(s, f"contains({template}, {q(s)})") for s in rules.PATH_SLOTS]
    return case_tags(pairs)


def risk_tags(p: str, method: str, ids: str, sch: str) -> str:
    pairs = [(t, has_any(f"lower({p})", ws)) for t, ws in rules.RISK_TAG_WORDS.items()]
    pairs += [("websocket", f"{sch} in ('ws', 'wss')"), ("idor-candidate", f"{ids} <> ''"),
              ("state-changing", f"{method} in ('POST', 'PUT', 'PATCH', 'DELETE')")]
    return case_tags(pairs)


AUTH_TAGS = case_tags([
    ("bearer token", "starts_with(lower(rq_auth), 'bearer ')"), ("basic auth", "starts_with(lower(rq_auth), 'basic ')"),
    ("API key", "rq_apikey is not null"), ("CSRF token", "rq_csrf is not null"),
    ("cookie auth", "rq_cookie is not null or rq_ck is not null"),
    ("unauthenticated observed", "coalesce(not (starts_with(lower(rq_auth), 'bearer ') or starts_with(lower(rq_auth), 'basic ')), true) "
     "and rq_apikey is null and rq_csrf is null and rq_cookie is null and rq_ck is null")])
OBS = BASE + f""", jk as (select source_file, entry_idx, list(distinct key) as ks from
 ({keys_of('request_body')} union all {keys_of('response_body')}) group by all),
ob0 as (select ex.*, {norm('p')} as template, coalesce(jk.ks, []) as jkeys,
 list_distinct(list_transform({pairs_of('qry')}, lambda z: z.name) || case when t = 'click' then ['lang'] else [] end) as qnames,
 case when t = 'signup' then ['username', 'remember'] else [] end as bnames from ex left join jk using (source_file, entry_idx)),
ob1 as (select *, list_transform(qnames || bnames || jkeys, lambda z: lower(z)) as names from ob0),
ob2 as (select *, {object_ids('names', 'template')} as oids, {AUTH_TAGS} as auths from ob1),
ob as (select *, {risk_tags('p', 'method', 'oids', 'scheme')} as tags, {id12('ep', "method || '|' || h || '|' || template")} as endpoint_id,
 case when scheme <> '' then scheme || '://' || nl || p else p end as ep_url from ob2)"""


def union_tags(col: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split({col}, ','))), "
            "lambda z: z <> ''))), ',')")


MERGED = f""", m as (select endpoint_id, method, h as host, template as normalized_path, count(*) as occurrences,
 {union_tags('tags')} as risk_tags, {union_tags('auths')} as auth_indicators, {union_tags('oids')} as object_id_candidates,
 arg_min({{'scheme': scheme, 'path': p, 'url': ep_url, 'source_file': source_file}}, {{'a': source_file, 'b': entry_idx}}) as f
 from ob group by endpoint_id, method, h, template)"""
SQL["endpoint_inventory"] = OBS + MERGED + (
    " select endpoint_id, method, f.scheme as scheme, host, f.path as path, normalized_path, f.url as url, f.source_file as source_file, "
    "occurrences, auth_indicators, object_id_candidates, risk_tags from m")


def ep_values() -> str:
    hdr = " || ".join(f"case when {c} is not null then [{q(n)}] else [] end" for n, c in REQ_HEADERS + RESP_HEADERS)
    fields = [("query_params", "qnames"), ("body_params", "bnames"), ("json_keys", "jkeys"), ("header_names", f"list_distinct({hdr})"),
              ("status_codes", "[cast(status as varchar)]"), ("mime_types", "[mime_type]")]
    rows = " union all ".join(f"select endpoint_id, {q(f)} as field, unnest({e}) as value from ob" for f, e in fields)
    return f", ev as (select endpoint_id, field, value, count(*) as observations from ({rows}) group by all)"


SQL["endpoint_values"] = OBS + ep_values() + " select * from ev"
SQL["endpoint_value_lists"] = OBS + ep_values() + (
    " select endpoint_id, field, array_to_string(list_sort(list(value)), ',') as values from ev group by endpoint_id, field")
SQL["endpoint_sources"] = OBS + (
    " select endpoint_id, 'har' as type, source_file, entry_idx, rurl as url, cast(null as integer) as line from ob")
SQL["endpoint_summary"] = OBS + MERGED + (
    " select count(*) as endpoint_count, count(distinct nullif(host, '')) as host_count, "
    "count(*) filter (where risk_tags <> '') as high_interest_count from m")
SQL["endpoint_hosts"] = OBS + " select distinct h as host from ob where h <> ''"
_Q = ", ".join(f"({q(t)}, {q(x)}, {q('high' if t in rules.HIGH_PRIORITY_QUESTION_TAGS else 'medium')})"
               for t, qs in rules.ENDPOINT_QUESTIONS.items() for x in qs)
SQL["endpoint_checklist"] = OBS + MERGED + (
    f" select endpoint_id, category, question, priority, 'Endpoint is tagged ' || category || '.' as reason from "
    f"(select endpoint_id, unnest(string_split(risk_tags, ',')) as category from m) join (values {_Q}) v(category, question, priority) "
    "using (category)")
_HI = " or ".join(f"list_contains(string_split(risk_tags, ','), {q(t)})" for t in rules.HIGH_INTEREST_TAGS)
SQL["high_interest_endpoints"] = OBS + MERGED + f" select endpoint_id, method, host, normalized_path from m where {_HI}"
SQL["har_endpoints"] = BASE + (
    " select method, h as host, p as path, arg_min(scheme || '://' || nl || p, {'a': source_file, 'b': entry_idx}) as url, "
    "count(*) as count from ex group by method, h, p")
SQL["har_endpoint_values"] = BASE + (
    f", v as (select method, h as host, p as path, 'query_parameters' as field, unnest(list_distinct(list_transform("
    f"{pairs_of('qry', False)}, lambda z: z.name))) as value from ex union all select method, h, p, 'status_codes', cast(status as varchar) "
    "from ex union all select method, h, p, 'mime_types', case when mime_type = '' then 'unknown' else mime_type end from ex) "
    "select method, host, path, field, value, count(*) as observations from v group by all")

SCRIPTS = f"(select 'scripts/' || ids || '.js' as source_file, '.js' as suffix, {D.SCRIPT} as text from {EVENTS})"
DOCS = "(select 'docs/' || cast(doc_id as varchar) || '.txt' as source_file, '.txt' as suffix, text from documents)"
PAGES = "(select 'pages/' || cast(page_id as varchar) || '.html' as source_file, '.html' as suffix, html as text from pages)"
ARTS = f"(select * from {SCRIPTS} union all select * from {DOCS} union all select * from {PAGES})"
# Text found by a pattern, with the line on which it starts: lines are split first, so this
# serves patterns whose matches cannot span lines in the given texts.
LINES = (f"lines as (select source_file, suffix, generate_subscripts(ls, 1) as line, unnest(ls) as txt from "
         f"(select source_file, suffix, string_split(text, chr(10)) as ls from {ARTS}))")


def per_line(pattern: str, groups: str, source="lines") -> str:
    return f"select source_file, suffix, line, unnest(regexp_extract_all(txt, {q(pattern)}, {groups})) as g from {source}"


_CALL = r"""(?i)(?:fetch|axios(?:\.(?:get|post|put|patch|delete))?|new\s+WebSocket|new\s+EventSource)\s*\(\s*["'][^"']+["']"""
_ABS = r"""(?i)(?:https?|wss?)://[^\s"'<>\\)]+"""
_WORDS = ("api|v\\d+|graphql|admin|auth|upload|files?|exports?|users?|accounts?|orgs?|organizations?|projects?|billing|invoices?|"
          "internal|debug|search")
_QPATH = rf"""(?i)"/(?:{_WORDS})[^"' <>{{}}\\]*"|'/(?:{_WORDS})[^"' <>{{}}\\]*'"""
TEXT_EP = f"""with {LINES},
c0 as ({per_line(_CALL, '0')}),
calls as (select source_file, suffix, line, regexp_extract(g, '["'']([^"'']+)["'']$', 1) as raw,
 case when regexp_matches(g, '(?i)^axios\\.') then upper(regexp_extract(g, '(?i)^axios\\.([a-z]+)', 1))
 when regexp_matches(g, '(?i)eventsource') then 'GET' else 'UNKNOWN' end as method from c0),
a0 as (select source_file, suffix, min(line) as line, g as raw from ({per_line(_ABS, '0')}) group by all),
a1 as (select * from a0 anti join calls using (source_file, raw)),
p0 as (select source_file, suffix, min(line) as line, substr(g, 2, length(g) - 2) as raw from ({per_line(_QPATH, '0')})
 group by source_file, suffix, g),
p1 as (select * from p0 anti join calls using (source_file, raw)), p2 as (select * from p1 anti join a1 using (source_file, raw)),
allhits as (select source_file, suffix, line, raw, method, 0 as kind from calls union all
 select source_file, suffix, line, raw, 'UNKNOWN', 1 from a1 union all select source_file, suffix, line, raw, 'UNKNOWN', 2 from p2),
forms as (select source_file, suffix, list_distinct(regexp_extract_all(text, '(?i)(?:name|data-param)=["'']([A-Za-z][\\w.-]*)["'']', 1)) as fs,
 list_distinct(regexp_extract_all(text, '["'']([A-Za-z][A-Za-z0-9_]*(?:Id|_id))["'']', 1)) as idn from {ARTS}),
te0 as (select a.*, {scheme('raw')} as scheme, {netloc('raw')} as nl, {host('raw')} as h,
 case when {path('raw')} = '' then '/' else {path('raw')} end as p, {query_of('raw')} as qry,
 case when a.suffix = '.html' then fs else [] end as bnames, idn as jkeys from allhits a join forms using (source_file)),
te1 as (select *, {norm('p')} as template, list_transform(list_transform({pairs_of('qry')}, lambda z: z.name) || bnames || jkeys,
 lambda z: lower(z)) as names from te0),
te2 as (select *, {object_ids('names', 'template')} as oids from te1),
te as (select *, {risk_tags('p', 'method', 'oids', 'scheme')} as tags, {id12('ep', "method || '|' || h || '|' || template")} as endpoint_id,
 case when scheme <> '' then scheme || '://' || nl || p else p end as ep_url from te2)"""
SQL["text_endpoints"] = TEXT_EP + (
    " select source_file, line, method, raw as raw_url, template as normalized_path, tags as risk_tags, oids as object_ids from te")
SQL["reused_text_endpoints"] = TEXT_EP + (
    f" select source_file, line, method, {redact('raw')} as raw_url, {redact('template')} as normalized_path, tags as risk_tags, oids as object_ids from te")
SQL["api_client_hints"] = TEXT_EP + (
    f" select source_file, line, method, {redact('ep_url')} as url from te where h <> '' or tags <> ''")
SQL["text_endpoint_inventory"] = TEXT_EP + f""" , m as (select endpoint_id, method, h as host, template as normalized_path,
 count(*) as occurrences, 'unknown' as auth_indicators, {union_tags('oids')} as object_id_candidates, {union_tags('tags')} as risk_tags,
 arg_min({{'scheme': scheme, 'path': p, 'url': ep_url, 'source_file': source_file}}, {{'a': source_file, 'k': kind, 'b': line}}) as f
 from te group by endpoint_id, method, h, template)
 select endpoint_id, method, f.scheme as scheme, host, f.path as path, normalized_path, f.url as url, f.source_file as source_file,
 occurrences, auth_indicators, object_id_candidates, risk_tags from m"""
