"""SQL of the GraphQL and vocabulary queries."""

from __future__ import annotations

from triage import rules
from triage.plans import derived as D
from triage.plans.oracle import ARTS, BASE, EVENTS, PAGES, SQL, case_tags, has_any, host, id12, keys_of, netloc, path, q, redact, rx, scheme
import triage.plans.oracle_reviews  # noqa: F401  (fills SQL)

_EP = rules.GQL_ENDPOINT.replace("(?Udi)", "(?i)")


def _gid(prefix: str, *parts: str) -> str:
    return id12(prefix, " || '|' || ".join(parts))


# --- endpoints -----------------------------------------------------------------------------------------

_AUTH = case_tags([
    ("bearer token", "starts_with(lower(rq_auth), 'bearer ')"),
    ("authorization header", "rq_auth is not null and not starts_with(lower(rq_auth), 'bearer ')"),
    ("cookie auth", "rq_cookie is not null"), ("CSRF token", "rq_csrf is not null"), ("API key", "rq_apikey is not null"),
    ("unauthenticated observed", "rq_auth is null and rq_cookie is null and rq_csrf is null and rq_apikey is null")])
GQL_EP = f""", ge0 as (select source_file, entry_idx as ord, method, url, {_AUTH} as auths from ex where {rx('url', _EP)} union all
 select source_file, generate_subscripts(us, 1), 'UNKNOWN', unnest(us), 'unknown' from (select source_file,
 regexp_extract_all(text, {q(_EP)}) as us from SRC)),
 ge1 as (select *, {host('url')} as gh, case when {path('url')} = '' then '/graphql' else {path('url')} end as gp from ge0),
 ge as (select method, gh, gp, count(*) as occurrences, arg_min({{'url': case when {scheme('url')} <> '' then {scheme('url')} || '://' ||
 {netloc('url')} || gp else gp end, 'source_file': source_file}}, {{'a': source_file, 'b': ord}}) as f,
 array_to_string(list_sort(list_distinct(flatten(list(string_split(auths, ','))))), ',') as auth_indicators from ge1 group by method, gh, gp)"""
SQL["gql_endpoints"] = BASE + GQL_EP.replace("SRC", f"(select * from {ARTS})") + f""" select {_gid('gql-endpoint', 'method', 'gh', 'gp')} as endpoint_id, method,
 gh as host, gp as path, {redact('f.url')} as url, f.source_file as source_file, occurrences, auth_indicators from ge"""

# --- operations: the shapes of the derived documents are known ---------------------------------------------

_OID = _gid("gql-endpoint", "method", "h", "p")


def sensitive(x: str) -> str:
    words = [w.lower() for w in rules.GQL_SENSITIVE]
    return (f"(lower({x}) in ({', '.join(q(w) for w in words)}) or "
            + has_any(f"lower({x})", [w for w in words if len(w) > 4]) + ")")


def object_id(x: str) -> str:
    return f"(lower({x}) in ({', '.join(q(n.lower()) for n in rules.GQL_OBJECT_IDS)}) or ends_with(lower({x}), 'id'))"


def fields(block: str) -> str:
    bare = f"regexp_replace(regexp_replace({block}, '\\$[A-Za-z_]\\w*', '', 'g'), '\\.\\.\\.[A-Za-z_]\\w*', '', 'g')"
    ignored = ", ".join(q(k) for k in rules.GQL_KEYWORDS)
    types = ", ".join(q(k) for k in rules.GQL_SCALARS)
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({bare}, '\\b[A-Za-z_]\\w*\\b'), lambda z: lower(z) not in ({ignored}) "
            f"and z not in ({types}))))")


# One row per document: the operation text up to its fragment, the fragment, and its place.
DOCS_CTE = f""", gd as (select source_file, entry_idx, {_OID} as endpoint_id, gql as doc, 0 as dpos from ex where t = 'graphql' union all
 select source_file, entry_idx, {_OID}, '{{ viewer {{ id }} }}', 1 from ex where t = 'graphql' and k % 15 = 0),
 op0 as (select *, regexp_extract(doc, '^(query|mutation)', 1) as op_type, regexp_extract(doc, '^(?:query|mutation) (\\w+)', 1) as name,
 regexp_extract(doc, '\\(([^)]*)\\)', 1) as args, regexp_extract(doc, '\\) (\\{{.*\\}})( fragment.*)?$', 1) as blk0 from gd where dpos = 0),
 op1 as (select *, case when contains(blk0, ' fragment ') then substr(blk0, 1, strpos(blk0, ' fragment ') - 1) else blk0 end as blk from op0),
 op2 as (select *, {fields('blk')} as fs, list_sort(list_distinct(regexp_extract_all(args || blk, '\\$([A-Za-z_]\\w*)', 1))) as vars from op1),
 op3 as (select *, list_filter(fs, lambda z: {sensitive('z')}) as sf, list_filter(vars, lambda z: {object_id('z')}) as oi,
 lower(name || ' ' || array_to_string(fs, ' ')) as comb from op2),
 op as (select *, {case_tags([(t, has_any('comb', ws)) for t, ws in rules.GQL_TAG_WORDS.items()] + [
    ('manual-authorization-review', 'true'), ('state-changing-mutation', "op_type = 'mutation'"), ('object-id-candidate', 'len(oi) > 0'),
    ('sensitive-field-selection', 'len(sf) > 0')])} as tags, {_gid('gql-operation', 'source_file', 'op_type', 'name', "'0'")} as operation_id from op3)"""
SQL["gql_operations"] = BASE + DOCS_CTE + f""" select operation_id, source_file, entry_idx, 0 as start, endpoint_id, op_type as operation_type,
 name as operation_name, array_to_string(vars, ',') as variables, array_to_string(list_transform(regexp_extract_all(args, '\\$\\w+:\\s*[\\w!]+'),
 lambda z: regexp_replace(z[2:], ':\\s*', ':')), ',') as variable_types, array_to_string(fs, ',') as fields,
 array_to_string(list_sort(list_distinct(regexp_extract_all(blk, '\\.\\.\\.([A-Za-z_]\\w*)', 1))), ',') as fragments,
 array_to_string(sf, ',') as sensitive_fields, array_to_string(oi, ',') as object_id_candidates, tags as risk_tags,
 {redact('blk')} as redacted_evidence from op"""
_FILES_CTE = """, gd as (select 'gql/' || ids || '.graphql' as source_file, cast(0 as bigint) as entry_idx, '' as endpoint_id, gql as doc, 0 as dpos
 from ex where t = 'graphql'),""" + DOCS_CTE[DOCS_CTE.index("\n op0 as"):]
SQL["gql_file_operations"] = SQL["gql_operations"].replace(DOCS_CTE, _FILES_CTE)
SQL["gql_variables"] = BASE + DOCS_CTE + f""", vr as (select unnest(vars) as name, args, source_file, entry_idx from op)
 select name, arg_min(regexp_extract(args, '\\$' || name || ':\\s*([\\w!]+)', 1), {{'a': source_file, 'b': entry_idx}}) as value_type,
 count(*) as operations, cast({sensitive('name')} as int) as sensitive, cast({object_id('name')} as int) as object_id_candidate from vr group by name"""
SQL["gql_fragments"] = BASE + (
    " select source_file, entry_idx, 'UserBits' as name, 'phone' as fields, '{ phone }' as redacted_evidence from ex "
    "where t = 'graphql' and contains(gql, 'fragment UserBits')")
_BATCH = f"select source_file, entry_idx, {_OID} as endpoint_id from ex where t = 'graphql' and k % 15 = 0"
_BID = _gid("gql-lead", "'batching_indicator'", "endpoint_id", "''", "'Observed GraphQL batch'")
SQL["gql_batches"] = BASE + (
    f" select source_file, entry_idx, {_BID} as lead_id, endpoint_id, 'A local artifact contains 2 GraphQL operations in one request.' as reason "
    f"from ({_BATCH})")
_ERR = "'[{\"message\": \"boom ' || ks || '\", \"path\": [\"user\"]}]'"
SQL["gql_errors"] = BASE + (
    f" select source_file, entry_idx, 'excessive_error_detail' as category, {redact(_ERR)} as evidence from ex where t = 'error'")
_SUP = "(select cast(s_suppkey as varchar) as s from supplier)"
SQL["gql_schema_sdl"] = f"""with sd as (select s, {D.SDL} as text from {_SUP}) select {_gid('gql-schema', "'schema/' || s || '.graphql'", "'sdl'")} as id,
 'schema/' || s || '.graphql' as source_file, 'schema_sdl' as artifact_type, array_to_string(list_sort(['Supplier' || s, 'Query', 'Role' || s]), ',')
 as type_names, array_to_string(list_sort(['supplier' || s, 'ownerOf' || s]), ',') as query_names, '' as mutation_names, '' as subscription_names,
 array_to_string(list_filter(list_sort(['Supplier' || s, 'Query', 'Role' || s]), lambda z: {sensitive('z')}), ',') as sensitive_types,
 array_to_string(list_filter(list_sort(['supplier' || s, 'ownerOf' || s]), lambda z: {sensitive('z')}), ',') as sensitive_fields,
 text as redacted_evidence from sd"""
SQL["gql_introspection"] = f"""select {_gid('gql-schema', "'schema/' || s || '.json'", "'introspection'")} as id, 'schema/' || s || '.json' as source_file,
 'introspection_json' as artifact_type, 'Query,Session' || s as type_names, 'email' || s || ',node' || s as query_names, '' as mutation_names,
 '' as subscription_names, 'Session' || s as sensitive_types, 'email' || s as sensitive_fields,
 'Local __schema artifact (values omitted).' as redacted_evidence from {_SUP}"""


def _leads() -> str:
    label = "case when name <> '' then name else op_type end"

    def lead(cat, title, sev, reason, question="''", src="op", cond="true", ep="endpoint_id", opid="operation_id", ev="''", side="0"):
        return (f"select {_gid('gql-lead', cat, ep, opid, title)} as lead_id, {cat} as category, {title} as title, {ep} as endpoint_id, "
                f"{opid} as operation_id, {sev} as severity, {reason} as reason, {question} as question, {ev} as evidence, source_file, entry_idx, "
                f"{side} as side from {src} where {cond}")

    parts = [
        lead("'idor_bola_candidate'", f"'Object ID variables in ' || {label}", "case when op_type = 'mutation' then 'medium' else 'low' end",
             "'Observed object identifier variables: ' || array_to_string(oi, ', ') || '.'",
             q("Can Actor A access an object owned by Actor B using the observed object ID variable?"), cond="len(oi) > 0"),
        lead("'sensitive_field_exposure'", f"'Sensitive fields selected by ' || {label}", "'low'",
             "'Selected fields need role and ownership review: ' || array_to_string(sf, ', ') || '.'",
             q("Are sensitive fields filtered by role and object ownership?"), cond="len(sf) > 0"),
        lead("'state_changing_mutation'", "'State-changing mutation: ' || case when name <> '' then name else 'unnamed' end", "'medium'",
             q("Mutations change server-side state and require manual authorization review."),
             q("Can a lower-privileged actor run this mutation directly?"), cond="op_type = 'mutation'")]
    for tag in rules.GQL_TAG_WORDS:
        words = tag.replace("-", " ")
        parts.append(lead(q(tag.replace("-", "_")), f"{q(words.title() + ': ')} || {label}", "'low'",
                          q(f"Observed operation names or fields indicate {words} review."),
                          cond=f"list_contains(string_split(tags, ','), {q(tag)})"))
    parts.append(lead("'batching_indicator'", "'Observed GraphQL batch'", "'info'",
                      "'A local artifact contains 2 GraphQL operations in one request.'", src=f"({_BATCH})", opid="''"))
    parts.append(lead("'excessive_error_detail'", "'Verbose GraphQL error details'", "'low'",
                      q("Captured errors include resolver, path, location, extension, exception, or stack details."),
                      src=f"(select *, '' as eid from ex where t = 'error')", ep="eid", opid="''", ev=redact(_ERR), side="1"))
    parts.append(lead("'introspection_artifact'", "'Local GraphQL schema/introspection artifact'",
                      "case when sensitive_types <> '' or sensitive_fields <> '' then 'low' else 'info' end",
                      q("A locally captured schema artifact can guide authorized manual review."),
                      src=f"(select *, cast(0 as bigint) as entry_idx, '' as eid from ({SQL['gql_schema_sdl']}))", ep="eid", opid="''",
                      ev="redacted_evidence", side="2"))
    return " union all ".join(parts)


LEADS = f""", ld as (select lead_id, arg_max({{'category': category, 'title': title, 'endpoint_id': endpoint_id, 'operation_id': operation_id,
 'severity': severity, 'reason': reason, 'question': question, 'evidence': evidence}}, {{'a': source_file, 'b': entry_idx, 'c': side}}) as f
 from ({_leads()}) group by lead_id)"""
SQL["gql_leads"] = BASE + DOCS_CTE + LEADS + (
    " select lead_id, f.category as category, f.title as title, f.endpoint_id as endpoint_id, f.operation_id as operation_id, "
    "f.severity as severity, f.reason as reason, f.question as question, f.evidence as evidence from ld")
SQL["gql_summary"] = BASE + GQL_EP.replace("SRC", f"(select * from {ARTS} where false)") + DOCS_CTE + (
    " select 'endpoints' as list_name, count(*) as rows from ge union all select 'operations', count(*) from op union all "
    "select 'variables', count(distinct v) from (select unnest(vars) as v from op) union all select 'fragments', count(*) from ex "
    "where t = 'graphql' and contains(gql, 'fragment UserBits') union all select 'schema_artifacts', count(*) from supplier")

# --- vocabulary ------------------------------------------------------------------------------------------------

_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _unq(x: str) -> str:
    return "trim(" + _STRIP.format(f"url_decode({x})") + ", '\"''`')"


def normalized(x: str) -> str:
    return f"lower(regexp_replace({_unq(x)}, '\\s+', ' ', 'g'))"


def split(x: str) -> str:
    """camelCase and separator split: a marker goes between a lower letter or digit and an upper letter."""
    camel = f"regexp_replace(regexp_replace({_unq(x)}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return (f"list_transform(list_filter(regexp_split_to_array({camel}, '[/_.\\-\\s:{{}}\\[\\]()]+'), lambda z: z <> ''), lambda z: lower(z))")


_SECRET_TERM = (r"(?i)(bearer\s+\S+|eyJ[\w-]{5,}\.[\w-]{5,}\.[\w-]{5,}|(?:secret|password|token|api[_-]?key|session(?:id)?)\s*[=:]\s*\S+)")


def useful(n: str) -> str:
    stops = ", ".join(q(w) for w in rules.STOPWORDS)
    return (f"({n} <> '' and {n} not in ({stops}) and length({n}) between 2 and 180 and not {rx(n, '^[0-9]+$')} "
            f"and not {rx(n, _SECRET_TERM)} and not starts_with({n}, '<redacted-'))")


def classify(n: str, default: str) -> str:
    return "case " + " ".join(f"when {has_any(n, ws)} then {q(c)}" for c, ws in rules.TERM_CATEGORY_WORDS) + f" else {default} end"


def term_tags(n: str, cat: str) -> str:
    owned = f"({cat} = 'object_name' or ends_with({n}, 'id'))"
    pairs = []
    for t, ws in rules.TERM_TAG_WORDS.items():
        extra = {"graphql": f" or starts_with({cat}, 'graphql')", "idor": f" or {owned}", "bola": f" or {owned}"}.get(t, "")
        pairs.append((t, has_any(n, ws) + extra))
    return case_tags(pairs)


def risk(n: str) -> str:
    return "least(100, " + " + ".join(f"case when contains({n}, {q(w)}) then {v} else 0 end" for w, v in rules.RISK_WORDS.items()) + ")"


def freq(n: str) -> str:
    return f"least(100, cast(round_even(20 * log2({n} + 1), 0) as int))"


def terms(raw: str) -> str:
    """CTEs from raw (value, category, classify, source_file) rows to aggregated terms."""
    return f""" rt as ({raw}), rn as (select *, {_STRIP.format('value')} as v, {normalized(_STRIP.format('value'))} as n from rt where value is not null),
 rc2 as (select v, n, source_file, case when classify then {classify('n', 'category')} else category end as category from rn where {useful('n')}),
 tm as (select n as normalized_value, category, count(*) as occurrences, min(v) as value from rc2 group by all)"""


def _rows(source: str, expr: str, cat: str, cls: str = "false") -> str:
    return f"select source_file, {expr} as value, {q(cat)} as category, {cls} as classify from {source}"


def _ex_terms() -> str:
    hdr = ["host", "rq_auth", "rq_apikey", "rq_csrf", "rq_cookie", "rq_origin", "ct", "rs_cache", "rs_hsts", "rs_csp", "rs_xcto", "rs_acao",
           "rs_acac", "rs_vary", "rs_acam", "sc1", "sc2"]
    names = ["Host", "Authorization", "X-Api-Key", "X-CSRF-Token", "Cookie", "Origin", "Content-Type", "Cache-Control",
             "Strict-Transport-Security", "Content-Security-Policy", "X-Content-Type-Options", "Access-Control-Allow-Origin",
             "Access-Control-Allow-Credentials", "Vary", "Access-Control-Allow-Methods", "Set-Cookie", "Set-Cookie"]
    parts = [_rows("ex", "p", "endpoint_path"), _rows("ex", f"unnest({split(path('url'))})", "route_segment", "true"),
             _rows("ex where t = 'click'", "'lang'", "query_param"), _rows("ex where rq_ck is not null", "'csrf_token'", "cookie_name"),
             _rows("ex where rs_ck is not null", "'pref'", "cookie_name"), _rows("ex where t = 'signup'", "'username'", "body_param"),
             _rows("ex where t = 'signup'", "'remember'", "body_param"),
             _rows(f"({keys_of('request_body')})", "key", "json_key", "true"), _rows(f"({keys_of('response_body')})", "key", "response_key", "true")]
    parts += [_rows(f"ex where {c} is not null", q(n), "header_name") for c, n in zip(hdr, names, strict=True)]
    return " union all ".join(parts)


def _text_terms(src: str) -> str:
    found = lambda pattern, g=0: f"unnest(regexp_extract_all(text, {q(pattern)}, {g}))"
    route = f"select source_file, rtrim(r, '.,;)') as r from (select source_file, {found('(?:https?://[^\\s\"''<>]+)?(/[A-Za-z0-9_./{}:-]+)', 1)} as r from {src})"
    prop = "(?:[\"']([A-Za-z][\\w.-]{1,})[\"']\\s*:|\\.([A-Za-z_$][\\w$]*))"
    parts = [
        _rows(f"({route})", "r", "endpoint_path"), _rows(f"({route})", f"unnest({split('r')})", "route_segment", "true"),
        _rows(src, found("(?i)<(?:input|select|textarea)[^>]+(?:name|id)=[\"']([^\"']+)", 1), "form_field"),
        _rows(f"(select source_file, {found(prop, 1)} as a, {found(prop, 2)} as b from {src})", "case when a <> '' then a else b end",
              "json_key", "true"),
        _rows(src, found("(?i)\\b(?:X-[A-Za-z0-9-]+|Authorization|Content-Type|Accept-Language|X-CSRF-Token)\\b"), "header_name"),
        _rows(src, found("(?i)(?:document\\.cookie\\s*=|cookie\\s*[:=])\\s*['\"]?([A-Za-z_][\\w-]*)", 1), "cookie_name"),
        _rows(src, found("(?:localStorage|sessionStorage)\\.(?:getItem|setItem)\\(\\s*['\"]([^'\"]+)", 1), "object_name", "true"),
        _rows(src, found("\\b(query|mutation|subscription)\\s+([A-Za-z_]\\w*)", 2), "graphql_operation"),
        _rows(src, found("\\$([A-Za-z_]\\w*)", 1), "graphql_variable"),
        _rows(f"(select source_file, unnest(regexp_extract_all(text, '[\\pL\\pN_\\pM]+')) as w from {src}) where "
              "regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{2,}$')", "w", "javascript_identifier", "true")]
    return " union all ".join(parts)


def _gql_terms() -> str:
    return " union all ".join([
        _rows("gd where dpos = 0", "unnest(regexp_extract_all(doc, '\\b(query|mutation|subscription)\\s+([A-Za-z_]\\w*)', 2))", "graphql_operation"),
        _rows("gd", "unnest(regexp_extract_all(doc, '\\$([A-Za-z_]\\w*)', 1))", "graphql_variable"),
        _rows("gd where dpos = 0", "'orgId'", "graphql_variable")])


EXT = BASE + "," + terms(_ex_terms())
SQL["exchange_terms"] = EXT + f""" select {id12('vocab', "normalized_value || '|' || category")} as id, normalized_value, category, occurrences,
 {freq('occurrences')} as frequency_score, {risk('normalized_value')} as risk_score, {term_tags('normalized_value', 'category')} as tags from tm"""
SQL["term_sources"] = EXT + (" select n as normalized_value, category, source_file, count(*) as occurrences from rc2 group by all")
SQL["term_summary"] = EXT + (
    " select 'terms' as metric, count(*) as value from tm union all select 'occurrences', cast(sum(occurrences) as bigint) from tm union all "
    "select 'sources_analyzed', count(distinct source_file) from ex")
_RANKED = f"(select *, {risk('normalized_value')} as risk_score from tm)"
SQL["top_terms_per_category"] = EXT + f""" select category, cast(rank as int) as rank, normalized_value, risk_score, occurrences from (select *,
 row_number() over (partition by category order by risk_score desc, occurrences desc, normalized_value) as rank from {_RANKED}) where rank <= 25"""
_LISTS = [f"select {q(name)} as list, {normalized('value')} as term from tm" + (
    "" if name == "all" else f" where category in ({', '.join(q(c) for c in cats)})") for name, cats in rules.WORDLISTS.items()]
_LISTS += [f"select {q(t)}, {normalized('value')} from (select *, {term_tags('normalized_value', 'category')} as tags from tm) "
           f"where list_contains(string_split(tags, ','), {q(t)})" for t in rules.TAG_WORDLISTS]
_LISTS += [f"select category, {normalized('value')} from tm where category not in ({', '.join(q(n) for n in [*rules.WORDLISTS, *rules.TAG_WORDLISTS])})"]
SQL["term_lists"] = EXT + f" select distinct list, term from ({' union all '.join(_LISTS)})"
SQL["term_variants"] = EXT + f""", tv0 as (select normalized_value, category, {split('value')} as w from tm),
 tv1 as (select *, w[1] || array_to_string(list_transform(w[2:], lambda z: upper(z[1]) || z[2:]), '') as camel, array_to_string(w, '') as fl from tv0
 where len(w) > 0), tv2 as (select normalized_value, category, unnest(list_distinct([camel, array_to_string(w, '_'), array_to_string(w, '-'), fl, upper(fl),
 case when ends_with(camel, 's') and length(camel) > 3 then camel[:-2] else camel || 's' end])) as variant from tv1)
 select * from tv2 where {useful(normalized('variant'))}"""
SQL["gql_terms"] = BASE + DOCS_CTE + "," + terms(_gql_terms()) + " select normalized_value, category, occurrences, value from tm"
SQL["term_merge"] = BASE + DOCS_CTE + "," + terms(_ex_terms() + " union all " + _gql_terms()) + (
    f" select normalized_value, category, occurrences, {freq('occurrences')} as frequency_score from tm")
SQL["text_terms"] = "with" + terms(_text_terms(ARTS)) + " select normalized_value, category, occurrences from tm"
_BOTH = BASE + "," + terms(_ex_terms() + " union all " + _text_terms(PAGES))
SQL["term_categories"] = _BOTH + " select category, count(*) as terms, cast(sum(occurrences) as bigint) as occurrences from tm group by category"
SQL["top_terms"] = _BOTH + (f" select normalized_value, category, risk_score, occurrences from {_RANKED} "
                            "order by risk_score desc, occurrences desc, normalized_value, category limit 25")
_SAVED = f"(select 'saved/' || ids || '.json' as source_file, {D.SAVED} as text from {EVENTS})"
SQL["json_key_terms"] = "with" + terms(
    f"select source_file, k.key as value, 'json_key' as category, true as classify from {_SAVED} e, json_tree(e.text) k "
    "where k.key is not null and not regexp_matches(k.fullkey, '\\]$')") + " select normalized_value, category, occurrences from tm"
_MATRIX = " union all ".join([
    _rows("(select '' as source_file, c_mktsegment from customer)", "c_mktsegment", "role_permission_term"),
    _rows("(select '' as source_file from orders)", "'order'", "object_name", "true"),
    _rows("(select '' as source_file from orders)", "'orderId'", "object_name"),
    _rows("(select '' as source_file, '/api/orders/{id}/lines/' || cast(l_linenumber as varchar) as pt from (select distinct l_linenumber from lineitem))",
          "pt", "endpoint_path"),
    _rows("(select '' as source_file, '/api/orders/{id}/lines/' || cast(l_linenumber as varchar) as pt from (select distinct l_linenumber from lineitem))",
          f"unnest({split('pt')})", "route_segment", "true"),
    _rows("(select '' as source_file from (select distinct l_linenumber from lineitem))", "'id'", "object_name", "true"),
    _rows("(select '' as source_file, case when n = 2 then 'admin' when n = 6 then 'state-changing' else 'billing' end as tag from "
          "(select distinct l_linenumber as n from lineitem))", "tag", "object_name", "true"),
    _rows("(select '' as source_file, boundary_type from lic)", "boundary_type", "organization_term", "true")])
_LIC = """lic as (select actor_id, object_id, endpoint_template_id, arg_max(boundary_type, {'a': o1, 'b': o2, 'c': expected_result || reason}) as boundary_type
 from """ + D.staged_sql("lineitem", D.EXPECTED) + " group by all)"
SQL["inventory_terms"] = "with " + _LIC + "," + terms(_MATRIX) + " select normalized_value, category, occurrences from tm"
_WS = D.staged_sql("documents", D.WORKSPACE)
_WSR = f"(select id as source_file, *, {path('asset')} as ap, 'Open the page' as action from {_WS})"
SQL["workspace_terms"] = "with" + terms(" union all ".join([
    _rows(f"{_WSR} where asset is not null", f"unnest({split(chr(39) * 2 + ' || ap')})", "route_segment", "true"), _rows(_WSR, "title", "object_name", "true"),
    _rows(_WSR, "'idor'", "object_name", "true"), _rows(_WSR, "'Evidence'", "object_name", "true"),
    _rows(f"{_WSR} where doc_id % 8 <> 0", "unnest(['Open', 'the', 'page'])", "javascript_identifier", "true")])) + (
    " select normalized_value, category, occurrences from tm")

_EPI, _RCI, _STI = (f"({SQL[n]})" for n in ("text_endpoint_inventory", "runtime_config", "storage_refs"))
_RTI = f"(select 'pages/' || cast(page_id as varchar) as source_file, {path('url')} as path from pages)"
_split_list = "unnest(string_split({}, ','))".format
SQL["saved_table_terms"] = "with" + terms(" union all ".join(
    [_rows(src, col, "endpoint_path") for src, col in ((_EPI, "path"), (_EPI, "normalized_path"), (_RTI, "path"))]
    + [_rows(src, f"unnest({split(col)})", "route_segment", "true") for src, col in ((_EPI, "path"), (_EPI, "normalized_path"), (_RTI, "path"))]
    + [_rows(_EPI, _split_list("object_id_candidates"), "object_name"), _rows(_EPI, _split_list("risk_tags"), "unknown", "true"),
       _rows(_RCI, _split_list("config_keys"), "json_key", "true"), _rows(_RCI, "title", "object_name", "true"), _rows(_STI, "key", "object_name", "true")])) + (
    " select normalized_value, category, occurrences from tm")
