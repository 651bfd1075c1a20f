"""SQL of the cookie, header, cache, token and front-end queries."""

from __future__ import annotations

from triage import rules
from triage.plans import derived as D
from triage.plans.oracle import (
    ARTS, BASE, DOCS, EVENTS, LINES, NEAR_SINKS, NEAR_SOURCES, RESP_BY_NAME, SQL, case_tags, has_any, host, id12, netloc,
    ordered_tags, path, per_line, ph, q, redact, rx, scheme, sensitive_ctes,
)

# --- cookies ---------------------------------------------------------------------------------------

_REVIEW_TYPE = ("case when regexp_matches(ln, 'session|sid|sess') then 'session' when regexp_matches(ln, 'auth|token|jwt') then 'auth' "
                "when regexp_matches(ln, 'csrf|xsrf') then 'csrf' when regexp_matches(ln, 'analytics|track|_ga|_gid') then 'tracking' "
                "when regexp_matches(ln, 'pref|theme|locale|lang') then 'preference' else 'unknown' end")
_SURFACE_TYPE = ("case when regexp_matches(ln, 'csrf|xsrf') then 'csrf' when contains(ln, 'sess') then 'session' "
                 "when regexp_matches(ln, 'auth|token|jwt') then 'auth' when regexp_matches(ln, 'ga|track') then 'tracking' "
                 "when regexp_matches(ln, 'theme|pref') then 'preference' else 'unknown' end")


def _attr(name: str) -> str:
    return f"trim(regexp_extract(raw, '(?i);\\s*{name}=([^;]*)', 1))"


def _flag(name: str) -> str:
    return f"regexp_matches(raw, '(?i);\\s*{name}\\s*(;|$)')"


_REQ = "'session_id=s' || us || 'abc; theme=dark; _ga=GA1.' || ks"
SQL["cookie_review"] = BASE + f""", seen as (
 select source_file, entry_idx, rurl, 'request cookie' as source, 'csrf_token' as raw, 0 as pos from ex where rq_ck is not null union all
 select source_file, entry_idx, rurl, 'request Cookie header', trim(split_part(z, '=', 1)), 0 from
  (select *, unnest(string_split(rq_cookie, ';')) as z from ex where rq_cookie is not null) union all
 select source_file, entry_idx, rurl, 'response Set-Cookie header', sc1, 0 from ex where sc1 is not null union all
 select source_file, entry_idx, rurl, 'response Set-Cookie header', sc2, 1 from ex where sc2 is not null union all
 select source_file, entry_idx, rurl, 'response Set-Cookie header', 'pref=' || rs_ck, 2 from ex where rs_ck is not null),
 pa as (select *, source = 'response Set-Cookie header' as resp, lower(split_part(raw, '=', 1)) as ln from seen),
 pb as (select source_file, entry_idx, pos, rurl as source_url, source, split_part(raw, '=', 1) as name, {_REVIEW_TYPE} as cookie_type,
 cast(resp and {_flag('secure')} as int) as secure, cast(resp and {_flag('httponly')} as int) as http_only,
 case when resp then {_attr('samesite')} else '' end as same_site, case when resp then {_attr('domain')} else '' end as domain,
 case when resp then {_attr('path')} else '' end as path, case when resp then {_attr('expires')} else '' end as expires,
 case when resp then {_attr('max-age')} else '' end as max_age, resp from pa),
 pc as (select *, case when not resp then '' else {ordered_tags([
    ('Secure attribute is missing (warning).', 'secure = 0'),
    ('HttpOnly is missing on a likely sensitive cookie (warning).', "cookie_type in ('session', 'auth') and http_only = 0"),
    ('HttpOnly attribute is missing (informational).', "cookie_type not in ('session', 'auth') and http_only = 0"),
    ('SameSite attribute is missing (informational).', "same_site = ''")])} end as observations from pb)
 select source_file, name, source, source_url, same_site, f.cookie_type as cookie_type, f.secure as secure, f.http_only as http_only,
 f.domain as domain, f.path as path, f.expires as expires, f.max_age as max_age, f.observations as observations from (
 select source_file, name, source, source_url, same_site, arg_max({{'cookie_type': cookie_type, 'secure': secure, 'http_only': http_only,
 'domain': domain, 'path': path, 'expires': expires, 'max_age': max_age, 'observations': observations}}, entry_idx * 10 + pos) as f
 from pc group by all)"""


def _cookie_obs(seen: str) -> str:
    return f""" ca as (select *, lower(name) as ln from ({seen})),
 cb as (select *, {_SURFACE_TYPE} as cookie_type, {_flag('secure')} as sec, {_flag('httponly')} as ho, {_attr('samesite')} as samesite,
 {_attr('domain')} as domain, {_attr('path')} as cpath, {_attr('expires')} as expires, try_cast({_attr('max-age')} as bigint) as max_age,
 case when starts_with(name, '__Host-') then '__Host-' when starts_with(name, '__Secure-') then '__Secure-' else '' end as prefix from ca),
 cc as (select *, cookie_type in ('session', 'auth') as sens from cb),
 co as (select *, {case_tags([
    ('missing-secure', 'resp and sens and not sec'), ('missing-httponly', 'resp and sens and not ho'),
    ('missing-samesite', "resp and sens and samesite = ''"), ('broad-domain', "starts_with(domain, '.')"),
    ('host-prefix-misuse', "prefix = '__Host-' and (not sec or domain <> '' or cpath <> '/')"),
    ('secure-prefix-misuse', "prefix = '__Secure-' and not sec"), ('csrf-cookie-indicator', "cookie_type = 'csrf'"),
    ('sensitive-request-cookie', 'not resp and sens')])} as risk_tags from cc)"""


_SEEN = """select source_file, entry_idx, 'request Cookie header' as location, false as resp, split_part(trim(z), '=', 1) as name, z as raw from
 (select *, unnest(string_split(rq_cookie, ';')) as z from ex where rq_cookie is not null) union all
 select source_file, entry_idx, 'response Set-Cookie header', true, split_part(z, '=', 1), z from
 (select *, unnest(list_filter([sc1, sc2], lambda v: v is not null)) as z from ex) union all
 select source_file, entry_idx, 'HAR request cookie', false, 'csrf_token', 'csrf_token=' || rq_ck from ex where rq_ck is not null union all
 select source_file, entry_idx, 'HAR response cookie', true, 'pref', 'pref=' || rs_ck || '; Path=/; Secure; SameSite=Lax' from ex
 where rs_ck is not null"""
COOKIES = BASE + "," + _cookie_obs(_SEEN)
SQL["cookie_observations"] = COOKIES + f""" select 'cookie-' || substr(sha256(source_file || location || name || raw), 1, 12) as id, source_file,
 entry_idx, name, location, cookie_type, domain, cpath as path, case when resp then cast(sec as int) end as secure,
 case when resp then cast(ho as int) end as httponly, samesite, expires, max_age, prefix, risk_tags,
 case when risk_tags <> '' then 'low' else 'info' end as severity, name || '=<redacted-cookie-value>' as redacted_evidence from co"""
_RAW = f"(select 'raw/' || ids || '.http' as source_file, {D.RAW_HTTP} as text, i, us, ks from {EVENTS})"
SQL["raw_http_cookies"] = "with" + _cookie_obs(f"""select source_file, case when i % 2 = 0 then 'request Cookie header' else
 'response Set-Cookie header' end as location, i % 2 = 1 as resp, case when i % 2 = 0 then 'session_id' else 'auth_token' end as name,
 case when i % 2 = 0 then 'session_id=s' || us else 'auth_token=t' || ks || '; Path=/' end as raw from {_RAW}""") + (
    " select source_file, name, location, cookie_type, risk_tags from co")
SQL["raw_http_cache"] = (
    f"select source_file, trim(regexp_extract(text, 'Cache-Control: ([^\\n]*)', 1)) as value from {_RAW} where i % 2 = 1")

# --- headers ----------------------------------------------------------------------------------------------

_OBS_ROWS = " union all ".join(
    f"select source_file, entry_idx, rurl as source_url, {q(h)} as header, {redact(RESP_BY_NAME[h])} as value from ex "
    f"where {RESP_BY_NAME[h]} is not null" for h in rules.REVIEWED_HEADERS if h in RESP_BY_NAME)
_MISSING = " union all ".join(
    f"select source_file, entry_idx, rurl, {q(h)}, '<missing>', 'informational', "
    f"'Header not observed in this response; applicability requires manual review.' from ex where {RESP_BY_NAME[h]} is null"
    for h in rules.EXPECTED_HEADERS)
SQL["header_review"] = BASE + f""", ho as ({_OBS_ROWS})
 select *, case when header = 'access-control-allow-origin' and value = '*' then 'needs manual review' else 'informational' end as classification,
 case when header = 'access-control-allow-origin' and value = '*' then
 'Wildcard CORS origin observed; assess with credentials and data sensitivity.' else
 'Header observed; validate its policy in application context.' end as observation from ho union all {_MISSING}"""
_SEC = " union all ".join(
    f"select source_file, entry_idx, url, status, {q(h)} as header_name, {RESP_BY_NAME[h]} as value from ex where {RESP_BY_NAME[h]} is not null"
    for h in rules.OBSERVED_SECURITY_HEADERS if h in RESP_BY_NAME)
_CSP = ordered_tags([
    ("csp-unsafe-inline", "contains(lv, '''unsafe-inline''')"), ("csp-unsafe-eval", "contains(lv, '''unsafe-eval''')"),
    ("csp-wildcard", "contains(lv, '*')"), ("csp-missing-object-src", "not contains(lv, 'object-src')"),
    ("csp-missing-frame-ancestors", "not contains(lv, 'frame-ancestors')")])
SECURITY = BASE + f""", sh0 as (select *, lower(value) as lv from ({_SEC})),
 sh as (select *, case when header_name = 'content-security-policy' then {_CSP} else '' end as risk_tags from sh0)"""
SQL["security_headers"] = SECURITY + f""" select 'header-' || substr(sha256(source_file || cast(entry_idx as varchar) || header_name || value),
 1, 12) as id, source_file, entry_idx, url, status as status_code, header_name, substr({redact('value')}, 1, 300) as value_summary, risk_tags,
 case when risk_tags <> '' then 'low' else 'info' end as severity, header_name || ': ' || {redact('value')} as redacted_evidence from sh"""
_ACAM = "list_filter(regexp_split_to_array(coalesce(rs_acam, ''), '[ ,]+'), lambda z: z <> '')"
CORS = BASE + f""", cors as (select source_file, entry_idx, url, rs_acao as allow_origin, coalesce(rs_acac, '') = 'true' as cred,
 coalesce(rs_vary, '') as vary, coalesce(rq_origin, '') as ro, {_ACAM} as am from ex where rs_acao is not null)"""
SQL["cors_observations"] = CORS + f""", ct as (select *, {ordered_tags([
    ('wildcard-origin', "allow_origin = '*'"), ('null-origin', "allow_origin = 'null'"), ('credentials-allowed', 'cred'),
    ('wildcard-with-credentials', "allow_origin = '*' and cred"), ('reflected-looking-origin', "ro <> '' and allow_origin = ro"),
    ('missing-vary-origin', "ro <> '' and allow_origin = ro and not contains(lower(vary), 'origin')"),
    ('broad-methods', "list_contains(am, '*') or len(am) > 5")])} as risk_tags from cors)
 select source_file, entry_idx, url, allow_origin, cast(cred as int) as allow_credentials, vary, array_to_string(am, ',') as allow_methods,
 '' as allow_headers, '' as expose_headers, risk_tags, case when risk_tags <> '' then 'low' else 'info' end as severity,
 'cors-' || substr(sha256(source_file || cast(entry_idx as varchar) || allow_origin), 1, 12) as id from ct"""
CACHE = f""", cr as (select source_file, entry_idx, rurl as source_url, coalesce(rs_cache, '') as cc from ex
 where regexp_matches(lower(p), 'api|account|user|profile|session|token') or contains(lower(mime_type), 'json')),
 cr2 as (select *, case when cc = '' then 'No Cache-Control header observed on an API or sensitive-looking response.'
 when contains(lower(cc), 'public') then 'Cache-Control permits public caching of an API or sensitive-looking response.'
 when try_cast(regexp_extract(lower(cc), 'max-age\\s*=\\s*(\\d+)', 1) as bigint) >= 86400 then
 'A long cache max-age was observed on an API or sensitive-looking response.' end as observation from cr),
 cache as (select source_file, entry_idx, source_url, 'needs manual review' as classification, observation,
 case when cc = '' then '<missing>' else {redact('cc')} end as cache_control from cr2 where observation is not null)"""
SQL["cache_review"] = BASE + CACHE + " select * from cache"
_AGE = "try_cast(regexp_extract(cc, '(?i)max-age=(\\d+)', 1) as bigint)"
CACHE_OBS = BASE + f""", c0 as (select source_file, entry_idx, url, status, mime_type, ct, coalesce(rs_cache, '') as cc from ex
 where regexp_matches(url || response_body, '(?i)email|phone|account|profile|token|session|password|tenant|invoice')),
 cob as (select *, {ordered_tags([
    ('sensitive-response-missing-cache-control', "cc = ''"), ('sensitive-response-public-cache', "contains(lower(cc), 'public')"),
    ('sensitive-response-long-max-age', f'{_AGE} > 3600')])} as risk_tags from c0)"""
SQL["cache_observations"] = CACHE_OBS + """ select 'cache-' || substr(sha256(source_file || cast(entry_idx as varchar) || url), 1, 12) as id,
 source_file, entry_idx, url, status as status_code, cc as cache_control, '' as pragma, '' as expires,
 case when mime_type <> '' then mime_type else ct end as content_type, 1 as sensitive_context, risk_tags, 'low' as severity
 from cob where risk_tags <> ''"""

# --- third parties and findings ---------------------------------------------------------------------------------

_ROOT = "array_to_string(list_slice(string_split({}, '.'), -2, -1), '.')"
_PRIMARY = (", prim as (select source_file, arg_min(h, entry_idx) as ph from ex group by source_file), "
            f"tp as (select ex.* from ex join prim using (source_file) where h <> '' and {_ROOT.format('h')} <> {_ROOT.format('ph')})")
SQL["third_parties"] = BASE + sensitive_ctes() + _PRIMARY + f""", lk as (select source_file, {host('source_url')} as h,
 string_agg(distinct category, ',' order by category) as cats from sens group by all)
 select source_file, h as host, count(*) as request_count, string_agg(distinct method, ',' order by method) as methods,
 coalesce(any_value(cats), '') as sensitive_categories from tp left join lk using (source_file, h) group by source_file, h"""
SQL["third_party_urls"] = BASE + _PRIMARY + (
    " select source_file, h as host, rurl as source_url, count(*) as requests from tp group by all")
_FID = "'HAR-' || upper(substr(sha256({}), 1, 10))"
SQL["har_findings"] = BASE + sensitive_ctes() + CACHE + f"""
 select {_FID.format("category || '|' || location || '|' || source_url")} as id, source_file, 'Sensitive material observed in ' || location as title,
 category as type, 'info' as severity, 'high' as confidence, source_url as asset, name || ': ' || {ph('category')} as redacted_evidence,
 'Captured HAR data may expose sensitive material if shared or stored insecurely.' as impact,
 'Confirm necessity, rotate exposed test values when appropriate, and share only redacted captures.' as recommendation, location from sens
 union all select {_FID.format("'cache-review|' || observation || '|' || source_url")}, source_file, 'Response caching needs manual review',
 'risky-cache', 'info', 'medium', source_url, observation,
 'Shared or long-lived caching may expose response data depending on application context.',
 'Review response sensitivity and intended intermediary/browser caching behavior.', 'response header' from cache"""

# --- tokens ------------------------------------------------------------------------------------------------------------

_TOK = "eyJ[A-Za-z0-9_-]{2,}\\.[A-Za-z0-9_-]{2,}\\.[A-Za-z0-9_-]+"
TOKENS = BASE + f""", tk0 as (select source_file, 0 as r, unnest(regexp_extract_all(url, {q(_TOK)})) as token from ex union all
 select source_file, 1, unnest(regexp_extract_all(rq_auth, {q(_TOK)})) from ex where rq_auth is not null union all
 select source_file, 2, unnest(regexp_extract_all(response_body, {q(_TOK)})) from ex),
 tk as (select source_file, token, case min(r) when 0 then 'request URL' when 1 then 'HAR request' else 'HAR response' end as location,
 1 as occurrences from tk0 group by source_file, token union all
 select source_file, token, 'local file', count(*) from (select source_file, unnest(regexp_extract_all(text, {q(_TOK)})) as token from {ARTS})
 group by all)"""
SQL["jwt_candidates"] = TOKENS + " select * from tk"


def _b64(part: int) -> str:
    raw = f"replace(replace(split_part(token, '.', {part}), '-', '+'), '_', '/')"
    return f"cast(decode(from_base64(rpad({raw}, cast(ceil(length({raw}) / 4) * 4 as int), '='))) as json)"


_SENS = "list_filter(['email', 'username', 'name'], lambda z: list_contains(ck, z))"
_AS_OF = f"epoch(timestamp '{D.AS_OF}')"
_STD = "[" + ", ".join(q(x) for x in rules.STANDARD_CLAIMS) + "]"
JWT = TOKENS + f""", j0 as (select *, {_b64(1)} as hd, {_b64(2)} as pl from tk),
 j1 as (select *, json_keys(pl) as ck, cast(pl->>'exp' as bigint) as exp, cast(pl->>'iat' as bigint) as iat,
 coalesce(pl->>'aud', '') as aud, coalesce(pl->>'iss', '') as issuer, coalesce(hd->>'alg', '') as algorithm,
 cast(pl->'roles' as varchar[]) as roles from j0),
 jw as (select *, {ordered_tags([
    ('missing-exp', 'exp is null'), ('long-lifetime', 'exp - iat > 86400'), ('expired', f'exp < {_AS_OF}'),
    ('far-future-expiry', f'floor((exp - {_AS_OF}) / 86400) > 365'),
    ('admin-like-role', "regexp_matches(array_to_string(roles, ' '), '(?i)admin|owner|superuser')"),
    ('sensitive-claims', f'len({_SENS}) > 0'), ('missing-audience', "aud = ''"), ('missing-issuer', "issuer = ''"),
    ('token-in-url', "contains(lower(location), 'url')"),
    ('unusual-algorithm-manual-review', "lower(algorithm) in ('none', 'hs256', 'hs384', 'hs512')"),
    ('tenant-claims', "list_contains(ck, 'tenantId')"), ('org-claims', "list_contains(ck, 'org')")])} as risk_tags from j1)"""
SQL["jwt_metadata"] = JWT + f""" select {id12('jwt', 'token')} as id, substr(sha256(token), 1, 16) as token_fingerprint, source_file, location,
 occurrences, algorithm, coalesce(hd->>'typ', '') as token_type, coalesce(hd->>'kid', '') as key_id, issuer,
 cast(list_contains(ck, 'sub') as int) as subject_present, aud as audience, iat, cast(null as bigint) as nbf, exp,
 'read,write' as scopes, array_to_string(roles, ',') as roles, '' as permissions, 'tenantId' as tenant_claims, '' as org_claims,
 array_to_string({_SENS}, ',') as sensitive_claims,
 array_to_string(list_sort(list_filter(ck, lambda z: not list_contains({_STD}, z))), ',') as custom_claim_keys,
 '<redacted-jwt:' || substr(sha256(token), 1, 12) || '>' as redacted_evidence, exp - iat as lifetime_seconds, risk_tags,
 case when contains(risk_tags, 'token-in-url') then 'medium' when risk_tags <> '' then 'low' else 'info' end as severity,
 'high' as confidence from jw"""
_FIRST = JWT + ", fj as (select * from jw qualify source_file = min(source_file) over (partition by token))"
SQL["jwt_merged"] = _FIRST + (
    f" select {id12('jwt', 'token')} as id, source_file, occurrences, algorithm, location from fj")
SQL["jwt_checklist"] = _FIRST + """, tags as (select substr(sha256(token), 1, 16) as token_fingerprint, unnest(string_split(risk_tags, ',')) as tag
 from fj where risk_tags <> '') select *, 'Review ' || replace(tag, '-', ' ') || ' signal for token ' || token_fingerprint || '.' as item from tags"""
_ATAGS = case_tags([(t, has_any("lower(url)", ws)) for t, ws in rules.AUTH_TAG_WORDS.items()])
AUTH_EP = f""", ae0 as (select source_file, entry_idx as ord, method, url from ex union all
 select source_file, generate_subscripts(us, 1), 'UNKNOWN', unnest(us) from (select source_file,
 regexp_extract_all(text, {q(rules.URLS_IN_TEXT.replace('(?Ud)', ''))}) as us from {ARTS})),
 ae1 as (select *, {_ATAGS} as tags, case when {path('url')} = '' then url else {path('url')} end as pth, {netloc('url')} as nl2 from ae0),
 ae as (select method, nl2, pth, count(*) as occurrences, arg_min({{'source_file': source_file, 'url': url, 'tags': tags,
 'scheme': {scheme('url')}}}, {{'a': source_file, 'b': ord}}) as f from ae1 where tags <> '' group by method, nl2, pth)"""
SQL["auth_endpoints"] = BASE + AUTH_EP + """ select 'auth-endpoint-' || substr(sha256(method || nl2 || pth), 1, 12) as id, method,
 f.scheme as scheme, nl2 as host, pth as path, f.url as url, f.source_file as source_file, occurrences, f.tags as risk_tags from ae"""
_SQ = ", ".join(f"({len(rules.ALWAYS_ASKED) + i}, {q(t)}, {q(x)})" for i, (t, x) in enumerate(rules.SESSION_QUESTIONS))
SQL["session_leads"] = COOKIES + AUTH_EP + (
    ", tg as (select distinct unnest(string_split(f.tags, ',')) as tag from ae) select cast(min(ord) as int) as ord, question from ("
    + " union all ".join(f"select {i} as ord, {q(x)} as question" for i, x in enumerate(rules.ALWAYS_ASKED))
    + f" union all select ord, question from (values {_SQ}) v(ord, tag, question) semi join tg using (tag) union all "
    f"select {len(rules.ALWAYS_ASKED) + len(rules.SESSION_QUESTIONS)}, {q(rules.CSRF_QUESTION)} where exists "
    "(select 1 from co where cookie_type = 'csrf')) group by question")
SQL["auth_summary"] = COOKIES + "".join(
    ", " + part for part in (SECURITY.replace(BASE + ", ", ""), CORS.replace(BASE + ", ", ""), CACHE_OBS.replace(BASE + ", ", ""))) + """
 select 'cookie_observations' as observation_kind, count(*) as observations from co union all
 select 'security_header_observations', count(*) from sh union all select 'cors_observations', count(*) from cors union all
 select 'cache_observations', count(*) from cob where risk_tags <> ''"""

# --- front end ---------------------------------------------------------------------------------------------------------------

_RE2 = {
    "jwt": "\\beyJ[\\w-]{5,}\\.[\\w-]{5,}\\.[\\w-]{5,}\\b", "bearer-token": "(?i)\\bbearer\\s+[A-Za-z0-9._-]{8,}",
}
SECRETS = f"with {LINES}, hit as (" + " union all ".join(
    f"select source_file, line, {q(kind)} as type, {q(cls)} as risk_tags, g as evidence from "
    f"({per_line(_RE2.get(kind, p.replace('(?Udi)', '(?i)').replace('(?Ud)', '')), '0')})"
    for kind, cls, p in rules.SECRET_PATTERNS) + ")"


def _title(kind: str) -> str:
    words = f"list_transform(string_split({kind}, '-'), lambda z: upper(z[1]) || z[2:])"
    return f"array_to_string({words}, ' ')"


def _fe(kind: str, evidence: str = "evidence") -> str:
    return f"'fe-' || substr(sha256(source_file || ':' || {kind} || ':' || cast(line as varchar) || ':' || {evidence}), 1, 12)"


SQL["secret_scan"] = SECRETS + f""" select {_fe('type')} as id, {_title('type')} as title, type,
 case when risk_tags = 'public identifier' then 'info' else 'medium' end as severity,
 case when risk_tags = 'confirmed secret format' then 'high' else 'medium' end as confidence, source_file as asset, source_file, line,
 {redact('trim(evidence)')} as redacted_evidence, risk_tags from hit"""
_INT = rules.INTERNAL_REFERENCE.replace("(?Udi)", "(?i)")
SQL["internal_refs"] = f"""with {LINES}, hit as ({per_line(_INT, '0')})
 select {_fe("'internal-reference'", 'g')} as id, 'Internal Reference' as title, 'internal-reference' as type, 'low' as severity,
 'medium' as confidence, source_file as asset, source_file, line, {redact('trim(g)')} as redacted_evidence,
 'potentially sensitive' as risk_tags from hit"""
_RUN = rules.RUNTIME_CONFIG.replace("(?Udi)", "(?i)")
_CFG = rules.CONFIG_KEY.replace("(?Udi)", "(?i)")
RUNTIME = f"""with {LINES}, rc0 as (select source_file, line, txt, regexp_extract_all(txt, {q(_RUN)}) as ms from lines
 where regexp_matches(txt, {q(_RUN)})),
 rc as (select source_file, line, substr(substr(txt, strpos(txt, ms[1])), 1, 300) as ev from rc0)"""
SQL["runtime_config"] = RUNTIME + f""" select {_fe("'runtime-config'", 'ev')} as id, 'Runtime Config' as title, 'runtime-config' as type,
 'info' as severity, 'medium' as confidence, source_file as asset, source_file, line, {redact('trim(ev)')} as redacted_evidence,
 'needs manual validation' as risk_tags, array_to_string(list_sort(list_distinct(regexp_extract_all(ev, {q(_CFG)}, 1))), ',') as config_keys from rc"""
_ST = rules.STORAGE_CALL.replace("(?Udi)", "(?i)")
_BREAK = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_PLINES = (f"pl0 as (select source_file, suffix, regexp_split_to_array(text, {_BREAK}) as a from SOURCE), "
          "pl1 as (select source_file, case when a[-1] = '' then a[:-2] else a end as a from pl0), "
          "pl as (select source_file, generate_subscripts(a, 1) as n, unnest(a) as txt from pl1)")


def plines(src: str) -> str:
    return _PLINES.replace("SOURCE", src)


STORAGE = "with " + plines(ARTS) + (
    f", st as (select source_file, n as line, txt, unnest(regexp_extract_all(txt, {q(_ST)}, 1)) as storage_type, "
    f"unnest(regexp_extract_all(txt, {q(_ST)}, 2)) as key from pl)")
SQL["storage_refs"] = STORAGE + (
    f" select source_file, line, storage_type, key, case when {rx('key', rules.SENSITIVE_STORAGE_KEY)} then 'sensitive key manual review' "
    f"else 'manual review' end as risk, {redact('trim(txt)')} as redacted_evidence from st")


def near(src: str, sources, sinks) -> str:
    def words(ws):
        return ordered_tags([(w, f"contains(win, {q(w)})") for w in ws], ", ")
    return "with " + plines(src) + f""", wn as (select source_file, n as line, txt,
 string_agg(txt, chr(10)) over (partition by source_file order by n rows between 3 preceding and 3 following) as win from pl),
 nr as (select source_file, line, {words(sources)} as source_pattern, {words(sinks)} as sink_pattern, win from wn
 where {has_any('txt', sinks)} and {has_any('win', sources)})"""


DOM = near(ARTS, rules.DOM_SOURCES, rules.DOM_SINKS)
SQL["dom_leads"] = DOM + f""" select source_file, line, source_pattern, sink_pattern, {redact('win')} as redacted_evidence,
 'A client-controlled source appears near a dynamic DOM/code sink; manually trace data flow.' as review_reason from nr"""
SQL["line_windows"] = near(DOCS, NEAR_SOURCES, NEAR_SINKS) + (
    f" select source_file, line, source_pattern, sink_pattern, length({redact('win')}) as window_length from nr")
SQL["line_table"] = "with " + plines(DOCS) + (
    " select source_file, count(*) as lines, max(n) as last_line, cast(sum(length(txt)) as bigint) as chars from pl group by source_file")
_MARK = has_any("txt", rules.MESSAGE_MARKERS)
MESSAGES = "with " + plines(ARTS) + f""", mw0 as (select source_file, n as line, txt,
 string_agg(txt, chr(10)) over (partition by source_file order by n rows between current row and 11 following) as win from pl),
 mw as (select *, regexp_matches(win, 'event\\.origin|\\.origin\\s*[!=]==?') as chk from mw0 where {_MARK})"""
SQL["message_leads"] = MESSAGES + f""", mr as (select *, {ordered_tags([
    ('no visible origin check', "not chk and contains(txt, 'message')"),
    ('wildcard target origin', rx('win', rules.WILDCARD_TARGET.replace('(?Ud)', ''))),
    ('event.data has no obvious validation', "contains(win, 'event.data') and not regexp_matches(win, '(?i)(typeof|validate|schema|parse)')")],
    '; ')} as reasons from mw) select source_file, line, trim(txt) as pattern, cast(chk as int) as has_origin_check,
 {redact('win')} as redacted_evidence, case when reasons = '' then 'Message handling or sending warrants manual review.' else reasons end
 as review_reason from mr"""


def _sm(kind: str, evidence: str, line: str) -> str:
    return f"'sm-' || substr(sha256(source_file || ':{kind}:' || {evidence} || ':' || {line}), 1, 12)"


REFS = f"with {LINES}, hit as ({per_line('sourceMappingURL[ \\t]*=[ \\t]*[^\\s*]+', '0')})"
SQL["sourcemap_refs"] = REFS + f""" select {_sm('source-map-reference', 'g', 'cast(line as varchar)')} as id, source_file,
 'source-map-reference' as finding_type, regexp_extract(g, '=\\s*([^\\s*]+)', 1) as original_source_path, line,
 {redact('trim(g)')} as redacted_evidence, 'info' as severity from hit"""
_MAPS = """(select 'maps/' || cast(doc_id as varchar) || '.map' as source_file, 0 as idx, 'src/doc' || cast(doc_id as varchar) || '.js' as source,
 text as content, 'sourceRoot=/app; sources=2' as evidence from documents union all
 select 'maps/' || cast(doc_id as varchar) || '.map', 1, 'src/empty.js', '', 'sourceRoot=/app; sources=2' from documents)"""
SQL["source_maps"] = f"select * from {_MAPS}"
SQL["sourcemap_exposure"] = f"""select {_sm('source-map-exposure', 'evidence', "'None'")} as id, source_file,
 'source-map-exposure' as finding_type, source as original_source_path, cast(null as int) as line, evidence as redacted_evidence,
 'info' as severity from {_MAPS}"""
_CM = rules.REVIEW_COMMENT.replace("(?Udi)", "(?i)")
SQL["sourcemap_comments"] = f"""with cl as (select source_file, source, generate_subscripts(ls, 1) as line, unnest(ls) as txt from
 (select source_file, source, string_split(content, chr(10)) as ls from {_MAPS})),
 hit as (select source_file, source, line, unnest(regexp_extract_all(txt, {q(_CM)})) as g from cl)
 select {_sm('sensitive-comment', 'g', 'cast(line as varchar)')} as id, source_file, 'sensitive-comment' as finding_type,
 source as original_source_path, line, {redact('trim(g)')} as redacted_evidence, 'low' as severity from hit"""
SQL["embedded_source_urls"] = f"""with cl as (select source, generate_subscripts(ls, 1) as line, unnest(ls) as txt from
 (select source, string_split(content, chr(10)) as ls from {_MAPS}))
 select source as source_file, min(line) as line, 'UNKNOWN' as method, raw as raw_url from (select source, line,
 unnest(regexp_extract_all(txt, '(?i)(?:https?|wss?)://[^\\s"''<>\\\\)]+')) as raw from cl) group by source, raw"""


def _cte(sql: str) -> str:
    return sql[len("with "):]


SQL["frontend_summary"] = (
    SECRETS + ", " + _cte(RUNTIME).replace(LINES + ", ", "") + ", " + _cte(STORAGE) + ", "
    + _cte(DOM).replace(plines(ARTS) + ", ", "") + ", " + _cte(MESSAGES).replace(plines(ARTS) + ", ", "")
    + ", rf as (" + per_line("sourceMappingURL[ \\t]*=[ \\t]*[^\\s*]+", "0") + ") " + " union all ".join(
        f"select {q(name)} as list_name, count(*) as rows from {src}" for name, src in (
            ("files_analyzed", ARTS), ("secrets", "hit"), ("runtime_configs", "rc"), ("source_maps", "rf"), ("storage_references", "st"),
            ("dom_review_leads", "nr"), ("postmessage_leads", "mw"))))
