"""SQL of the authorization, correlation, scope, quality and source queries."""

from __future__ import annotations

import triage.plans.oracle_terms  # noqa: F401  (fills SQL)
from triage import rules
from triage.operators.correlate import LEAD_SLICES
from triage.plans import derived as D
from triage.plans.oracle import (
    ARTS, BASE, DOCS, EVENTS, MERGED, OBS, PAGES, SCRIPTS, SQL, classes, has_any, host, id12, norm, ordered_tags, path, q, redact, rx, scheme,
)
from triage.plans.oracle_reviews import AUTH_EP

# --- authorization --------------------------------------------------------------------------------------

_KEYS = "actor_id, object_id, endpoint_template_id"
_RID = "actor_id || '|' || object_id || '|' || endpoint_template_id"
AUTHZ = f"""with ex0 as (select {_KEYS}, arg_max({{'expected_result': expected_result, 'boundary_type': boundary_type}},
 {{'a': o1, 'b': o2, 'c': expected_result || reason}}) as f from {D.staged_sql('lineitem', D.EXPECTED)} group by all),
 expd as (select {_KEYS}, {id12('expect', _RID)} as id, f.expected_result as expected_result, f.boundary_type as boundary_type from ex0),
 ob0 as (select {_KEYS}, arg_max({{'observed_result': observed_result, 'evidence_reference': evidence_reference}},
 {{'a': o1, 'b': o2, 'c': observed_result || evidence_reference}}) as f
 from {D.staged_sql('lineitem', D.OBSERVED)} group by all),
 obsd as (select {_KEYS}, f.observed_result as seen, f.evidence_reference as ref from ob0),
 objs as (select * from {D.staged_sql('orders', D.OBJECTS)}), acts as (select * from {D.staged_sql('customer', D.ACTORS)}),
 tpls as (select * from {D.staged_sql('(select distinct l_linenumber as n from lineitem)', D.TEMPLATES)}),
 cmp as (select e.id as expected_rule_id, {', '.join('e.' + k.strip() for k in _KEYS.split(','))}, boundary_type, expected_result,
 coalesce(seen, 'not_tested') as observed_result, coalesce(seen not in ('not_tested', 'unknown') and ((expected_result = 'deny' and seen = 'allowed')
 or (expected_result = 'allow' and seen <> 'allowed') or (expected_result = 'unknown' and seen = 'allowed')), false) as mm,
 coalesce(ref, '') as evidence_reference from expd e left join obsd using ({_KEYS}))"""
SQL["authz_compare"] = AUTHZ + (f" select expected_rule_id, {_KEYS}, boundary_type, expected_result, observed_result, cast(mm as int) as mismatch, "
                                "evidence_reference from cmp")
_CHG = "(tag = 'state-changing' or method in ('POST', 'PUT', 'PATCH', 'DELETE'))"
SQL["authz_findings"] = AUTHZ + f""", jn as (select c.*, o.display_name, o.sensitivity, t.method, t.tag, expected_result = 'deny' and observed_result = 'allowed' as un
 from cmp c join objs o on o.id = c.object_id join tpls t on t.id = c.endpoint_template_id where mm)
 select {id12('authz-finding', "expected_rule_id || '|' || observed_result")} as id, 'Authorization mismatch for ' || display_name as title,
 case when not un then 'needs_manual_review' when {_CHG} then 'state_changing_authz_failure' when boundary_type = 'tenant' then 'cross_tenant_access'
 when boundary_type = 'organization' then 'cross_org_access' when boundary_type = 'role' then 'broken_role_authorization' when method = 'GET' then 'idor'
 else 'bola' end as finding_type, case when not un then 'info' when {_CHG} or boundary_type in ('tenant', 'organization') then 'high'
 when boundary_type = 'role' then 'medium' when sensitivity = 'high' then 'high' else 'medium' end as severity,
 case when evidence_reference <> '' then 'high' else 'medium' end as confidence, {_KEYS}, expected_result, observed_result, evidence_reference,
 'Manual observations differ from the documented authorization expectation; validate scope, ownership, and returned or changed data.' as impact,
 'Enforce server-side authorization for role, tenant, organization, and object ownership before returning data or applying changes.' as recommendation
 from jn"""
SQL["authz_orphans"] = AUTHZ + " " + " union all ".join(
    f"select id, '{kind}' as kind, {key} as missing_id from expd where {key} not in (select id from {dim})"
    for kind, key, dim in (("actor", "actor_id", "acts"), ("object", "object_id", "objs"), ("endpoint", "endpoint_template_id", "tpls")))
_BQ = ", ".join(f"({q(k)}, {q(x)})" for k, qs in rules.BOUNDARY_QUESTIONS.items() for x in qs)
SQL["authz_checklist"] = AUTHZ + (
    f" select category, '' as endpoint_id, question from (values {_BQ}) v(category, question) where category in (select boundary_type from expd)"
    f" union all select 'state-changing', id, unnest([{', '.join(q(x) for x in rules.STATE_CHANGE_QUESTIONS)}]) from tpls where {_CHG}"
    f" union all select 'admin', id, unnest([{', '.join(q(x) for x in rules.ADMIN_QUESTIONS)}]) from tpls where tag = 'admin'")
_HI = " or ".join(f"list_contains(string_split(risk_tags, ','), {q(t)})" for t in rules.HIGH_INTEREST_TAGS)
SQL["authz_templates"] = OBS + MERGED + f""", hi as (select *, {norm('normalized_path')} as np from m where {_HI}),
 atp as (select method, np, arg_min({{'path_template': normalized_path, 'risk_tags': risk_tags, 'oc': object_id_candidates, 'source_endpoint_id': endpoint_id,
 'source_file': f.source_file}}, {{'a': host, 'b': normalized_path, 'c': endpoint_id}}) as g from hi group by method, np)
 select {id12('authz-ep', "method || '|' || np")} as id, method, g.path_template as path_template, np as normalized_path, g.risk_tags as risk_tags,
 case when g.oc <> '' then g.oc else array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(g.path_template, '/\\{{[^/]*\\}}'),
 lambda z: z[3:-2]))), ',') end as object_id_candidates, g.source_endpoint_id as source_endpoint_id, g.source_file as source_file from atp"""

# --- correlation ----------------------------------------------------------------------------------------------

_ITEM = D.staged_sql(EVENTS, D.ITEM_STAGES)
_WS = D.staged_sql("documents", D.WORKSPACE)
_SEV = "(" + ", ".join(q(s) for s in rules.SEVERITIES) + ")"
_CONF = "(" + ", ".join(q(s) for s in rules.CONFIDENCES) + ")"
_SIGTAGS = "[" + ", ".join(q(t) for t in rules.ENDPOINT_SIGNAL_TAGS) + "]"
ITEMS = f"""with it0 as (select *, list_filter([tag1, tag2], lambda z: z is not null) as tags from {_ITEM} union all by name
 select 'workspace:' || id as artifact_id, 'evidence_workspace' as artifact_type, 'evidence_workspace' as source_module, 'workspaces' as list_name,
 cast(0 as bigint) as item_pos, id as item_id, asset, title, case when status = 'ready' and impact <> '' and doc_id % 8 <> 0 and rationale <> ''
 then 'evidence-ready' else 'evidence-gap' end as item_type, cast(null as varchar) as severity, 'medium' as confidence, cast([] as varchar[]) as tags from {_WS}),
 eps as (select artifact_id, item_id as endpoint_id, arg_max({{'url': url, 'method': method}}, item_pos) as ep from it0
 where artifact_type = 'graphql_inventory' and list_name = 'endpoints' group by all),
 it1 as (select it0.* exclude (url, method), case when artifact_type = 'graphql_inventory' and list_name <> 'endpoints' then coalesce(ep.url, '') else url end
 as url, case when artifact_type = 'graphql_inventory' and list_name <> 'endpoints' then ep.method else method end as method
 from it0 left join eps using (artifact_id, endpoint_id)),
 it2 as (select *, coalesce(nullif(url, ''), nullif(asset, ''), nullif(path, ''), '') as v, upper(coalesce(method, 'UNKNOWN')) as am from it1),
 it3 as (select *, {host('v')} as ah, coalesce(nullif({path('v')}, ''), nullif(path, ''), v) as ap from it2),
 it4 as (select *, case when ap = '' then '' else {norm('ap')} end as an from it3),
 it as (select *, case when ap = '' then '' else {id12('asset', "ah || '|' || an || '|' || am")} end as asset_id from it4),
 sg0 as (select *, unnest(case artifact_type when 'endpoint_inventory' then list_filter(tags, lambda z: list_contains({_SIGTAGS}, z))
 when 'frontend_inventory' then [coalesce(nullif(item_type, ''), list_name)]
 when 'auth_surface_inventory' then case when len(tags) > 0 then tags else [regexp_replace(list_name, '_observations$', '')] end
 when 'graphql_inventory' then case when list_name = 'endpoints' then [] when len(tags) > 0 then tags else ['graphql-manual-review'] end
 when 'authz_matrix' then [case when (contains(lower(expected), 'deny') and contains(lower(observed), 'allow')) or coalesce(mismatch, false)
 then 'authz-mismatch' else 'authz-review' end] when 'evidence_workspace' then [item_type] else [coalesce(nullif(item_type, ''), 'har-review')] end) as signal_type from it),
 sg1 as (select *, case artifact_type when 'endpoint_inventory' then 'Endpoint tagged ' || signal_type
 when 'frontend_inventory' then coalesce(title, 'Frontend ' || signal_type) when 'auth_surface_inventory' then coalesce(title, 'Auth surface: ' || signal_type)
 when 'graphql_inventory' then coalesce(title, name, 'GraphQL ' || signal_type) when 'authz_matrix' then coalesce(title, 'Authorization matrix observation')
 when 'evidence_workspace' then title else coalesce(title, 'HAR/finding review') end as stitle from sg0),
 sg as (select {id12('signal', "artifact_id || '|' || signal_type || '|' || coalesce(item_id, stitle)")} as signal_id, signal_type, stitle as title, source_module,
 artifact_id as source_artifact_id, asset_id, case when lower(severity) in {_SEV} then lower(severity) else 'info' end as severity,
 case when lower(confidence) in {_CONF} then lower(confidence) else 'medium' end as confidence,
 case when len(tags) > 0 then list_sort(list_distinct(tags)) else [signal_type] end as tags, coalesce({redact('evidence')}, '') as redacted_evidence from sg1)"""
SQL["triage_signals"] = ITEMS + " select * exclude (tags), array_to_string(tags, ',') as tags from sg"


def _has(*names: str) -> str:
    return "(" + " or ".join(f"list_contains(al, {q(n)})" for n in names) + ")"


_W = "case severity " + " ".join(f"when '{s}' then {w}" for s, w in rules.SEVERITY_WEIGHTS.items()) + " end"
_R = "case severity " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(rules.SEVERITIES)) + " end"
_NOISE = f"(n = 1 and {_has(*rules.NOISE_TAGS)})"
PROJECT = ITEMS + f""", ass as (select asset_id, count(*) as items, arg_min({{'asset_type': case when artifact_type = 'graphql_inventory' and list_name = 'endpoints'
 then 'graphql_endpoint' else 'endpoint' end, 'host': ah, 'path': ap, 'method': am, 'normalized_path': an}}, {{'a': artifact_id, 'b': list_name, 'c': item_pos}}) as f
 from it where asset_id <> '' group by asset_id),
 st0 as (select asset_id, count(*) as n, max({_W}) as w, max({_R}) as r, list_distinct(flatten(list(tags || [signal_type]))) as al,
 max(case when redacted_evidence <> '' then 1 else 0 end) as shown, bit_xor(cast('0x' || substr(sha256(signal_id), 1, 15) as bigint)) as dig from sg group by asset_id),
 st as (select *, greatest(0, least(100, w + least(20, (n - 1) * 5) + case when {_has('authz-mismatch')} then 20 else 0 end
 + case when {_has('state-changing', 'sensitive-data', 'sensitive-fields')} then 10 else 0 end + case when {_has('cross-tenant', 'cross-org')} then 12 else 0 end
 + case when {_has('evidence-ready')} then 12 else 0 end - case when {_has('evidence-gap')} then 10 else 0 end)) as raw from st0),
 sa as (select asset_id, f.asset_type as asset_type, f.host as host, f.path as path, f.method as method, f.normalized_path as normalized_path, items,
 cast(coalesce(raw, 0) as int) as risk_score from ass left join st using (asset_id)),
 ld0 as (select *, case when {_NOISE} then least(raw, 14) else raw end as sc from ass join st using (asset_id)),
 ld1 as (select *, case when sc >= 90 then 'critical' when sc >= 70 then 'high' when sc >= 40 then 'medium' when sc >= 15 then 'low' else 'informational' end as pr from ld0),
 leads as (select {id12('lead', "asset_id || '|' || cast(n as varchar) || '|' || cast(dig as varchar)")} as lead_id,
 'Manual review: ' || f.method || ' ' || f.host || f.normalized_path as title, case when {_NOISE} then 'likely_noise'
 when {_has('authz-mismatch')} and {_has('idor-candidate')} then 'idor_bola' when f.asset_type = 'graphql_endpoint' and
 {_has('object-id-variable', 'sensitive-fields', 'state-changing')} then 'graphql_authorization_review' when contains(array_to_string(al, ' '), 'source-map')
 then 'source_map_review' when {_has('cookie', 'missing-httponly', 'missing-secure')} then 'session_cookie_review' when {_has('evidence-ready')}
 then 'report_ready_candidate' else 'needs_manual_review' end as category, asset_id as affected_asset_id, pr as priority,
 case pr when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end as priority_rank,
 case when n >= 3 then 'high' else 'medium' end as confidence, ['info', 'low', 'medium', 'high', 'critical'][r + 1] as severity_estimate,
 n as signal_count, cast(sc as int) as score, cast(n as varchar) ||
 ' passive signal(s) correlate to this asset; classification remains conservative until manual validation.' as reason,
 case when {_has('evidence-ready')} then 'report_ready' when {_NOISE} then 'likely_noise' when shown = 0 then 'needs_more_evidence'
 else 'needs_manual_validation' end as reportability from ld1)"""
SQL["triage_assets"] = PROJECT + " select * from sa"
SQL["triage_leads"] = PROJECT + " select * from leads"
SQL["triage_top_leads"] = PROJECT + " select lead_id, title, priority, score from leads order by priority_rank desc, lead_id limit 10"
SQL["triage_top_assets"] = PROJECT + " select * from sa order by risk_score desc, asset_id limit 10"
_REL = ("case artifact_type when 'endpoint_inventory' then 'endpoint' when 'frontend_inventory' then 'frontend_finding' when 'auth_surface_inventory' then "
        "'auth_observation' when 'graphql_inventory' then 'graphql_operation' when 'authz_matrix' then 'authz_finding' when 'evidence_workspace' then "
        "'evidence_workspace' end")
SQL["triage_asset_links"] = ITEMS + f""", lk as (select asset_id, {_REL} as relation, item_id as ref_id from it where not (artifact_type = 'graphql_inventory'
 and list_name = 'endpoints') and {_REL} is not null union all select asset_id, 'artifact', artifact_id from it union all
 select asset_id, 'source_module', source_module from it union all select asset_id, 'tag', unnest(tags) from it)
 select distinct asset_id, relation, ref_id from lk where asset_id <> '' and ref_id is not null and ref_id <> ''"""


def _slice(spec) -> str:
    tests = [f"category in ({', '.join(q(c) for c in spec['categories'])})"] if "categories" in spec else []
    if "category_contains" in spec:
        tests.append(f"contains(category, {q(spec['category_contains'])})")
    if "reportabilities" in spec:
        tests.append(f"reportability in ({', '.join(q(c) for c in spec['reportabilities'])})")
    return " and ".join(tests)


SQL["triage_lead_slices"] = PROJECT + " " + " union all ".join(
    f"select {q(name)} as slice, lead_id, title from leads where {_slice(spec)}" for name, spec in LEAD_SLICES.items())
SQL["triage_summary"] = PROJECT + """ select 'artifacts' as metric, count(distinct artifact_id) as value from it union all select 'assets', count(*) from ass union all
 select 'signals', count(*) from sg union all select 'triage_leads', count(*) from leads union all
 select 'report_ready', count(*) from leads where reportability = 'report_ready' union all
 select 'high_priority_leads', count(*) from leads where priority in ('critical', 'high') union all
 select 'needs_more_evidence', count(*) from leads where reportability = 'needs_more_evidence' union all
 select 'evidence_workspaces_ready', count(*) from sg where signal_type = 'evidence-ready'"""
_SHOWN = "(redacted_evidence <> '' or signal_type = 'evidence-ready')"
SQL["triage_lead_signals"] = PROJECT + (
    f" select lead_id, signal_id, source_artifact_id, cast({_SHOWN} as int) as is_evidence from sg join leads on sg.asset_id = leads.affected_asset_id")
SQL["triage_lead_detail"] = PROJECT + f""", evd as (select distinct asset_id, source_artifact_id from sg where {_SHOWN})
 select lead_id, l.title as title, category, sa.method || ' ' || sa.host || sa.path as affected_asset, e.source_artifact_id as artifact_id,
 e.source_artifact_id || '.json' as artifact_path from leads l join sa on sa.asset_id = l.affected_asset_id left join evd e on e.asset_id = l.affected_asset_id"""
_SAVED = f"(select 'saved/' || ids || '.json' as source_file, '.json' as suffix, k, ids, {D.SAVED} as text from {EVENTS})"
SQL["artifact_dedupe"] = f"select sha256(text) as sha256, max(source_file) as source_file from {_SAVED} group by all"

# --- scope -------------------------------------------------------------------------------------------------------

_RULES = [  # (kind, rule, condition), out rules first
    ("out", "spam-farm.example.org", "h = 'spam-farm.example.org'"),
    ("out", "*.example.com/fr/*", "regexp_matches(h || lp, '(?s)^.*\\.example\\.com/fr/.*$')"),
    ("out", "https://blog.*/", "h = 'blog.*' and lp = '/'"), ("out", "/en/9??", "regexp_matches(lp, '(?s)^/en/9..$')"),
    ("in", "*.example.com", "ends_with(h, '.example.com') and h <> '.example.com'"), ("in", "*.example.net", "ends_with(h, '.example.net') and h <> '.example.net'"),
    ("in", "https://thther.example.org/en/*", "h = 'thther.example.org' and regexp_matches(lp, '(?s)^/en/.*$')"),
    ("in", "app.example.test", "h = 'app.example.test'")]
_SC = BASE + ", sc as (select source_file, entry_idx, url, h, lower(p) as lp, scheme in ('http', 'https') and h <> '' as ok from ex)"
_PICK = "case when not ok then '' " + " ".join(f"when {c} then {q(k + '|' + r)}" for k, r, c in _RULES) + " else '' end"
SQL["scope_decide"] = _SC + f""", pk as (select *, {_PICK} as m from sc) select source_file, entry_idx, url, cast(starts_with(m, 'in|') as int) as allowed,
 case when not ok then 'Invalid URL; an explicit http:// or https:// URL is required.' when starts_with(m, 'out|') then
 'Target matches an explicit out-of-scope rule.' when starts_with(m, 'in|') then 'Target matches an in-scope rule.'
 else 'Target does not match any in-scope rule.' end as reason, case when m = '' then '' else substr(m, strpos(m, '|') + 1) end as matched_rule from pk"""
SQL["scope_matches"] = _SC + " " + " union all ".join(
    f"select source_file, entry_idx, {q(k)} as kind, {q(r)} as rule from sc where ok and {c}" for k, r, c in _RULES)

# Every distinct target against every rule, each rule read by its form.
_POLICY = _SC + f""", tg as (select distinct h, lp from sc where ok),
 ru as (select case when p_partkey % 5 < 2 then 'out' else 'in' end as kind, p_partkey as ord, {D.POLICY_RULE} as rule from part),
 rn as (select *, rtrim(lower(trim(rule)), '.') as t from ru),
 rp as (select *, contains(t, '://') as u, case when contains(t, '://') then regexp_extract(t, '^[a-z]+://([^/]*)', 1) else t end as rh,
  case when contains(t, '://') then coalesce(nullif(regexp_extract(t, '^[a-z]+://[^/]*(/.*)$', 1), ''), '/') end as rpath from rn),
 hit as (select tg.*, kind, ord, rule from tg join rp on
  case when u then (case when starts_with(rh, '*.') then ends_with(h, rh[2:]) else h = rh end) and lp glob rpath
       when starts_with(t, '/') then lp glob t when contains(t, '/') then (h || lp) glob t
       when starts_with(t, '*.') then ends_with(h, t[2:]) else h = t end)"""
SQL["scope_policy_matches"] = _POLICY + " select kind, ord, rule, count(*) as urls from sc join hit using (h, lp) where ok group by all"
SQL["scope_policy_decide"] = _POLICY + """, fst as (select h, lp, first(kind order by kind desc, ord) as kind, first(rule order by kind desc, ord) as rule
  from hit group by h, lp) select source_file, entry_idx, url, cast(ok and coalesce(kind = 'in', false) as int) as allowed,
 case when not ok then 'Invalid URL; an explicit http:// or https:// URL is required.' when kind = 'out' then
 'Target matches an explicit out-of-scope rule.' when kind = 'in' then 'Target matches an in-scope rule.'
 else 'Target does not match any in-scope rule.' end as reason, case when ok then coalesce(rule, '') else '' end as matched_rule
 from sc left join fst using (h, lp)"""

# --- quality ---------------------------------------------------------------------------------------------------------

_PRES = f"""with ws as (select *, title || ' ' || impact || ' ' || rationale || ' Denied Allowed' as body, 'e1' as eid from {_WS}),
 wl as (select *, {redact('text')} <> text as leak, contains(lower(text), 'cookie') as ck, contains(lower(text), 'bearer') or contains(lower(text), 'eyj') as tk from ws)"""


def _warn(cond: str, cat: str, message: str, rec: str, field: str, sev: str = "low") -> str:
    wid = f"'quality-' || substr(sha256('{cat}:{field}:' || {q(message)}), 1, 12)"
    return (f"select id, {wid} as warning_id, '{cat}' as category, '{sev}' as severity, {q(message)} as message, {q(rec)} as recommendation, "
            f"'{field}' as field from wl where {cond}")


_VAGUE = "title = 'Bug'"
_WEAK = "(?i)(^|[^\\pL\\pN_])(maybe|might|could be|i think|seems like|potentially critical|maybe vulnerable|should be critical|probably)($|[^\\pL\\pN_])"
_UNRED = "Evidence item e1 may contain unredacted sensitive data."
_USE = "Use the redacted evidence text and review before sharing."
SQL["lint_workspaces"] = _PRES + " " + " union all ".join([
    _warn("impact = '' or trim(impact) = ''", "missing_impact", "Impact is missing.", "Describe concrete user or business impact.", "impact"),
    _warn("asset is null", "missing_affected_asset", "No affected asset is listed.", "Add the exact in-scope asset.", "affected_assets"),
    _warn("doc_id % 8 = 0", "missing_reproduction_steps", "No reproduction steps are present.", "Add ordered, minimal manual steps.", "reproduction_steps"),
    _warn("trim(remediation) = ''", "no_remediation", "No remediation guidance is present.", "Add concise remediation guidance.", "remediation"),
    _warn("true", "no_scope_notes", "No scope notes are present.", "Document authorization and relevant program constraints.", "scope_notes"),
    _warn("rationale = ''", "unsupported_severity", "Severity has no rationale.", "Tie severity to demonstrated impact and evidence.", "severity_rationale"),
    _warn(_VAGUE, "vague_title", "Title may be too vague.", "Name the actor, action, object, and consequence.", "title"),
    _warn(rx("body", _WEAK), "weak_language", "Report uses uncertain or speculative wording.", "Replace speculation with observed, bounded facts.", "report_text"),
    _warn("severity in ('high', 'critical') and (impact = '' or " + has_any("lower(body)", rules.UNSUPPORTED_KINDS) + ")", "unsupported_severity",
          "High/critical severity is not supported by the current impact and proof.", "Lower the estimate or add concrete evidence and impact.",
          "severity_estimate", "medium"),
    _warn("true", "needs_manual_validation", "Automated linting cannot validate scope, exploitability, or severity.",
          "Manually review all evidence and claims before submission.", "workspace", "info"),
    _warn("leak and ck", "unredacted_cookie", _UNRED, _USE, "evidence_items", "medium"), _warn("leak and tk", "unredacted_token", _UNRED, _USE, "evidence_items", "medium"),
    _warn("leak and not ck and not tk", "unredacted_secret", _UNRED, _USE, "evidence_items", "medium"),
    _warn(rx("text", "(^|[^\\pL\\pN_])[\\pL\\pN_][\\pL\\pN_.%+-]*@[\\pL\\pN_.-]+\\.[A-Za-z]{2,}($|[^\\pL\\pN_])"), "pii_exposure", "Evidence item e1 may contain PII.",
          "Redact personal data unless strictly necessary and authorized.", "evidence_items", "medium")])
_FND = f"(select * from {_ITEM} where artifact_type in ('finding', 'har_report'))"
SQL["lint_findings"] = (f"select item_id as id, 'Finding has no evidence.' as warning from {_FND} where evidence is null union all "
                        f"select item_id, 'Finding has no impact statement.' from {_FND} where title is null")
_BODY = ("title || chr(10) || 'idor' || chr(10) || 'Allowed' || chr(10) || impact || chr(10) || 'Denied' || chr(10) || 'Allowed' || chr(10) || '- Evidence: ' || chr(10) || "
         "remediation || chr(10) || 'Evidence is locally organized and requires manual validation.' || chr(10) || rationale || chr(10) || coalesce(asset, '')")
_DRAFTS = f"""with dr as (select *, 'submission-' || cast(doc_id as varchar) as did, {_BODY} as dbody from {_WS}), dl as (select *, {classes('dbody')} as leaks from dr)"""
_LINT = [
    ("blocking", "Missing affected asset.", "asset is null"), ("blocking", "Missing impact.", "trim(impact) = ''"),
    ("blocking", "Missing reproduction steps.", "doc_id % 8 = 0"), ("blocking", "Title is vague.", _VAGUE),
    ("blocking", "High/critical severity has no impact.", "severity in ('high', 'critical') and trim(impact) = ''"),
    ("blocking", "Report body may contain unredacted sensitive data.", "len(leaks) > 0"),
    ("blocking", "Referenced attachment does not exist: Evidence", "doc_id % 2 = 1"),
    ("warning", "Report uses weak or speculative language.", rx(
        "(title || ' Allowed ' || impact || ' ')", "(?i)(^|[^\\pL\\pN_])(maybe|might|could be|i think|seems like|probably)($|[^\\pL\\pN_])")),
    ("warning", "Missing remediation.", "trim(remediation) = ''"), ("warning", "No scope notes.", "true"), ("warning", "No severity rationale.", "rationale = ''"),
    ("warning", "Report needs manual validation.", "status <> 'ready'")]
_LINT_ROWS = " union all ".join(f"select did as id, {q(level)} as level, {q(m)} as message from dl where {c}" for level, m, c in _LINT)
SQL["lint_drafts"] = _DRAFTS + (f" {_LINT_ROWS} union all select did, 'redaction', 'Possible unredacted ' || k || ' detected; value suppressed.' from "
                                "(select did, unnest(leaks) as k from dl)")
SQL["draft_status"] = _DRAFTS + (f", ln as ({_LINT_ROWS}) select did as id, case when count(*) filter (where level = 'blocking') > 0 then 'blocked' when count(*) filter "
                                 "(where level = 'warning') > 0 then 'needs_review' else 'ready' end as status from dl left join ln on ln.id = dl.did group by did")
_CHECK = [("scope", 1, "false"), ("secrets", 1, "len(leaks) = 0"), ("tokens", 1, "len(leaks) = 0"), ("reproduction", 1, "doc_id % 8 <> 0"), ("impact", 1, "impact <> ''"),
          ("evidence", 1, "true"), ("severity", 0, "rationale <> ''"), ("behavior", 0, "true"), ("attachments", 1, "doc_id % 2 = 0"), ("screenshots", 1, "false"),
          ("rules", 1, "false"), ("safety", 1, "false"), ("automation", 1, "false"), ("exploit", 1, "true")]
SQL["draft_checklist"] = _DRAFTS + " " + " union all ".join(
    f"select did as id, {q(n)} as category, {b} as blocking, case when {c} then 'pass' else 'warning' end as status from dl" for n, b, c in _CHECK)
_SLUG = "'submission-' || regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SQL["drafts"] = PROJECT + f""" select 'submission-' || cast(doc_id as varchar) as id, title, 'idor' as vulnerability_class, severity as severity_estimate,
 coalesce(asset, '') as affected_assets, 'evidence_workspace' as source_type, case when status = 'ready' then 'ready' else 'needs_review' end as status from {_WS}
 union all select {_SLUG.format('lead_id')}, l.title, category, severity_estimate, trim(sa.method || ' ' || sa.host || sa.path), 'correlation_lead',
 case when reportability = 'report_ready' then 'needs_review' else 'blocked' end from leads l join sa on sa.asset_id = l.affected_asset_id
 union all select {_SLUG.format('item_id')}, coalesce(title, ''), item_type, lower(coalesce(severity, 'info')), coalesce(asset, url), 'finding', 'needs_review' from {_FND}"""

# --- sources -------------------------------------------------------------------------------------------------------------

SQL["har_scan"] = BASE + """ select source_file, entry_idx as capture, cast(0 as bigint) as entry_idx, method, url, status,
 cast((host is not null)::int + (rq_auth is not null)::int + (rq_apikey is not null)::int + (rq_csrf is not null)::int + (rq_cookie is not null)::int
 + (rq_origin is not null)::int as int) as request_headers, cast(1 + (rs_cache is not null)::int + (rs_hsts is not null)::int + (rs_csp is not null)::int
 + (rs_xcto is not null)::int + (rs_acao is not null)::int + (rs_acac is not null)::int + (rs_vary is not null)::int + (rs_acam is not null)::int
 + (sc1 is not null)::int + (sc2 is not null)::int as int) as response_headers, cast(length(request_body) as int) as request_length,
 cast(length(response_body) as int) as response_length, mime_type from ex"""
SQL["har_rejects"] = f"""select source_file || '#' || ids as source_file, case k % 7 when 0 then 'HAR file is empty' when 1 then 'Invalid JSON in HAR file'
 when 2 then 'HAR root must be a JSON object' when 3 then 'HAR must contain a log.entries list' when 4 then 'Every HAR log.entries item must be an object'
 when 5 then 'Every HAR entry must contain request and response objects' else 'HAR response status must be an integer' end as reason from {EVENTS}"""
_KIND = ("case k % 10 when 0 then 'endpoint_inventory' when 1 then 'frontend_inventory' when 2 then 'auth_surface_inventory' when 3 then 'graphql_inventory' "
         "when 4 then 'vocabulary_inventory' when 5 then 'authz_matrix' when 6 then 'evidence_workspace' when 7 then '{7}' when 8 then '{8}' else '{9}' end")
SQL["artifact_types"] = (f"select source_file, {_KIND.replace('{7}', 'finding').replace('{8}', 'har_report').replace('{9}', 'json_report')} as artifact_type "
                         f"from {_SAVED}")
_CK = f"select source_file, {_KIND.replace('{7}', 'json').replace('{8}', 'json').replace('{9}', 'json')} as input_type from {_SAVED}"
SQL["classify_inputs"] = f"""select source_file, input_type, case input_type when 'json' then 'vocabulary' when 'endpoint_inventory' then
 'correlation,vocabulary,authorization' when 'frontend_inventory' then 'correlation,vocabulary' when 'evidence_workspace' then 'correlation,report_quality'
 else 'correlation' end as analyses from ({_CK})
 union all select 'raw/' || ids || '.http', case when i % 2 = 0 then 'raw_request' else 'raw_response' end, 'auth_surface,evidence' from {EVENTS}
 union all select source_file, 'javascript', 'frontend,endpoints,vocabulary' || case when regexp_matches(lower(text), 'graphql|query |mutation ') then ',graphql'
 else '' end from {SCRIPTS} union all select source_file, 'text', 'vocabulary' from {DOCS} union all
 select source_file, 'html', 'frontend,endpoints,vocabulary' from {PAGES} union all
 select 'schema/' || cast(s_suppkey as varchar) || '.graphql', 'graphql', 'vocabulary,graphql' from supplier"""
SQL["content_manifest"] = (f"select source_file as path, cast(strlen(text) as bigint) as size_bytes, sha256(text) as sha256 from (select * from {DOCS} union all "
                           f"select * from {PAGES})")
SQL["evidence_items"] = f"""select source_file as path, regexp_extract(source_file, '[^/]*$') as title, cast(strlen(text) as bigint) as size_bytes, sha256(text) as sha256,
 'Local file (' || cast(strlen(text) as varchar) || ' bytes)' as description, cast({redact('text')} <> text as int) as contains_sensitive_data, '' as not_scanned,
 {redact('text')} as redacted_evidence_text from (select * from {DOCS} union all select * from {SCRIPTS})"""
SQL["scope_rule_table"] = """select 'out' as kind, 0 as ord, 'admin' || cast(s_suppkey as varchar) || '.example.test' as rule from supplier union all
 select 'in', 0, 's' || cast(s_suppkey as varchar) || '.example.test' from supplier union all select 'in', 1, '*.example.test' from supplier"""

SQL["graphql_inputs"] = f"""select source_file, suffix from (select source_file, '.js' as suffix, text from {SCRIPTS}) where regexp_matches(lower(text),
 'graphql|query |mutation ') union all select 'schema/' || cast(s_suppkey as varchar) || '.graphql', '.graphql' from supplier"""
_FOUND = [("secrets", "secret_scan"), ("internal_references", "internal_refs"), ("runtime_configs", "runtime_config"), ("source_maps", "sourcemap_refs"),
          ("storage_references", "storage_refs"), ("dom_review_leads", "dom_leads"), ("postmessage_leads", "message_leads")]
SQL["embedded_findings"] = " union all ".join(
    [f"select '{name}' as analysis, source_file, cast(line as int) as line, redacted_evidence as evidence from ({SQL[query]})" for name, query in _FOUND]
    + [f"select 'endpoints', source_file, cast(line as int), {redact('raw_url')} from ({SQL['text_endpoints']})"])
SQL["auth_endpoints_of_inventories"] = BASE + f""", ae0 as (select source_file, entry_idx as ord, method, url from ex union all
 select 'inventory/' || endpoint_id, 0, method, url from ({SQL['text_endpoint_inventory']})), ae1 as """ + AUTH_EP.split("ae1 as ", 1)[1] + (
    SQL["auth_endpoints"].split(AUTH_EP, 1)[1])
