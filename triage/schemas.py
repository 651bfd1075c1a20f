"""Row types of the engine."""

from pyspark.sql.types import StructType

PAIRS = "array<struct<name:string,value:string>>"
EXCHANGE = (
    "source_file string, entry_idx bigint, method string, url string, status int, "
    f"request_headers {PAIRS}, response_headers {PAIRS}, query_string {PAIRS}, request_cookies {PAIRS}, "
    "response_cookies array<struct<name:string,value:string,path:string,secure:boolean,httpOnly:boolean,"
    f"sameSite:string>>, request_body string, form_params {PAIRS}, mime_type string, response_body string"
)
ARTIFACT = "source_file string, suffix string, text string"
SCOPE_RULE = "kind string, ord int, rule string"
ENDPOINT = (
    "id string, method string, scheme string, host string, path string, normalized_path string, url string, "
    "query_params array<string>, body_params array<string>, json_keys array<string>, header_names array<string>, "
    "status_codes array<int>, mime_types array<string>, auth_indicators array<string>, "
    "object_id_candidates array<string>, risk_tags array<string>, occurrences bigint"
)
# One row of a saved inventory list, as correlation reads it.
INVENTORY_ITEM = (
    "artifact_id string, artifact_type string, source_module string, list_name string, item_pos bigint, "
    "item_id string, url string, asset string, path string, method string, title string, name string, "
    "item_type string, severity string, confidence string, risk_tags array<string>, evidence string, "
    "endpoint_id string, expected string, observed string, mismatch boolean"
)
ACTOR = "id string, name string, role string, organization string, tenant string"
AUTHZ_OBJECT = (
    "id string, object_type string, display_name string, owner_actor_id string, organization string, "
    "tenant string, identifiers map<string,string>, sensitivity string"
)
ENDPOINT_TEMPLATE = (
    "id string, method string, path_template string, normalized_path string, risk_tags array<string>, "
    "object_id_candidates array<string>"
)
EXPECTED_ACCESS = (
    "id string, actor_id string, object_id string, endpoint_template_id string, expected_result string, "
    "reason string, boundary_type string"
)
OBSERVED_RESULT = (
    "id string, actor_id string, object_id string, endpoint_template_id string, observed_result string, "
    "status_code int, evidence_reference string, notes string"
)
WORKSPACE = (
    "id string, title string, finding_type string, affected_assets array<string>, severity_estimate string, "
    "confidence string, status string, tags array<string>, scope_notes string, expected_behavior string, "
    "actual_behavior string, impact string, severity_rationale string, remediation string, "
    "reproduction_steps array<struct<id:string,ord:int,action:string,expected_result:string,actual_result:string>>, "
    "evidence_items array<struct<id:string,type:string,title:string,path:string,sha256:string,"
    "evidence_text:string,redacted_evidence_text:string,description:string>>, quality_warnings array<string>"
)
FINDING = (
    "id string, title string, type string, severity string, confidence string, asset string, evidence string, "
    "redacted_evidence string, impact string, recommendation string"
)
DRAFT = (
    "id string, title string, vulnerability_class string, severity_estimate string, confidence string, "
    "affected_assets array<string>, summary string, impact string, steps_to_reproduce array<string>, "
    "expected_behavior string, actual_behavior string, evidence_summary string, remediation string, "
    "limitations string, reporter_notes string, scope_notes string, severity_rationale string, "
    "source_type string, attachments array<struct<title:string,path:string>>, status string"
)
SOURCE_MAP = "sources array<string>, sourcesContent array<string>, sourceRoot string"

INVENTORIES = {
    "exchanges": EXCHANGE,
    "artifacts": ARTIFACT,
    "endpoints": ENDPOINT,
    "inventory_items": INVENTORY_ITEM,
    "actors": ACTOR,
    "objects": AUTHZ_OBJECT,
    "endpoint_templates": ENDPOINT_TEMPLATE,
    "expected_access": EXPECTED_ACCESS,
    "observed_results": OBSERVED_RESULT,
    "workspaces": WORKSPACE,
    "findings": FINDING,
    "drafts": DRAFT,
}


def struct(name: str):
    return StructType.fromDDL(INVENTORIES[name])

#: Bodies and source texts may be as long and as deep as a row can hold; the parser's own limits would lose them without a word.
JSON_LIMITS = {"maxStringLen": "2147483647", "maxNumLen": "2147483647", "maxNestingDepth": "100000"}
