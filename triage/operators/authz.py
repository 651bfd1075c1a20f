"""Expected against observed access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import key_id
from triage.functions.urls import normalize_path
from triage.operators.endpoints import high_interest

KEYS = ["actor_id", "object_id", "endpoint_template_id"]


def upsert_latest(df: DataFrame, keys: list[str], order) -> DataFrame:
    """The latest row per key, as an aggregate: no group is ever sorted or held whole."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("latest"))
    return latest.select(*keys, "latest.*").select(*df.columns)


def endpoint_templates(endpoints: DataFrame) -> DataFrame:
    """High-interest endpoints as templates, the first per (method, normalized path)."""
    kept = high_interest(endpoints)
    given = F.when(F.col("normalized_path") != "", F.col("normalized_path")).otherwise(F.col("path"))
    rows = kept.select(F.upper("method").alias("method"), given.alias("path_template"),
                       normalize_path(given).alias("normalized_path"), "risk_tags", "object_id_candidates",
                       F.col("endpoint_id").alias("source_endpoint_id"), "source_file", "host")
    payload = ["path_template", "risk_tags", "object_id_candidates", "source_endpoint_id", "source_file"]
    first = rows.groupBy("method", "normalized_path").agg(
        F.min_by(F.struct(*payload), F.struct("host", "path_template", "source_endpoint_id")).alias("f"))
    slots = F.regexp_extract_all("f.path_template", F.lit(r"(?<=/|^)\{([^/]*)\}(?=/|$)"), F.lit(1))
    ids = F.when(F.size("f.object_id_candidates") > 0, F.col("f.object_id_candidates")).otherwise(
        F.array_sort(F.array_distinct(slots)))
    return first.select(
        key_id("authz-ep", F.col("method"), F.col("normalized_path")).alias("id"), "method", "f.path_template",
        "normalized_path", F.array_sort(F.array_distinct("f.risk_tags")).alias("risk_tags"),
        ids.alias("object_id_candidates"), "f.source_endpoint_id", "f.source_file")


def orphans(rules_df: DataFrame, actors: DataFrame, objects: DataFrame, templates: DataFrame) -> DataFrame:
    """Rules naming an unknown actor, object or endpoint: (id, kind, missing_id)."""
    parts = []
    for kind, key, dim in (("actor", "actor_id", actors), ("object", "object_id", objects),
                           ("endpoint", "endpoint_template_id", templates)):
        known = dim.select(F.col("id").alias(key))
        parts.append(rules_df.join(known, key, "left_anti")
                     .select("id", F.lit(kind).alias("kind"), F.col(key).alias("missing_id")))
    return reduce(DataFrame.unionByName, parts)


def is_mismatch(expected: Column, observed: Column) -> Column:
    judged = observed.isNotNull() & ~observed.isin("not_tested", "unknown")
    allowed = observed == "allowed"
    return F.coalesce(judged & (((expected == "deny") & allowed) | ((expected == "allow") & ~allowed)
                                | ((expected == "unknown") & allowed)), F.lit(False))


def compare(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Every expectation with its observation, or ``not_tested``.

    Both sides are unique per key after the upsert, so the join has no hot key.
    """
    seen = observed.select(*KEYS, F.col("observed_result").alias("seen"), F.col("evidence_reference").alias("ref"))
    joined = expected.join(seen, KEYS, "left")
    return joined.select(
        F.col("id").alias("expected_rule_id"), *KEYS, "boundary_type", "expected_result",
        F.coalesce("seen", F.lit("not_tested")).alias("observed_result"),
        is_mismatch(F.col("expected_result"), F.col("seen")).alias("mismatch"),
        F.coalesce("ref", F.lit("")).alias("evidence_reference"))


def authz_findings(compared: DataFrame, objects: DataFrame, templates: DataFrame) -> DataFrame:
    """Candidate findings from the mismatches, with class and severity.

    Only mismatches reach the joins; which side is broadcast is left to the
    planner and its size limit.
    """
    c = F.col
    rows = (compared.filter("mismatch")
            .join(objects.select(c("id").alias("object_id"), "display_name", "sensitivity"), "object_id")
            .join(templates.select(c("id").alias("endpoint_template_id"), "method", "risk_tags"),
                  "endpoint_template_id"))
    unauthorized = (c("expected_result") == "deny") & (c("observed_result") == "allowed")
    state_change = F.array_contains("risk_tags", "state-changing") | c("method").isin(rules.STATE_CHANGING_METHODS)

    def by_case(review, state, tenant, organization, role, otherwise):
        return (F.when(~unauthorized, review).when(state_change, state)
                .when(c("boundary_type") == "tenant", tenant).when(c("boundary_type") == "organization", organization)
                .when(c("boundary_type") == "role", role).otherwise(otherwise))

    kind = by_case("needs_manual_review", "state_changing_authz_failure", "cross_tenant_access", "cross_org_access",
                   "broken_role_authorization", F.when(c("method") == "GET", "idor").otherwise("bola"))
    severity = by_case("info", "high", "high", "high", "medium",
                       F.when(c("sensitivity") == "high", "high").otherwise("medium"))
    return rows.select(
        key_id("authz-finding", c("expected_rule_id"), c("observed_result")).alias("id"),
        F.concat(F.lit("Authorization mismatch for "), "display_name").alias("title"), kind.alias("finding_type"),
        severity.alias("severity"), F.when(c("evidence_reference") != "", "high").otherwise("medium").alias("confidence"),
        *KEYS, "expected_result", "observed_result", "evidence_reference",
        F.lit("Manual observations differ from the documented authorization expectation; validate scope, ownership, "
              "and returned or changed data.").alias("impact"),
        F.lit("Enforce server-side authorization for role, tenant, organization, and object ownership before "
              "returning data or applying changes.").alias("recommendation"))


def authz_checklist(expected: DataFrame, templates: DataFrame) -> DataFrame:
    """Review questions per boundary in use and per state-changing or admin template."""
    b = F.col("boundary_type")
    per_boundary = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(q).alias("question"))
                             for k, qs in rules.BOUNDARY_QUESTIONS.items() for q in qs])
    boundaries = (expected.select("boundary_type").distinct()
                  .select(F.inline(F.filter(per_boundary, lambda x: x["category"] == b)))
                  .select("category", F.lit("").alias("endpoint_id"), "question"))

    def asked(category, questions):
        return F.array(*[F.struct(F.lit(category).alias("category"), F.lit(q).alias("question")) for q in questions])

    none = F.array().cast("array<struct<category:string,question:string>>")
    changing = F.array_contains("risk_tags", "state-changing") | F.col("method").isin(rules.STATE_CHANGING_METHODS)
    rows = F.concat(F.when(changing, asked("state-changing", rules.STATE_CHANGE_QUESTIONS)).otherwise(none),
                    F.when(F.array_contains("risk_tags", "admin"), asked("admin", rules.ADMIN_QUESTIONS)).otherwise(none))
    per_template = templates.select(F.col("id").alias("endpoint_id"), F.inline(rows))
    return boundaries.unionByName(per_template.select("category", "endpoint_id", "question"))
