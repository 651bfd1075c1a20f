"""Quality checks over tables of workspaces, findings and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import rules
from triage.functions.tags import contains_any, present
from triage.functions.text import contains_sensitive, redact, redaction_classes, slug, strip


def _blank(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit(""))) == ""


def _empty(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) == 0


def _vague(title: Column) -> Column:
    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    return F.lower(strip(title)).isin(rules.VAGUE_TITLES) | (F.size(words) < 3)


def _warning(category: str, message, recommendation: str, field: str, severity: str = "low") -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    ident = F.concat(F.lit("quality-"), F.substring(F.sha2(F.concat_ws(
        ":", F.lit(category), F.lit(field), message), 256), 1, 12))
    return F.struct(ident.alias("warning_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                    message.alias("message"), F.lit(recommendation).alias("recommendation"), F.lit(field).alias("field"))


def lint_workspaces(workspaces: DataFrame) -> DataFrame:
    """Warnings per evidence workspace: missing parts, weak wording, unredacted or personal data."""
    c = F.col
    text = F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in (
        "title", "impact", "severity_rationale", "expected_behavior", "actual_behavior")])
    severe = c("severity_estimate").isin("high", "critical")
    unsupported = contains_any(F.lower(c("report_text")), rules.UNSUPPORTED_KINDS)
    fixed = [
        (_blank("impact"), _warning("missing_impact", "Impact is missing.",
                                    "Describe concrete user or business impact.", "impact")),
        (_empty("affected_assets"), _warning("missing_affected_asset", "No affected asset is listed.",
                                             "Add the exact in-scope asset.", "affected_assets")),
        (_empty("reproduction_steps"), _warning("missing_reproduction_steps", "No reproduction steps are present.",
                                                "Add ordered, minimal manual steps.", "reproduction_steps")),
        (_empty("evidence_items"), _warning("missing_evidence", "No evidence is attached.",
                                            "Attach redacted proof or a local evidence reference.", "evidence_items")),
        (_blank("expected_behavior") | _blank("actual_behavior"), _warning(
            "missing_expected_actual", "Expected or actual behavior is missing.",
            "State both expected and observed behavior.", "expected_behavior")),
        (_blank("remediation"), _warning("no_remediation", "No remediation guidance is present.",
                                         "Add concise remediation guidance.", "remediation")),
        (_blank("scope_notes"), _warning("no_scope_notes", "No scope notes are present.",
                                         "Document authorization and relevant program constraints.", "scope_notes")),
        (_blank("severity_rationale"), _warning("unsupported_severity", "Severity has no rationale.",
                                                "Tie severity to demonstrated impact and evidence.",
                                                "severity_rationale")),
        (_vague(c("title")), _warning("vague_title", "Title may be too vague.",
                                      "Name the actor, action, object, and consequence.", "title")),
        (c("report_text").rlike(rules.WEAK_WORDING), _warning(
            "weak_language", "Report uses uncertain or speculative wording.",
            "Replace speculation with observed, bounded facts.", "report_text")),
        (severe & ((F.coalesce("impact", F.lit("")) == "") | _empty("evidence_items") | unsupported), _warning(
            "unsupported_severity", "High/critical severity is not supported by the current impact and proof.",
            "Lower the estimate or add concrete evidence and impact.", "severity_estimate", "medium")),
        (F.lit(True), _warning("needs_manual_validation",
                               "Automated linting cannot validate scope, exploitability, or severity.",
                               "Manually review all evidence and claims before submission.", "workspace", "info"))]

    def per_item(item):
        raw = F.coalesce(F.when(item["evidence_text"] != "", item["evidence_text"]), item["redacted_evidence_text"],
                         F.lit(""))
        low = F.lower(raw)
        leaking = contains_sensitive(raw)
        cookie, token = low.contains("cookie"), low.contains("bearer") | low.contains("eyj")
        note = F.concat(F.lit("Evidence item "), item["id"], F.lit(" may contain unredacted sensitive data."))
        warn = lambda cat: _warning(cat, note, "Use the redacted evidence text and review before sharing.",
                                    "evidence_items", "medium")
        return F.array(
            F.when(leaking & cookie, warn("unredacted_cookie")), F.when(leaking & token, warn("unredacted_token")),
            F.when(leaking & ~cookie & ~token, warn("unredacted_secret")),
            F.when(raw.rlike(rules.PII_EMAIL), _warning(
                "pii_exposure", F.concat(F.lit("Evidence item "), item["id"], F.lit(" may contain PII.")),
                "Redact personal data unless strictly necessary and authorized.", "evidence_items", "medium")))

    found = F.array_compact(F.concat(F.array(*[F.when(cond, w) for cond, w in fixed]),
                                     F.flatten(F.transform("evidence_items", per_item))))
    return workspaces.withColumn("report_text", text).select("id", F.inline(found))


def lint_findings(findings: DataFrame) -> DataFrame:
    """Findings without evidence or without an impact statement."""
    notes = present((_blank("evidence") & _blank("redacted_evidence"), "Finding has no evidence."),
                    (_blank("impact"), "Finding has no impact statement."))
    return findings.select("id", F.explode(notes).alias("warning"))


_DRAFT_TEXT = ["title", "vulnerability_class", "summary", "impact", "expected_behavior", "actual_behavior",
               "evidence_summary", "remediation", "limitations", "reporter_notes", "scope_notes", "severity_rationale"]


def _draft_body() -> Column:
    listed = [F.array_join(F.coalesce(n, F.array().cast("array<string>")), "\n")
              for n in ("affected_assets", "steps_to_reproduce")]
    return F.concat_ws("\n", *[F.coalesce(F.col(n), F.lit("")) for n in _DRAFT_TEXT], *listed)


def missing_attachments(drafts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, title) of attachments whose path is not in the manifest."""
    wanted = drafts.select("id", F.inline("attachments"))
    return wanted.join(manifest.select("path").distinct(), "path", "left_anti").select("id", "title")


def lint_drafts(drafts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, level, message): blocking items, redaction findings and warnings of each draft."""
    c = F.col
    severe = c("severity_estimate").isin("high", "critical")
    leaks = F.col("leaks")
    row = lambda level, text: F.struct(F.lit(level).alias("level"), (
        text if isinstance(text, Column) else F.lit(text)).alias("message"))
    wording = F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in ("title", "summary", "impact", "reporter_notes")])
    checks = [
        (_empty("affected_assets"), "blocking", "Missing affected asset."),
        (_blank("impact"), "blocking", "Missing impact."),
        (_empty("steps_to_reproduce"), "blocking", "Missing reproduction steps."),
        (_blank("evidence_summary"), "blocking", "Missing evidence for the claim."),
        (_vague(c("title")), "blocking", "Title is vague."),
        (severe & _blank("evidence_summary"), "blocking", "High/critical severity has no evidence."),
        (severe & _blank("impact"), "blocking", "High/critical severity has no impact."),
        (F.size(leaks) > 0, "blocking", "Report body may contain unredacted sensitive data."),
        (wording.rlike(rules.WEAK_DRAFT_WORDING), "warning", "Report uses weak or speculative language."),
        (_blank("remediation"), "warning", "Missing remediation."),
        (_blank("expected_behavior") | _blank("actual_behavior"), "warning", "Missing expected or actual behavior."),
        (_blank("scope_notes"), "warning", "No scope notes."),
        (_blank("severity_rationale"), "warning", "No severity rationale."),
        (c("severity_estimate") == "info", "warning", "Report appears informational."),
        (c("status") != "ready", "warning", "Report needs manual validation.")]
    found = F.array_compact(F.concat(
        F.array(*[F.when(cond, row(level, text)) for cond, level, text in checks]),
        F.transform(leaks, lambda k: row("redaction", F.concat(
            F.lit("Possible unredacted "), k, F.lit(" detected; value suppressed."))))))
    own = drafts.withColumn("leaks", redaction_classes(_draft_body())).select("id", F.inline(found))
    lost = missing_attachments(drafts, manifest).select("id", F.lit("blocking").alias("level"), F.concat(
        F.lit("Referenced attachment does not exist: "), "title").alias("message"))
    return own.unionByName(lost).distinct()


def draft_status(drafts: DataFrame, lint: DataFrame) -> DataFrame:
    """Status of each draft after the lint: blocked, needs_review or ready."""
    level = lint.groupBy("id").agg(F.count_if(F.col("level") == "blocking").alias("blocking"),
                                   F.count_if(F.col("level") == "warning").alias("warnings"))
    return drafts.select("id").join(level, "id", "left").select(
        "id", F.when(F.col("blocking") > 0, "blocked").when(F.col("warnings") > 0, "needs_review").otherwise("ready")
        .alias("status"))


def _draft(df: DataFrame, **columns) -> DataFrame:
    blank, no_list = F.lit(""), F.array().cast("array<string>")
    attachments = F.array().cast("array<struct<title:string,path:string>>")
    defaults = {n: blank for n in ("vulnerability_class", "severity_estimate", "confidence", *_DRAFT_TEXT[2:], "source_type",
                                   "status")}
    defaults |= {"affected_assets": no_list, "steps_to_reproduce": no_list, "attachments": attachments}
    order = ["id", "title", "vulnerability_class", "severity_estimate", "confidence", "affected_assets", "summary",
             "impact", "steps_to_reproduce", "expected_behavior", "actual_behavior", "evidence_summary", "remediation",
             "limitations", "reporter_notes", "scope_notes", "severity_rationale", "source_type", "attachments", "status"]
    return df.select(*[(columns[n] if n in columns else defaults[n]).alias(n) for n in order])


def drafts_from_workspaces(workspaces: DataFrame) -> DataFrame:
    c = F.col
    label = lambda e: F.coalesce(F.when(e["title"] != "", e["title"]), e["id"])
    shown = F.transform("evidence_items", lambda e: F.concat(F.lit("- "), label(e), F.lit(": "), redact(F.coalesce(
        F.when(e["redacted_evidence_text"] != "", e["redacted_evidence_text"]), e["description"], F.lit("")))))
    files = F.filter("evidence_items", lambda e: F.coalesce(e["path"], F.lit("")) != "")
    return _draft(
        workspaces, id=F.concat(F.lit("submission-"), slug(c("title"))), title=c("title"),
        vulnerability_class=c("finding_type"), severity_estimate=c("severity_estimate"), confidence=c("confidence"),
        affected_assets=c("affected_assets"), summary=c("actual_behavior"), impact=c("impact"),
        steps_to_reproduce=F.transform("reproduction_steps", lambda s: s["action"]),
        expected_behavior=c("expected_behavior"), actual_behavior=c("actual_behavior"),
        evidence_summary=F.array_join(shown, "\n"), remediation=c("remediation"),
        limitations=F.lit("Evidence is locally organized and requires manual validation."),
        scope_notes=c("scope_notes"), severity_rationale=c("severity_rationale"),
        source_type=F.lit("evidence_workspace"),
        attachments=F.transform(files, lambda e: F.struct(label(e).alias("title"), e["path"].alias("path"))),
        status=F.when(c("status") == "ready", "ready").otherwise("needs_review"))


def drafts_from_leads(leads: DataFrame, assets: DataFrame) -> DataFrame:
    located = assets.select(F.col("asset_id").alias("affected_asset_id"), F.trim(F.concat(
        "method", F.lit(" "), "host", "path")).alias("where"))
    df = leads.join(located, "affected_asset_id", "left")
    c = F.col
    return _draft(
        df, id=F.concat(F.lit("submission-"), slug(c("lead_id"))), title=c("title"), vulnerability_class=c("category"),
        severity_estimate=c("severity_estimate"), confidence=c("confidence"), affected_assets=F.array_compact(F.array("where")),
        summary=c("reason"), steps_to_reproduce=c("manual_validation_steps"),
        reporter_notes=F.array_join("suggested_evidence_to_collect", "\n"),
        limitations=F.lit("Correlator leads are hypotheses until manually validated."),
        source_type=F.lit("correlation_lead"),
        status=F.when(c("reportability") == "report_ready", "needs_review").otherwise("blocked"))


def drafts_from_findings(findings: DataFrame) -> DataFrame:
    c = F.col
    shown = F.coalesce(F.when(c("redacted_evidence") != "", c("redacted_evidence")), redact(c("evidence")))
    return _draft(
        findings, id=F.concat(F.lit("submission-"), slug(c("id"))), title=c("title"), vulnerability_class=c("type"),
        severity_estimate=c("severity"), confidence=c("confidence"), affected_assets=F.array("asset"), summary=shown,
        impact=c("impact"), evidence_summary=shown, remediation=c("recommendation"),
        limitations=F.lit("Imported finding requires manual reproduction-step review."),
        source_type=F.lit("finding"), status=F.lit("needs_review"))


def draft_checklist(drafts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fourteen submission items per draft, passed or to be confirmed by hand."""
    lost = missing_attachments(drafts, manifest).select("id").distinct().withColumn("lost", F.lit(True))
    df = drafts.withColumn("clean", F.size(redaction_classes(_draft_body())) == 0).join(lost, "id", "left")
    filled = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    no, yes = F.lit(False), F.lit(True)
    specs = [
        ("scope", "Asset is in scope.", True, no),
        ("secrets", "Report does not include real credentials.", True, F.col("clean")),
        ("tokens", "Report does not include raw cookies/tokens.", True, F.col("clean")),
        ("reproduction", "Steps are reproducible.", True, ~_empty("steps_to_reproduce")),
        ("impact", "Impact is clear.", True, filled("impact")),
        ("evidence", "Evidence supports the claim.", True, filled("evidence_summary")),
        ("severity", "Severity is justified.", False, filled("severity_rationale")),
        ("behavior", "Expected and actual behavior are clear.", False,
         filled("expected_behavior") & filled("actual_behavior")),
        ("attachments", "Attachments exist.", True, F.col("lost").isNull()),
        ("screenshots", "Sensitive screenshots are redacted.", True, no),
        ("rules", "Program rules were reviewed manually.", True, no),
        ("safety", "No destructive testing was performed.", True, no),
        ("automation", "No prohibited automation was used.", True, no),
        ("exploit", "No live exploit automation is included.", True, yes)]
    items = F.array(*[F.struct(
        F.lit(category).alias("category"), F.lit(text).alias("text"), F.lit(blocking).alias("blocking"),
        F.when(ok, "pass").otherwise("warning").alias("status"),
        F.when(ok, "Confirmed from the local draft; still review manually.")
        .otherwise("Manually confirm this item before submission.").alias("recommendation"))
        for category, text, blocking, ok in specs])
    return df.select("id", F.inline(items))


