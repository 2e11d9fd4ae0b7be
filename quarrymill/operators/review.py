"""Findings of reviews, final status, citation audit and stored drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FINDINGS, citation_labels, exploded, strip_citation_tags


def _list(df: DataFrame, name: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.col(name), none) if name in df.columns else none


def all_findings(reviews: DataFrame, by: str = "draft_id") -> DataFrame:
    """(by, findings): the lists of all kinds in their fixed order."""
    return reviews.select(by, F.concat(*[_list(reviews, f) for f in FINDINGS]).alias("findings"))


def findings_by_kind(reviews: DataFrame, by: str = "draft_id") -> DataFrame:
    kinds = [f for f in FINDINGS if f in reviews.columns]
    rows = reviews.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), F.size(_list(reviews, f)).cast("long").alias("n")) for f in kinds])).alias("k"))
    return rows.select(by, "k.kind", "k.n").where("n > 0")


def final_status(verdict: Column, corrected: Column, re_verdict: Column, re_findings: Column) -> Column:
    """What a draft comes to: a fixable one is fixed only by a correction whose own review is ok and finds nothing. An unknown verdict counts as fixable."""
    unfixed = corrected.isNull() | re_verdict.isNull() | (re_verdict != "ok") | (F.coalesce(re_findings, F.lit(0)) > 0)
    return F.when(verdict.isNull() | (verdict == "ok"), "ok").when((verdict == "unverifiable") | unfixed, "needs_review").otherwise("fixable")


def workflow_status(re_verdict: Column) -> Column:
    """Approved only by a second review that is ok: a draft that is ok at once still waits."""
    return F.when(re_verdict == "ok", "approved").otherwise("pending_review")


def ships(status: Column, draft: Column, re_verdict: Column) -> Column:
    unproven = (status == "fixable") & ~F.coalesce(re_verdict == "ok", F.lit(False))
    return status.isin("ok", "fixable") & draft.isNotNull() & ~unproven


def citation_audit(bodies: DataFrame, evidence: DataFrame, by: str = "draft_id") -> dict[str, DataFrame]:
    """bodies (by, body), evidence (by, label) -> cited (by, label, n), dangling (cited, not in the evidence), uncited (in the evidence, never cited)."""
    cited = exploded(bodies, [by], citation_labels(F.col("body")), "place", "label").groupBy(by, "label").agg(F.count("*").alias("n"))
    known = evidence.select(by, "label").distinct()
    return {"cited": cited, "dangling": cited.join(known, [by, "label"], "left_anti"), "uncited": known.join(cited, [by, "label"], "left_anti")}


def drafts_listing(drafts: DataFrame, user: int | None = None, final_status: str | None = None, limit: int | None = None, template: tuple[int, int] | None = None, by_template: bool = False) -> DataFrame:
    """Drafts of a user, with a status, or made from a template (document, version), newest first.

    Without any of them each user's drafts with their rank, or with by_template those of each template version; drafts without a template are then
    left out.
    """
    newest = [F.desc("generated_at"), "draft_id"]
    asked = [F.col(c) == v for c, v in (("user_id", user), ("final_status", final_status)) if v is not None]
    if template is not None:
        asked += [F.col("template_document_id") == template[0], F.col("template_version") == template[1]]
    if asked:
        for one in asked:
            drafts = drafts.where(one)
        out = drafts.orderBy(*newest)
    else:
        keys = ["template_document_id", "template_version"] if by_template else ["user_id"]
        rows = drafts.where("template_document_id is not null") if by_template else drafts
        out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return out.limit(limit) if limit else out


def persist_draft_rows(drafts: DataFrame, reviews: DataFrame, chunks_used: DataFrame, default_title: str = "Draft") -> DataFrame:
    """One row to store for each draft.

    drafts (draft_id, title, body, template_document_id, template_file_id, template_version, template_used), reviews (draft_id, verdict, summary,
    findings, corrected, re_verdict, re_summary, re_findings), chunks_used (draft_id, chunks_used). The second review's verdict and findings
    stand where there is one.
    """
    rows = drafts.join(reviews, "draft_id", "left").join(chunks_used, "draft_id", "left")
    n = F.size(F.coalesce("re_findings", F.array().cast("array<string>")))
    status = final_status(F.col("verdict"), F.col("corrected"), F.col("re_verdict"), n)
    again = F.col("re_verdict").isNotNull()
    body = F.when(status == "fixable", F.col("corrected")).otherwise(F.col("body"))
    used = F.coalesce("template_used", F.lit(False))
    return rows.select(
        "draft_id",
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(default_title)).alias("title"),
        body.alias("body"),
        strip_citation_tags(body).alias("clean_body"),
        F.coalesce("chunks_used", F.array()).alias("chunks_used"),
        status.alias("final_status"),
        workflow_status(F.col("re_verdict")).alias("status"),
        (status == "needs_review").alias("needs_review"),
        *[F.when(used, F.col(c)).alias(c) for c in ("template_document_id", "template_file_id", "template_version")],
        F.when(again, F.col("re_verdict")).otherwise(F.col("verdict")).alias("compliance_verdict"),
        F.when(again, F.col("re_summary")).otherwise(F.col("summary")).alias("compliance_summary"),
        F.when(again, F.col("re_findings")).otherwise(F.col("findings")).alias("compliance_unverified"),
    )
