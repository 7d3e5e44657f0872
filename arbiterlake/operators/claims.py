"""Claim extraction, entailment labels and citation verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import string_values
from ..functions.text import claims_of_text, clean, content_tokens, has_any, source_ids
from ..functions.values import rate


@dataclass(frozen=True)
class Markers:
    """Language pack of the claim rules; every list is literal text to look for."""

    reviewable: Sequence[str] = field(default=())
    exempt: Sequence[str] = field(default=())
    conditional: Sequence[str] = field(default=())
    limiting: Sequence[str] = field(default=())
    asserting: Sequence[str] = field(default=())
    denying: Sequence[str] = field(default=())


#: Fixed actions of the labels.
PRODUCT_ACTIONS = {
    "supported": "pass_citation_gate", "partially_supported": "human_review_or_revision", "unsupported": "badcase_and_regression", "contradicted": "release_blocker",
    "no_citation": "human_review_and_prompt_fix", "out_of_scope_source": "source_boundary_regression", "fabricated_citation": "release_blocker_and_badcase",
}


def split_claims(outputs: DataFrame, text_col: str = "output_text") -> DataFrame:
    """One row per claim with its place from 1; a JSON answer is split value by value. All columns stay as they came."""
    text = F.coalesce(F.array_join(string_values(F.col(text_col)), "\n"), F.col(text_col))
    return outputs.select("*", F.posexplode(claims_of_text(text)).alias("_pos", "claim")).withColumn("claim_index", F.col("_pos") + 1).drop("_pos")


def reviewable(claim: Column, markers: Markers) -> Column:
    return ~has_any(claim, markers.exempt) & has_any(claim, markers.reviewable)


def contradicts(claim: Column, source: Column, markers: Markers) -> Column:
    return ~has_any(claim, markers.limiting) & has_any(claim, markers.asserting) & has_any(source, markers.denying)


def entailment(claims: DataFrame, sources: DataFrame, markers: Markers, allowed: DataFrame | None = None) -> DataFrame:
    """Label every claim against the sources of its run.

    ``claims``: ``run_id``, ``claim_index``, ``claim``. ``sources``: ``run_id``, ``source_id``, ``text``.
    ``allowed`` (optional): ``run_id``, ``allowed_source_ids``. The sources of one run are few, a retrieval's
    top k, and meet its claims as one array.
    """
    bundle = sources.filter(clean("source_id") != "").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(clean("source_id").alias("id"), content_tokens(F.col("text")).alias("words"), has_any(clean("text"), markers.denying).alias("denies")))).alias("_sources")
    ).withColumn("_every", F.array_distinct(F.flatten(F.transform("_sources", lambda s: s["words"]))))  # once a run; no text travels with the claims
    base = claims.join(bundle, "run_id", "left").withColumns({
        "_sources": F.coalesce("_sources", F.array().cast("array<struct<id:string,words:array<string>,denies:boolean>>")), "_every": F.coalesce("_every", F.array().cast("array<string>")),
    })
    base = base.join(allowed, "run_id", "left") if allowed is not None else base.withColumn("allowed_source_ids", F.array().cast("array<string>"))
    base = base.withColumns({
        "_words": content_tokens(F.col("claim")), "cited_source_ids": source_ids(F.col("claim")), "_ids": F.transform("_sources", lambda s: s["id"]),
        "allowed_source_ids": F.coalesce("allowed_source_ids", F.array().cast("array<string>")), "reviewable": reviewable(F.col("claim"), markers),
    }).withColumns({
        "fabricated_source_ids": F.array_except("cited_source_ids", "_ids"),
        "out_of_scope_source_ids": F.when(F.size("allowed_source_ids") > 0, F.array_except("cited_source_ids", "allowed_source_ids")).otherwise(F.array().cast("array<string>")),
        "_checked": F.filter("_sources", lambda s: (F.size("cited_source_ids") == 0) | F.array_contains("cited_source_ids", s["id"])),
    })
    words = F.col("_words")
    score = lambda w: F.when((F.size(words) == 0) | (F.size(w) == 0), 0.0).otherwise(rate(F.size(F.array_intersect(words, w)), F.size(words), 3))
    scored = F.transform("_checked", lambda s: F.struct(score(s["words"]).alias("score"), s["id"].alias("id"), s["denies"].alias("denies")))
    top = F.aggregate(scored, F.lit(None).cast("struct<score:double,id:string,denies:boolean>"), lambda a, s: F.when(a.isNull() | (s["score"] > a["score"]), s).otherwise(a))
    together = F.array_distinct(F.flatten(F.transform("_checked", lambda s: s["words"])))
    cited = F.size("cited_source_ids") > 0
    base = base.withColumns({"_top": top, "_all": score(F.col("_every")), "_together": F.when(cited, score(together)).otherwise(0.0)})
    single = F.coalesce(F.col("_top")["score"], F.col("_all"))
    best = F.greatest(single, F.col("_together"), F.when(cited, 0.0).otherwise(F.col("_all")))
    combined = (F.col("_together") > single) & (F.size("_checked") > 1) & cited
    base = base.withColumns({
        "single_source_support_score": single, "combined_cited_support_score": F.col("_together"), "support_score": best,
        "best_source_id": F.when(combined, "COMBINED_CITED_SOURCES").otherwise(F.coalesce(F.col("_top")["id"], F.lit(""))),
        "_contradicted": ~combined & F.col("_top").isNotNull() & ~has_any(F.col("claim"), markers.limiting) & has_any(F.col("claim"), markers.asserting) & F.col("_top")["denies"],
    })
    label = (
        F.when(F.size("fabricated_source_ids") > 0, "fabricated_citation").when(F.size("out_of_scope_source_ids") > 0, "out_of_scope_source")
        .when(~F.col("reviewable"), "not_reviewable").when(~cited, "no_citation").when(F.col("_contradicted"), "contradicted")
        .when(F.col("support_score") >= 0.45, "supported").when(F.col("support_score") >= 0.25, "partially_supported")
        .when(has_any(F.col("claim"), markers.conditional) & (F.col("support_score") >= 0.12), "partially_supported").otherwise("unsupported")
    )
    actions = F.create_map(*(x for k, v in PRODUCT_ACTIONS.items() for x in (F.lit(k), F.lit(v))))
    made = base.withColumn("entailment_label", label).withColumn("product_action", F.coalesce(F.try_element_at(actions, F.col("entailment_label")), F.lit("not_applicable")))
    shown = F.format_string("%.3f", "support_score")
    reason = (
        F.when(F.col("entailment_label") == "fabricated_citation", "cited sources are not in the provided or retrieved context")
        .when(F.col("entailment_label") == "out_of_scope_source", "cited sources are outside the allowed boundary")
        .when(F.col("entailment_label") == "no_citation", "reviewable claim without citation").when(F.col("entailment_label") == "contradicted", "source limits or contradicts the claim")
        .when(F.col("entailment_label") == "not_reviewable", "not a reviewable statement").otherwise(F.concat(F.lit("lexical support "), shown))
    )
    return made.withColumn("entailment_reason", reason).withColumnRenamed("reviewable", "reviewable_legal_claim").drop(*(c for c in made.columns if c.startswith("_")))


def simple_claim_check(open_: Column, cited: Column, available: Column, score: Column, threshold: float = 0.35) -> Column:
    """Label of the plain check by citation and lexical support."""
    has = F.size(cited) > 0
    return (
        F.when(F.size(F.array_except(cited, available)) > 0, "fabricated_citation").when(~open_, "risk_control_or_nonlegal_statement")
        .when(score >= threshold, "supported").when(has, "weak_or_unsupported_cited_claim").otherwise("uncited_or_unsupported_claim")
    )


def citation_label(cited: Column, retrieved: Column, unsupported: Column, requires: Column) -> Column:
    """Citation fidelity of one output."""
    return (
        F.when(F.size(F.array_except(cited, retrieved)) > 0, "fabricated_citation").when(unsupported > 0, "unsupported_claim").when(requires & (F.size(cited) == 0), "missing_citation")
        .when(F.size(F.array_intersect(cited, retrieved)) > 0, "citation_supported").otherwise("no_citation_required")
    )


#: The report gate's rules in order: reason, decision.
REPORT_GATE = {
    "source_boundary_or_claim_support_blocker": "blocked",
    "claim_support_needs_review_rate_above_threshold": "limited_release",
    "majority_of_runs_require_human_review": "limited_release",
    "score_and_claim_support_thresholds_met": "candidate_auto_answer",
    "insufficient_evidence_for_auto_answer": "limited_release",
}


def report_gate(blockers: Column, issue_rate: Column, review_rate: Column, score: Column) -> tuple[Column, Column]:
    """Decision and reason of the retrieval report; its thresholds differ from the release gate's."""
    names = list(REPORT_GATE)
    reason = (
        F.when(blockers > 0, names[0]).when(issue_rate > 0.25, names[1]).when(review_rate > 0.5, names[2])
        .when((score >= 0.8) & (issue_rate <= 0.1), names[3]).otherwise(names[4])
    )
    decisions = F.create_map(*(x for k, v in REPORT_GATE.items() for x in (F.lit(k), F.lit(v))))
    return F.element_at(decisions, reason), reason
