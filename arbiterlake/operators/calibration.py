"""Human-review sampling, calibration figures and agreement statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, filled
from ..functions.values import error_tags, overlaps, parse_bool, rate, tag_names
from ..sources.scratch import materialize
from .routing import canonical_routing, with_defaults

#: Fixed words of the review sheet.
CRITICAL = ("fabricated_citation", "unsafe_action_suggestion", "needs_human_review")
CITATION_ISSUES = ("fabricated_citation", "missing_citation", "unsupported_claim")
STRATA = ("task_category", "model_alias", "workflow_condition", "risk_level")
REVIEW_COLUMNS = (
    "human_pass_fail", "human_corrected_score_rate", "human_critical_failure", "human_citation_support", "human_unsupported_claims", "human_route_override", "human_notes",
)
AGREE = ("agree", "agreed", "agree_prelim", "yes", "true", "1", "一致")
CONFIRMED = ("yes", "yes_prelim", "true", "1", "confirmed", "是", "有")
UNSUPPORTED = (
    "unsupported", "unsupported_fabricated_citation", "unsupported_needs_legal_review", "partial_support_needs_legal_review", "missing_citation_needs_review",
    "no", "false", "0", "不支持", "引用不支持",
)
NO_OVERRIDE = ("no_override", "none", "keep", "不调整")


def is_critical() -> Column:
    names = tag_names(error_tags(F.col("error_tags").cast("string"), strict=False))
    return (clean("risk_level") == "high") | (clean("judge_confidence") == "low") | parse_bool(F.col("needs_human_review").cast("string")) | overlaps(names, CRITICAL)


def hash_order(key: str, seed: int) -> Column:
    """A reproducible random order that any SHA-256 can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


#: Hexadecimal digits of the hash order that place a row between 0 and 1.
_DIGITS = 12


def stratified(df: DataFrame, n: int, strata: tuple[str, ...], key: str = "run_id", seed: int = 42) -> DataFrame:
    """At most ``n`` rows, an equal share of each stratum in hash order; may give fewer, as small strata do not pass on their share.

    The order is even over its range, so a stratum's size tells below which place its share lies, with room to
    spare. Only rows below it are ranked; strata that come out short, as repeated keys can make them, look
    further until they have their share or all their rows. So no stratum's rows meet in one task, however large it is.
    """
    if n <= 0:
        return df.limit(0)
    strata = tuple(c for c in strata if c in df.columns)
    order = hash_order(key, seed)
    if strata:
        sizes = materialize(df.groupBy(*strata).agg(F.count("*").alias("_size")))
        share = max(1, math.ceil(n / max(1, sizes.count())))
        best = Window.partitionBy(*strata).orderBy(order, key)
        near = _nearest_rows(df, sizes, strata, share, order)
        df = near.withColumn("_no", F.row_number().over(best)).filter(F.col("_no") <= share).drop("_no").dropDuplicates([key])
    return df.orderBy(order, key).limit(n)


def _nearest_rows(df: DataFrame, sizes: DataFrame, strata: tuple[str, ...], share: int, order: Column) -> DataFrame:
    """Rows of every stratum up to some place in the order, ``share`` of them or all at least; written."""
    place = F.conv(F.left(order, F.lit(_DIGITS)), 16, 10).cast("double") / float(16**_DIGITS)
    same = lambda names: [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in names]
    room, wanted = share + 6 * math.sqrt(share) + 20, sizes.select(*(F.col(c).alias(f"_s_{c}") for c in strata), "_size")
    found = None
    while True:
        near = materialize(df.join(wanted, same(strata)).filter(place < F.lit(room) / F.col("_size")))
        counts = near.groupBy(*(f"_s_{c}" for c in strata)).agg(F.count("*").alias("_found"))
        both = wanted.join(counts.select(*(F.col(f"_s_{c}").alias(c) for c in strata), "_found"), same(strata), "left")
        done = F.coalesce("_found", F.lit(0)) >= F.least(F.col("_size"), F.lit(share))
        both = materialize(both.select(*wanted.columns, done.alias("_done")))
        marked = near.join(both.filter("_done").select(*(F.col(f"_s_{c}").alias(f"_d_{c}") for c in strata)), [F.col(f"_s_{c}").eqNullSafe(F.col(f"_d_{c}")) for c in strata], "left_semi").select(*df.columns)
        found = marked if found is None else found.unionByName(marked)
        wanted, room = both.filter("not _done").select(*wanted.columns), room * 16
        if wanted.isEmpty():
            return found


def review_base(scores: DataFrame, routing: DataFrame, citations: DataFrame | None = None, ensemble: DataFrame | None = None) -> DataFrame:
    """Scores with policy and the three reasons for review."""
    scores = with_defaults(scores, judge_confidence="", needs_human_review=None, error_tags=None)
    base = scores.join(canonical_routing(routing).select("run_id", "response_policy", "priority"), "run_id", "left")
    if citations is not None:
        base = base.join(citations.select("run_id", "citation_fidelity_label"), "run_id", "left")
    if ensemble is not None:
        base = base.join(ensemble.select("run_id", "requires_human_calibration"), "run_id", "left")
    base = with_defaults(base, citation_fidelity_label="", requires_human_calibration=False)
    base = base.withColumns({
        "critical_for_review": is_critical(), "citation_or_claim_review": F.coalesce(F.col("citation_fidelity_label").isin(*CITATION_ISSUES), F.lit(False)),
        "ensemble_review": parse_bool(F.col("requires_human_calibration").cast("string")),
    })
    return base.withColumn("legal_review_required", F.col("critical_for_review") | F.col("citation_or_claim_review") | F.col("ensemble_review"))


def review_sample(base: DataFrame, min_samples: int = 20, sample_rate: float = 0.2, random_min: int = 0, seed: int = 42) -> DataFrame:
    """All rows that need review, topped up by a stratified sample to the target and to a floor of random rows."""
    base = materialize(base)  # the target, the strata and both samples read it
    counts = base.agg(F.count("*").alias("n"), F.count_if("legal_review_required").alias("due")).first()
    target = min(counts["n"], max(min_samples, math.ceil(counts["n"] * sample_rate)))
    due, rest = base.filter("legal_review_required"), base.filter("not legal_review_required")
    extra = stratified(rest, max(0, target - counts["due"]), STRATA, seed=seed)
    chosen = due.unionByName(extra)
    if random_min:
        more = rest.join(extra.select("run_id"), "run_id", "left_anti")
        chosen = chosen.unionByName(stratified(more, max(0, random_min - extra.count()), STRATA, seed=seed))
    bucket = (
        F.when(F.col("critical_for_review"), "critical_failure").when(F.col("citation_or_claim_review"), "citation_or_claim")
        .when(F.col("ensemble_review"), "judge_disagreement").otherwise("random_calibration")
    )
    return chosen.withColumns({"review_bucket": bucket, "auto_triage_label": F.col("response_policy")})


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: labelled pairs, observed agreement and Cohen's kappa; null without pairs, kappa 1 if chance agreement is 1.

    Only the contingency table of labels is grouped further.
    """
    cells = df.select(clean(a).alias("a"), clean(b).alias("b")).filter("a <> '' and b <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, left["a"] == right["b"]).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("products"))
    n, same, products = (F.col(c).cast("double") for c in ("pairs", "same", "products"))
    kappa = F.when(F.col("pairs") * F.col("pairs") == F.col("products"), 1.0).otherwise((same * n - products) / (n * n - products))
    return total.crossJoin(chance).select(
        F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("pairs") > 0, same / n).alias("observed_agreement"), F.when(F.col("pairs") > 0, kappa).alias("kappa")
    )


def calibration_summary(reviewed: DataFrame) -> DataFrame:
    """One row of review figures: completion, agreement with the judge, kappa of reviewer pairs, confirmed issues."""
    wanted = (*REVIEW_COLUMNS, "judge_human_agreement", "reviewer_a_triage_label", "reviewer_b_triage_label", "auto_triage_label", "adjudicated_triage_label", "human_data_action")
    reviewed = with_defaults(reviewed, **dict.fromkeys(wanted, ""))
    low = lambda c: F.lower(clean(c))
    done = F.lit(False)
    for c in REVIEW_COLUMNS:
        done = done | filled(c)
    labelled, agreed = low("judge_human_agreement") != "", low("judge_human_agreement").isin(*AGREE)
    both = filled("auto_triage_label") & filled("adjudicated_triage_label")
    override = (low("human_route_override") != "") & ~low("human_route_override").isin(*NO_OVERRIDE)
    n = F.count("*")
    part = lambda x, of: F.when(F.count_if(of) > 0, rate(F.count_if(of & x), F.count_if(of), 3))
    figures = reviewed.agg(
        n.alias("total_review_rows"), F.count_if(done).alias("completed_review_rows"), rate(F.count_if(done), n, 3).alias("review_completion_rate"),
        F.count_if(labelled).alias("agreement_labeled_rows"), part(agreed, labelled).alias("judge_human_agreement_rate"),
        F.count_if(both).alias("judge_adjudicated_labeled_rows"), part(clean("auto_triage_label") == clean("adjudicated_triage_label"), both).alias("judge_adjudicated_agreement_rate"),
        F.count_if(low("human_critical_failure").isin(*CONFIRMED)).alias("confirmed_critical_failure_count"), F.count_if(low("human_citation_support").isin(*UNSUPPORTED)).alias("confirmed_citation_issue_count"),
        F.count_if(override).alias("human_route_override_count"), F.count_if(filled("human_data_action")).alias("human_data_action_count"),
    )
    pairs = agreement(reviewed, "reviewer_a_triage_label", "reviewer_b_triage_label").select(
        F.col("pairs").alias("reviewer_pair_labeled_rows"), F.round("observed_agreement", 3).alias("reviewer_observed_agreement_rate"), F.round("kappa", 3).alias("reviewer_cohen_kappa")
    )
    return figures.crossJoin(pairs)


def in_sheet_order(sample: DataFrame) -> DataFrame:
    """The review sheet's rows: reasons for review first, then task, risk, sample, model and version."""
    reasons = ("legal_review_required", "critical_for_review", "citation_or_claim_review", "ensemble_review")
    return sample.orderBy(*map(F.desc, reasons), "task_category", "risk_level", "sample_id", "model_alias", "version")
