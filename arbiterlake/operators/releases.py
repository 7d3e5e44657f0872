"""Dataset releases: memberships, lineage of expert approvals, adjudication, expert decisions, figures and validation.

Rules that fail give rows of ``subject`` (or ``asset_id``) and ``message`` beside the result; nothing is dropped silently.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import fenced_object
from ..functions.text import clean, completeness_issues, filled
from ..functions.values import POLICIES, rate
from .assets import FINGERPRINTS, REVIEW_FIELDS, assign_split, fingerprints, latest, memberships, release_cohort, reviewer_conflicts, shared_fingerprints

#: Fixed names of the review records.
LINEAGE = ("correction_id", "correction_revision", "source_snapshot_id", "corrected_answer_hash")
ADJUDICATED_FIELDS = ("decision", "response_policy", "legal_conclusion_supported", "critical_facts_covered")
DECISIONS = {"accepted": "approve", "rework_required": "rework", "rejected": "reject"}
BLIND, DISCLOSED, EXPERT_ROLE = "blind-v2", "same_source_bug_reproduction", "legal_phd"
CUT_OFF = ("length", "max_tokens", "max_output_tokens")
CITATION_SUPPORT = ("passed", "failed", "not_applicable")
QUALITY_CHECKS = ("pii_check", "duplicate_check", "source_traceability", "law_effective_date_check", "type_specific_check")


def say(df: DataFrame, checks: Sequence[tuple[Column, Column | str]], subject: str = "asset_id") -> DataFrame:
    """One row of subject and message per row and check that applies; an unknown condition does not apply."""
    made = F.array_compact(F.array(*(F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in checks)))
    return df.select(subject, F.explode(made).alias("message"))


def current_corrections(corrections: DataFrame, candidates: DataFrame) -> DataFrame:
    """The latest correction of every candidate as its four lineage columns, with its text; null if it has none."""
    last = latest(corrections, "asset_id", "revision_number").select(
        "asset_id", "correction_id", F.col("revision_number").alias("correction_revision"), "corrected_answer", F.sha2(F.coalesce("corrected_answer", F.lit("")), 256).alias("corrected_answer_hash")
    )
    return candidates.select("asset_id", "source_snapshot_id").join(last, "asset_id", "left")


def undisclosed_overlaps(split: DataFrame) -> DataFrame:
    """Regression assets that reproduce a training source without saying so."""
    return say(split, [((F.col("split") == "bug_reproduction") & (clean("evaluation_role") != DISCLOSED), "source overlaps training data without disclosure")])


def update_memberships(log: DataFrame, split: DataFrame, release: str) -> tuple[DataFrame, DataFrame]:
    """The membership log after a release, and the new ids that the log holds already.

    An included row of the wanted split stays as it is; an asset without one gets a new row, and its other included
    rows of the release become deprecated. Other releases are not touched.
    """
    keys = ["asset_id", "dataset_release_id"]
    wanted = split.select("asset_id", F.lit(release).alias("dataset_release_id"), "split").distinct()
    held = log.filter("status = 'included'").select(*keys, "split").join(wanted, [*keys, "split"], "left_semi").select(*keys).distinct()
    lacking = wanted.join(held, keys, "left_anti")
    stale = F.col("status").eqNullSafe("included") & F.col("_lacking").isNotNull()
    kept = log.join(lacking.select(*keys, F.lit(True).alias("_lacking")), keys, "left").withColumn("status", F.when(stale, "deprecated").otherwise(F.col("status")))
    new = memberships(lacking, release)
    return kept.select(*new.columns).unionByName(new), new.join(log, "dataset_membership_id", "left_semi").select("dataset_membership_id")


def adjudicate(reviews: DataFrame, current: DataFrame, earlier: DataFrame, fields: Sequence[str] = ADJUDICATED_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Adjudications of assets with a review by both roles, and messages for those without.

    ``reviews`` are current ones (one a role), ``current`` the lineage of ``current_corrections``, ``earlier`` the
    adjudications so far, which number the new ones. Reviewers who agree settle the asset (*not_required*, the decision
    of A); others are open (*adjudication_pending*) and wait for a proposal, see ``propose``.
    """
    decided = reviews.filter("review_role = 'reviewer_a'").select("asset_id", F.col("decision").alias("_decision"))
    before = earlier.groupBy("asset_id").agg(F.count("*").alias("_before"))
    pairs = reviewer_conflicts(reviews, fields).join(decided, "asset_id").join(current, "asset_id").join(before, "asset_id", "left")
    number = (F.coalesce("_before", F.lit(0)) + 1).cast("int")
    agree = F.col("exact_agreement")
    made = pairs.select(
        F.format_string("ADJ-%s-%02d", F.col("asset_id"), number).alias("adjudication_id"), "asset_id", F.when(agree, "not_required").otherwise("adjudication_pending").alias("status"),
        F.col("conflict_fields").alias("conflicts"), F.when(agree, F.col("_decision")).alias("proposed_decision"), *LINEAGE,
    )
    return made, current.join(made, "asset_id", "left_anti").select("asset_id", F.lit("both independent reviews are required").alias("message"))


def propose(open_: DataFrame, answers: DataFrame) -> DataFrame:
    """Open adjudications with the model's proposal; without a decision or reason in its answer, rework and expert review."""
    found = answers.select("asset_id", fenced_object(F.col("answer")).alias("_json"))
    made = open_.drop("proposed_decision").join(found, "asset_id")
    given = lambda k: F.coalesce(F.get_json_object("_json", f"$.{k}"), F.lit(""))
    return made.withColumns({
        "status": F.lit("proposed_adjudication"), "proposed_decision": F.when(given("proposed_decision") == "", "rework").otherwise(given("proposed_decision")),
        "rationale": F.when(given("rationale") == "", "conflict requires expert review").otherwise(given("rationale")),
    }).drop("_json")


Client = Callable[[], Callable[[str], tuple[str, dict]]]


def checked_client(client: Client, issue: Callable[[str, dict], str]) -> Client:
    """A client for ``execution.call_model`` that fails, and so is asked again, where ``issue`` names a fault of its answer."""

    def connect():
        ask = client()

        def once(prompt: str) -> tuple[str, dict]:
            text, usage = ask(prompt)
            if fault := issue(text or "", usage or {}):
                raise ValueError(fault)
            return text, usage

        return once

    return connect


def json_client(client: Client) -> Client:
    """Answers must hold a JSON object."""

    def issue(text: str, _: dict) -> str:
        found = json.loads(text[text.find("{") : text.rfind("}") + 1] or "null")  # a fault of its own if it does not parse
        return "" if isinstance(found, dict) else "the answer holds no JSON object"

    return checked_client(client, issue)


def whole_client(client: Client) -> Client:
    """Answers must have text and must not be reported as cut off."""

    def issue(text: str, usage: dict) -> str:
        reason = str(usage.get("finish_reason") or "").strip().lower()
        return "empty output" if not text.strip() else f"truncated output ({reason})" if reason in CUT_OFF else ""

    return checked_client(client, issue)


def draft_corrections(candidates: DataFrame, earlier: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New revisions of corrections from a model's answers (``asset_id``, ``answer``), and messages for assets whose answer is blank.

    ``candidates``: ``asset_id``, ``asset_type``, ``source_output``. A preference asset with a source output takes the
    answer as chosen and that output as rejected.
    """
    before = earlier.groupBy("asset_id").agg(F.max("revision_number").alias("_last"))
    rows = candidates.select("asset_id", "asset_type", "source_output").join(answers.select("asset_id", clean("answer").alias("corrected_answer")), "asset_id").join(before, "asset_id", "left")
    number = (F.coalesce("_last", F.lit(0)) + 1).cast("int")
    rejected = F.when(F.col("asset_type").eqNullSafe("preference"), F.coalesce("source_output", F.lit(""))).otherwise("")
    made = rows.filter("corrected_answer <> ''").select(
        F.format_string("COR-%s-%02d", F.col("asset_id"), number).alias("correction_id"), "asset_id", number.alias("revision_number"), "corrected_answer",
        F.when(rejected != "", F.col("corrected_answer")).otherwise("").alias("chosen_answer"), rejected.alias("rejected_answer"), F.lit("ai_model").alias("author_type"),
    )
    return made, rows.filter("corrected_answer = ''").select("asset_id", F.lit("empty output").alias("message"))


def bind_approvals(submissions: DataFrame, corrections: DataFrame, reviews: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted assets bound to the correction whose text the expert was sent, and messages for those that cannot be.

    ``submissions``: ``asset_id``, ``seq``, ``expert_decision``, ``corrected_answer``, ``expert_override_reason``,
    ``submission_file``, ``submission_file_sha256``; the last accepted one of an asset counts. Of corrections with the
    same trimmed text the last is bound. The expert event is the last approval with the submission's reason in its findings.
    """
    accepted = candidates.filter("asset_status = 'accepted'").select("asset_id", "source_snapshot_id")
    sent = latest(submissions.filter(clean("expert_decision") == "accepted"), "asset_id", "seq").select(
        "asset_id", F.sha2(clean("corrected_answer"), 256).alias("_text"), clean("expert_override_reason").alias("_reason"), "submission_file", "submission_file_sha256"
    )
    texts = corrections.withColumn("_text", F.sha2(clean("corrected_answer"), 256)).groupBy("asset_id", "_text").agg(F.max_by(F.struct("correction_id", "revision_number", "corrected_answer"), "revision_number").alias("_c"))
    approved = reviews.filter("review_role = 'final_expert' and decision = 'approve'").select("asset_id", "seq", "event_id", F.explode("findings").alias("_reason"))
    events = approved.groupBy("asset_id", "_reason").agg(F.max_by("event_id", "seq").alias("original_review_event_id"))
    rows = accepted.join(sent, "asset_id", "left").join(texts, ["asset_id", "_text"], "left").join(events, ["asset_id", "_reason"], "left")
    wrong = say(rows, [
        (F.col("_text").isNull(), "no accepted expert submission"),
        (F.col("_text").isNotNull() & F.col("_c").isNull(), "submitted text matches no correction"),
        (F.col("_text").isNotNull() & F.col("original_review_event_id").isNull(), "no approval with the submission's reason"),
    ])
    bound = rows.filter("_c is not null and original_review_event_id is not null")
    return bound.select(
        F.format_string("EAB-%s-%02d", F.col("asset_id"), F.col("_c.revision_number").cast("int")).alias("binding_id"), "asset_id", F.col("_c.correction_id").alias("correction_id"),
        F.col("_c.revision_number").alias("correction_revision"), "source_snapshot_id", F.sha2(F.coalesce("_c.corrected_answer", F.lit("")), 256).alias("corrected_answer_hash"),
        F.lit("accepted").alias("expert_decision"), "original_review_event_id", "submission_file", "submission_file_sha256",
    ), wrong


def decision_errors(pending: DataFrame, rows: DataFrame) -> DataFrame:
    """Messages for a returned expert bundle: it must hold every pending asset once, each with a valid row."""
    one = lambda df, text: df.select("asset_id", F.lit(text).alias("message"))
    fields = say(rows, [
        (~clean("expert_decision").isin(*DECISIONS), "invalid or blank expert_decision"), (~filled("expert_override_reason"), "expert_override_reason is required"),
        (~F.lower(clean("expert_override")).isin("yes", "no"), "expert_override must be yes or no"),
        (~F.coalesce(clean("review_elapsed_seconds").try_cast("double") > 0, F.lit(False)), "review_elapsed_seconds must be positive"), (clean("reviewer_role") != EXPERT_ROLE, f"reviewer_role must be {EXPERT_ROLE}"),
    ])
    missing, extra = pending.join(rows, "asset_id", "left_anti"), rows.join(pending, "asset_id", "left_anti")
    twice = rows.groupBy("asset_id").count().filter("count > 1")
    return fields.unionByName(one(missing, "decision is missing")).unionByName(one(extra, "asset is not pending")).unionByName(one(twice, "more than one decision"))


def expert_events(rows: DataFrame, current: DataFrame, earlier: DataFrame) -> DataFrame:
    """The final review event of every decision, numbered after the asset's earlier ones, with the state it leads to.

    Decisions of assets without a correction give no event.
    """
    before = earlier.filter("review_role = 'final_expert'").groupBy("asset_id").agg(F.count("*").alias("_before"))
    made = rows.join(current.filter("correction_id is not null").select("asset_id", *LINEAGE), "asset_id").join(before, "asset_id", "left")
    decision, reason = clean("expert_decision"), clean("expert_override_reason")
    approve = F.coalesce(*(F.when(decision == k, v) for k, v in DECISIONS.items()))
    override = F.lower(clean("expert_override")) == "yes"
    return made.select(
        F.format_string("REV-%s-final_expert-%02d", F.col("asset_id"), (F.coalesce("_before", F.lit(0)) + 1).cast("int")).alias("event_id"), "asset_id", F.lit("legal_expert").alias("review_actor_type"),
        F.lit("final_expert").alias("review_role"), approve.alias("decision"), F.array(reason).alias("findings"), F.sha2(F.concat_ws("|", F.col("asset_id"), decision, reason, F.lit(EXPERT_ROLE)), 256).alias("input_hash"),
        clean("review_elapsed_seconds").try_cast("double").alias("review_elapsed_seconds"), override.alias("expert_override"), F.when(override, reason).otherwise("").alias("expert_override_reason"), *LINEAGE, decision.alias("to_status"),
    )


def result_errors(results: DataFrame, candidates: DataFrame, members: DataFrame, assertions: DataFrame) -> DataFrame:
    """Messages for regression results that may not be recorded."""
    known = candidates.select("asset_id", "asset_type", "asset_status")
    inside = members.filter("status = 'included'").select("asset_id", F.lit(True).alias("_in")).distinct()
    asserted = assertions.select("asset_id", F.lit(True).alias("_asserted")).distinct()
    rows = results.select("asset_id", "rerun_id").join(known, "asset_id", "left").join(inside, "asset_id", "left").join(asserted, "asset_id", "left")
    there = F.col("asset_type").isNotNull()
    return say(rows, [
        (~there, "unknown asset"), (there & (F.col("asset_type") != "regression"), "results are for regression assets only"), (there & ~F.col("asset_status").eqNullSafe("accepted"), "the asset is not accepted"),
        (there & F.col("_in").isNull(), "the asset is in no release"), (there & F.col("_asserted").isNull(), "the asset has no assertion"), (there & ~filled("rerun_id"), "rerun_id is blank"),
    ])


def release_figures(members: DataFrame, reviews: DataFrame, adjudications: DataFrame, states: DataFrame, checks: DataFrame) -> DataFrame:
    """The figures of a release, one row.

    ``members``: ``asset_id``, ``asset_type`` of the release; shares are of them. ``reviews``: current events with
    ``review_protocol_version``; agreement is over all review fields of the blind reviews. The last blind adjudication
    of an asset counts, and the last expert event. The median is exact.
    """
    ids = members.select("asset_id")
    blind = reviews.filter(F.col("review_protocol_version") == BLIND)
    agreed = reviewer_conflicts(blind, REVIEW_FIELDS).filter("exact_agreement").select("asset_id", F.lit(True).alias("_agreed"))
    ruled = latest(adjudications.filter(F.col("review_protocol_version") == BLIND), "asset_id", "seq").select("asset_id", (F.size("conflicts") > 0).alias("_conflict"), (F.col("proposed_decision") != "approve").alias("_diverged"))
    expert = latest(reviews.filter("review_role = 'final_expert'"), "asset_id", "seq").select("asset_id", F.col("expert_override").alias("_override"), F.col("review_elapsed_seconds").alias("_seconds"))
    reworked = states.filter("to_status = 'rework_required'").select("asset_id", F.lit(True).alias("_reworked")).distinct()
    failed = checks.filter("not passed").groupBy("asset_id").agg(F.count("*").alias("_failed"))
    rows = members
    for part in (agreed, ruled, expert, reworked, failed):
        rows = rows.join(part.join(ids, "asset_id", "left_semi"), "asset_id", "left")
    n, share = F.count("*"), lambda c: rate(F.count_if(F.col(c)), F.count("*"))
    return rows.agg(
        *(F.count_if(F.col("asset_type") == t).alias(f"accepted_{t}") for t in ("sft", "preference", "regression")),
        share("_agreed").alias("ai_exact_agreement_rate"), share("_conflict").alias("ai_conflict_rate"), share("_override").alias("recorded_expert_override_rate_legacy"), share("_diverged").alias("expert_vs_blind_v2_divergence_rate"),
        rate(n - F.count_if(F.col("_reworked")), n).alias("first_pass_acceptance_rate"), F.coalesce(F.sum("_failed"), F.lit(0)).alias("qa_failure_count"), F.median("_seconds").alias("median_self_reported_review_entry_seconds"),
    )


def _same(part: str, columns: Sequence[str] = LINEAGE) -> Column:
    return reduce(and_, (F.col(f"{part}.{c}").eqNullSafe(F.col(c)) for c in columns))


def release_record_errors(
    accepted: DataFrame, corrections: DataFrame, reviews: DataFrame, checks: DataFrame, adjudications: DataFrame, bindings: DataFrame, members: DataFrame, versions: DataFrame, assertions: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Messages for the assets of a release whose records do not hold together.

    Events carry the four lineage columns and ``seq``; ``evidence``: ``asset_id``, ``review_role``, ``output_hash`` of the
    stored raw files (the submission under *final_expert*). Every table is brought to one row an asset before it is joined.
    """
    target = accepted.select("asset_id", "asset_type", "asset_status", "dataset_membership_status").join(current_corrections(corrections, accepted), "asset_id")
    of = lambda df: df.join(accepted.select("asset_id"), "asset_id", "left_semi")
    whole = lambda df, name, *more: latest(of(df), "asset_id", "seq").select("asset_id", F.struct(*LINEAGE, *more).alias(name))
    blind = F.col("review_protocol_version").eqNullSafe(BLIND)
    roles = of(reviews).groupBy("asset_id").agg(F.collect_set("review_role").alias("_roles"), F.collect_set(F.when(blind, F.col("review_role"))).alias("_blind"))
    final = whole(reviews.filter("review_role = 'final_expert'"), "_final", "decision", "review_actor_type")
    splits = of(members.filter("status = 'included'")).groupBy("asset_id").agg(F.collect_set("split").alias("_splits"))
    file = of(evidence.filter("review_role = 'final_expert'")).groupBy("asset_id").agg(F.max("output_hash").alias("_file"))
    there = lambda df, name: of(df).select("asset_id", F.lit(True).alias(name)).distinct()
    rows = target
    for part in (
        roles, final, whole(checks, "_check", *QUALITY_CHECKS, "contamination_check"), whole(adjudications, "_ruling", "status", "review_protocol_version"), whole(bindings, "_bound", "submission_file_sha256"),
        splits, file, there(versions, "_versioned"), there(assertions, "_asserted"),
    ):
        rows = rows.join(part, "asset_id", "left")
    has = lambda c, *names: reduce(and_, (F.array_contains(F.coalesce(c, F.array().cast("array<string>")), n) for n in names))
    passed = reduce(and_, (F.col(f"_check.{c}").eqNullSafe("passed") for c in QUALITY_CHECKS)) & F.coalesce(F.col("_check.contamination_check").isin("passed", "not_applicable"), F.lit(False))
    approved, expert = F.col("_final.decision").eqNullSafe("approve"), F.col("_final.review_actor_type").eqNullSafe("legal_expert")
    ruled, ruled_blind = F.coalesce(F.col("_ruling.status").isin("not_required", "proposed_adjudication"), F.lit(False)), F.col("_ruling.review_protocol_version").eqNullSafe(BLIND)
    bound, regression = F.col("_bound").isNotNull(), F.col("asset_type") == "regression"
    both = has("_blind", "reviewer_a", "reviewer_b")
    made = say(rows, [
        (~F.col("asset_status").eqNullSafe("accepted"), "asset not accepted"), (~filled("corrected_answer"), "missing corrected answer"), (~has("_roles", "reviewer_a", "reviewer_b", "final_expert"), "missing required review roles"),
        (~both, "missing blind review roles"), (~approved, "missing final expert approval"), (approved & ~expert, "final approval is not from an expert"), (approved & expert & ~_same("_final"), "final expert lineage mismatch"),
        (~passed, "final quality check not passed"), (~_same("_check"), "final quality check lineage mismatch"), (~ruled, "missing adjudication evidence"), (ruled & ~ruled_blind, "final adjudication is not blind"),
        (ruled & ruled_blind & ~_same("_ruling"), "final adjudication lineage mismatch"), (~bound, "missing expert approval binding"), (bound & ~_same("_bound", ["correction_id"]), "expert binding correction id mismatch"),
        (bound & ~_same("_bound", ["corrected_answer_hash"]), "expert binding answer hash mismatch"), (bound & ~_same("_bound", ["source_snapshot_id"]), "expert binding source snapshot mismatch"),
        (bound & F.col("_file").isNull(), "missing expert submission evidence"), (bound & F.col("_file").isNotNull() & ~F.col("_file").eqNullSafe(F.col("_bound.submission_file_sha256")), "expert submission hash mismatch"),
        (F.col("_versioned").isNull(), "missing source snapshot version"), (~F.col("dataset_membership_status").eqNullSafe("included"), "asset not marked included"), (F.col("_splits").isNull(), "asset missing included membership"),
        (regression & ~(has("_splits", "test") | has("_splits", "bug_reproduction")), "invalid regression split"), (regression & F.col("_asserted").isNull(), "missing regression assertion"),
    ])
    raw = of(evidence).groupBy("asset_id", "review_role").agg(F.max("output_hash").alias("_raw"))
    events = reviews.filter(blind).select("asset_id", "review_role", "output_hash", F.struct(*LINEAGE).alias("_event")).join(rows.filter(both).select("asset_id", *LINEAGE), "asset_id").join(raw, ["asset_id", "review_role"], "left")
    about = lambda text: F.concat(F.lit(f"blind review {text}: "), "review_role")
    return made.unionByName(say(events, [
        (~_same("_event", [c]), about(f"{c} mismatch")) for c in LINEAGE
    ] + [(F.col("_raw").isNull(), about("has no raw output")), (F.col("_raw").isNotNull() & ~F.col("_raw").eqNullSafe(F.col("output_hash")), about("raw output hash mismatch"))]))


def release_result_errors(results: DataFrame, logs: DataFrame, events: DataFrame, directories: DataFrame, metrics: DataFrame, official: int, scoring: str, expected: int) -> DataFrame:
    """Messages for the official regression results of a release, about the release as a whole.

    ``events``: the attempt ledger (``event_type``, ``attempt``); ``directories``: attempts with a folder; ``metrics``:
    ``metric``, ``value`` as text; ``official``: the attempt that the manifest names.
    """
    none = lambda t: F.lit(None).cast(t)
    # One row a run of either table, then one row a table pair: each table is read once, whatever the number of rules.
    wrong = [~F.coalesce(F.col("regression_status").isin("passed", "failed"), F.lit(False)), ~F.col("scoring_revision").eqNullSafe(scoring), F.coalesce(F.col("regression_status") == "passed", F.lit(False))]
    rows = results.select(clean("rerun_id").alias("id"), F.lit(1).alias("r"), F.lit(0).alias("l"), F.col("attempt").cast("long").alias("attempt"), *(w.cast("int").alias(n) for w, n in zip(wrong, ("status", "scoring", "passed"))))
    rows = rows.unionByName(logs.select(clean("rerun_id").alias("id"), F.lit(0).alias("r"), F.lit(1).alias("l"), none("long").alias("attempt"), *(F.lit(0).alias(n) for n in ("status", "scoring", "passed"))))
    runs = rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("r", "l", "status", "scoring", "passed")), F.min("attempt").alias("least"), F.max("attempt").alias("most")).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("r", "l", "status", "scoring", "passed")), F.min("least").alias("least"), F.max("most").alias("most"),
        F.count_if((F.col("id") == "") & (F.col("r") > 0)).alias("blank"), F.count_if(F.col("r") > 1).alias("again"), F.count_if((F.col("r") > 0) != (F.col("l") > 0)).alias("apart"),
    )
    kinds = events.filter("event_type in ('attempt_recorded', 'official_attempt_selected')").select(F.col("attempt").cast("long").alias("attempt"), (F.col("event_type") == "attempt_recorded").cast("int").alias("e"), F.lit(0).alias("d"))
    tries = kinds.unionByName(directories.select(F.col("attempt").cast("long").alias("attempt"), F.lit(0).alias("e"), F.lit(1).alias("d")))
    tries = tries.groupBy("attempt").agg(F.sum("e").alias("e"), F.sum("d").alias("d"), F.count_if((F.col("e") == 0) & (F.col("d") == 0)).alias("chosen")).agg(
        F.count_if(((F.col("e") > 0) != (F.col("d") > 0)) | (F.col("attempt").isNull() & (F.col("e") + F.col("d") > 0))).alias("unlike"), F.coalesce(F.sum(F.when(F.col("attempt") == official, F.col("chosen"))), F.lit(0)).alias("selected"),
    )
    told = metrics.filter("metric = 'regression_pass_rate'").agg(F.max(F.col("value").try_cast("double")).alias("told"))
    c = F.col
    rules = [
        (c("r") != expected, f"expected {expected} regression results"), (c("blank") > 0, "blank rerun_id"), (c("again") > 0, "rerun_id values are not unique"), (c("status") > 0, "invalid regression_status"),
        (c("scoring") > 0, f"results are not uniformly {scoring}"), (~F.coalesce(c("least") == c("most"), F.lit(False)), "results must come from exactly one attempt"), (~c("least").eqNullSafe(F.lit(official)), "official attempt mismatch"),
        (c("l") != expected, f"expected {expected} run logs"), (c("apart") > 0, "rerun_id of results and run logs differ"), (c("unlike") > 0, "attempt ledger and folders differ"),
        (c("selected") == 0, "official attempt was never selected"), (~rate(c("passed"), c("r")).eqNullSafe(c("told")), "regression pass rate mismatch"),
    ]
    one = runs.crossJoin(tries).crossJoin(told)  # one row each
    return one.select(F.lit("release").alias("subject"), F.explode(F.array_compact(F.array(*(F.when(w, F.lit(m)) for w, m in rules)))).alias("message"))


def build_release(
    candidates: DataFrame, release: str, log: DataFrame, corrections: DataFrame, reviews: DataFrame, adjudications: DataFrame, checks: DataFrame, bindings: DataFrame, assertions: DataFrame, versions: DataFrame,
    expected: dict[str, int] | None = None, limitations: str = "Redacted sample; not legal advice.",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a release, and messages for what forbids it.

    Accepted assets of the cohort get a split and a membership; their records carry the latest correction, adjudication,
    quality check, assertion and binding, all current reviews and all source versions (a few an asset). Public samples are
    the assets that may be shown, with nothing but their answer. ``expected`` gives the number of assets a type.
    """
    cohort = assign_split(release_cohort(candidates))
    members, again = update_memberships(log, cohort, release)
    known = cohort.select("asset_id")
    last = lambda df, name, order="seq": latest(df.join(known, "asset_id", "left_semi"), "asset_id", order).select("asset_id", F.struct(*(c for c in df.columns if c not in ("asset_id", order) or c == "revision_number")).alias(name))
    every = lambda df, name: df.join(known, "asset_id", "left_semi").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in df.columns if c not in ("asset_id", "seq"))))).alias(name))
    records = cohort
    for part in (
        last(corrections, "correction", "revision_number"), last(adjudications, "adjudication"), last(checks, "quality_check"), last(assertions, "regression_assertion", "revision_number"), last(bindings, "expert_approval_binding"),
        every(reviews, "review_events"), every(versions, "source_snapshot_versions"),
    ):
        records = records.join(part, "asset_id", "left")
    shown = records.filter("public_visibility = 'public_redacted'").select("asset_id", "asset_type", "source_case_id", F.coalesce("correction.corrected_answer", F.lit("")).alias("corrected_answer"), F.lit(limitations).alias("limitations"))
    fields = [f for f in FINGERPRINTS if f in cohort.columns]
    tests = cohort.filter("split = 'test'")
    common = shared_fingerprints(cohort.filter("split = 'train'"), tests, fields)
    audit = tests.agg(F.count("*").alias("n")).select(
        F.lit("train_vs_test").alias("scope"), F.when(F.col("n") > 0, "passed").otherwise("not_applicable").alias("status"), F.lit(",".join(fields)).alias("signals_checked"),
        F.when(F.col("n") > 0, "no overlaps detected").otherwise("no independent test split; same-source regressions are bug_reproduction").alias("note"),
    )
    one = lambda df, subject, text: df.select(F.col(subject).alias("subject"), F.lit(text).alias("message"))
    wrong = one(undisclosed_overlaps(cohort), "asset_id", "source overlaps training data without disclosure").unionByName(one(again, "dataset_membership_id", "membership id is in the log already")).unionByName(one(common, "value", "train and test overlap"))
    if expected is not None:
        wanted = candidates.sparkSession.createDataFrame(list(expected.items()), "asset_type string, wanted long")
        counts = wanted.join(cohort.groupBy("asset_type").agg(F.count("*").alias("n")), "asset_type", "full").filter(~F.coalesce("wanted", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0))))
        wrong = wrong.unionByName(one(counts, "asset_type", "unexpected number of assets"))
    return {"accepted_assets": records, "dataset_memberships": members, "public_redacted_samples": shown, "contamination_audit": audit}, wrong


def review_events(answers: DataFrame, current: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """Blind review events from model answers (``asset_id``, ``prompt``, ``answer``), and messages for answers without a JSON object.

    A decision or policy that is not known becomes rework or human review, a missing judgement stays null. ``current``
    is the lineage the reviewer saw; assets without a correction give no event.
    """
    rows = answers.join(current.filter("correction_id is not null").select("asset_id", *LINEAGE), "asset_id").withColumn("_json", fenced_object(F.col("answer")))
    given = lambda k: F.get_json_object("_json", f"$.{k}")
    known = lambda k, names, default: F.when(given(k).isin(*names), given(k)).otherwise(default)
    texts = lambda k: F.filter(F.transform(F.coalesce(F.from_json(given(k), "array<string>"), F.array().cast("array<string>")), clean), lambda x: x != "")
    flag = lambda k: given(k).try_cast("boolean")
    made = rows.filter("_json is not null").select(
        F.format_string(f"REV-%s-{role}-{BLIND}-%02d", F.col("asset_id"), F.col("correction_revision").cast("int")).alias("event_id"), "asset_id", F.lit("ai_model").alias("review_actor_type"), F.lit(role).alias("review_role"),
        known("decision", DECISIONS.values(), "rework").alias("decision"), texts("findings").alias("findings"), known("response_policy", POLICIES, "human_review").alias("response_policy"),
        *(flag(k).alias(k) for k in ("legal_conclusion_supported", "critical_facts_covered", "dangerous_action_advice")), texts("unsupported_claims").alias("unsupported_claims"),
        known("citation_support", CITATION_SUPPORT, "not_applicable").alias("citation_support"), *(F.coalesce(flag(k), F.lit(False)).alias(k) for k in ("should_clarify", "should_human_review")),
        F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("input_hash"), F.sha2("answer", 256).alias("output_hash"), *LINEAGE, F.lit(BLIND).alias("review_protocol_version"),
    )
    return made, rows.filter("_json is null").select("asset_id", F.lit("the answer holds no JSON object").alias("message"))


def requeue(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """Assets in work whose latest correction looks cut off, with the signs and the step back to rework."""
    open_ = candidates.filter(~F.col("asset_status").isin("accepted", "rejected", "proposed", "correction_drafting", "rework_required")).select("asset_id", "asset_status")
    last = latest(corrections, "asset_id", "revision_number").select("asset_id", completeness_issues(F.col("corrected_answer")).alias("issues"))
    return open_.join(last, "asset_id").filter(F.size("issues") > 0).select("asset_id", F.col("asset_status").alias("from_status"), F.lit("rework_required").alias("to_status"), "issues")


def replacements(wanted: DataFrame, reviewed: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every wanted case (``asset_id``, ``source_case_id``) its worst reviewed run with an answer, failures first, and messages for cases without one."""
    severity = F.coalesce(F.array_position(F.array(*map(F.lit, ("fail", "partial", "pass"))), clean("human_pass_fail")), F.lit(0))
    ranked = reviewed.filter(filled("output_text")).select(F.col("sample_id").alias("source_case_id"), F.struct(F.when(severity == 0, 4).otherwise(severity).alias("rank"), F.col("run_id"), F.col("output_text").alias("text"), clean("human_pass_fail").alias("outcome")).alias("_r"))
    worst = ranked.groupBy("source_case_id").agg(F.min("_r").alias("_r"))
    outputs = runs.groupBy("run_id").agg(F.min("output_text").alias("_output"))
    made = wanted.join(worst, "source_case_id").select("asset_id", "source_case_id", F.col("_r.run_id").alias("run_id"), F.col("_r.outcome").alias("human_pass_fail"), F.col("_r.text").alias("_text")).join(outputs, "run_id", "left")
    source = F.when(filled("_output"), F.col("_output")).otherwise(F.col("_text"))
    return made.select("asset_id", "source_case_id", F.col("run_id").alias("source_run_id"), "human_pass_fail", source.alias("source_output")), wanted.join(worst, "source_case_id", "left_anti").select("asset_id", F.lit("no reviewed answer for the case").alias("message"))


def review_batch_errors(batch: DataFrame, pending: DataFrame, training: DataFrame, corrections: DataFrame, reviews: DataFrame, rulings: DataFrame, checks: DataFrame, assertions: DataFrame, versions: DataFrame) -> DataFrame:
    """Messages for a batch of regression assets before the expert sees it.

    ``pending``: candidates awaiting the expert, with fingerprints, ``evaluation_role``, ``source_license_status`` and
    ``source_run_evidence_type``. ``reviews``, ``rulings`` and ``checks`` are current ones.
    """
    one = lambda df, text: df.select("asset_id", F.lit(text).alias("message")).distinct()
    last = current_corrections(corrections, pending).select("asset_id", "corrected_answer")
    roles = reviews.filter(F.col("review_protocol_version") == BLIND).groupBy("asset_id").agg(F.array_sort(F.collect_set("review_role")).alias("_roles"))
    ruled = rulings.filter(F.col("review_protocol_version") == BLIND).select("asset_id", F.lit(True).alias("_ruled")).distinct()
    passed = latest(checks, "asset_id", "seq").select("asset_id", F.col("passed").alias("_passed"))
    asserted = assertions.groupBy("asset_id").agg(F.max("revision_number").alias("_revision"))
    versioned = versions.select("asset_id", F.lit(True).alias("_versioned")).distinct()
    sheet = batch.select("asset_id", F.struct(*(c for c in batch.columns if c != "asset_id")).alias("_row"))
    rows = pending.join(sheet, "asset_id")
    for part in (last, roles, ruled, passed, asserted, versioned):
        rows = rows.join(part, "asset_id", "left")
    blank = [(F.coalesce(clean(F.col(f"_row.{c}")), F.lit("")) != "", f"{c} must be blank before the review") for c in ("expert_decision", "expert_override", "expert_override_reason", "review_elapsed_seconds") if c in batch.columns]
    made = say(rows, [
        (clean("evaluation_role") != "independent", "candidate is not independent"), (clean("source_license_status") != "self_authored_internal", "source is not self-authored"),
        (clean("source_run_evidence_type") != "synthetic_mock_baseline", "baseline evidence boundary missing"), (~filled("corrected_answer"), "missing current correction"),
        (~F.col("_roles").eqNullSafe(F.array(F.lit("reviewer_a"), F.lit("reviewer_b"))), "missing current blind reviews"), (F.col("_ruled").isNull(), "missing current blind adjudication"),
        (~F.coalesce("_passed", F.lit(False)), "missing passed quality check"), (F.coalesce("_revision", F.lit(0)) < 2, "missing assertion of revision 2 or later"), (F.col("_versioned").isNull(), "missing source snapshot version"),
        (~F.col("_row.source_snapshot_id").eqNullSafe(F.col("source_snapshot_id")), "batch row has another snapshot"), (~F.col("_row.corrected_answer").eqNullSafe(F.col("corrected_answer")), "batch row has another correction"), *blank,
    ])
    fields = [f for f in FINGERPRINTS if f in pending.columns and f in training.columns]
    overlap = fingerprints(pending, "asset_id", fields).join(fingerprints(training, "_train", fields).select("field", "value").distinct(), ["field", "value"], "left_semi")
    return made.unionByName(one(overlap, "source overlaps training data")).unionByName(one(pending.join(batch, "asset_id", "left_anti"), "asset is missing from the batch")).unionByName(
        one(batch.join(pending, "asset_id", "left_anti"), "asset is not pending")).unionByName(one(batch.groupBy("asset_id").count().filter("count > 1"), "asset is listed twice"))
