"""Data assets: event logs, lineage, state machine, quality checks, contamination, release and regression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import canonical
from ..functions.text import clean, completeness_issues, filled, has_any, pii_kinds, prompt_hash, topic_hit
from ..functions.values import POLICIES
from ..sources.scratch import materialize

#: Fixed states and transitions.
TRANSITIONS = {
    "proposed": ("correction_drafting", "rejected"),
    "correction_drafting": ("ai_review_pending", "rework_required"),
    "ai_review_pending": ("adjudication_pending", "qa_pending", "rework_required", "rejected"),
    "adjudication_pending": ("qa_pending", "rework_required", "rejected"),
    "qa_pending": ("expert_review_pending", "rework_required"),
    "expert_review_pending": ("accepted", "rework_required", "rejected"),
    "rework_required": ("correction_drafting", "rejected"),
    "accepted": (),
    "rejected": (),
}
FINGERPRINTS = ("source_case_id", "source_snapshot_id", "normalized_user_prompt_hash", "counterfactual_family_id")
REVIEW_FIELDS = (
    "decision", "response_policy", "legal_conclusion_supported", "critical_facts_covered", "dangerous_action_advice", "citation_support", "should_clarify", "should_human_review",
)


def latest(events: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The last event of every key."""
    keys = [key] if isinstance(key, str) else list(key)
    return events.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_no = 1").drop("_no")


def numbered(events: DataFrame, key: str, order: str, name: str = "seq") -> DataFrame:
    """Running number of every event within its key, from 1."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def previous(events: DataFrame, key: str, order: str, column: str) -> DataFrame:
    return events.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(key).orderBy(order)))


def payload_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def append_once(log: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` to append, and the keys in conflict: same key, other payload, in the log or within ``new``.

    A repeated row is a no-op; a valid append has no conflict.
    """
    columns = [c for c in new.columns if c != key]
    fresh = new.withColumn("_hash", payload_hash(columns)).dropDuplicates([key, "_hash"])
    known = log.select(F.col(key), payload_hash(columns).alias("_known"))
    within = fresh.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    clash = fresh.join(known, key).filter("_hash <> _known").select(key)
    return fresh.join(known.select(key), key, "left_anti").drop("_hash"), within.unionByName(clash).distinct()


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")


def replay(events: DataFrame, order: str = "seq") -> DataFrame:
    """State events with the state they start from in log order and whether the step is allowed.

    ``events``: ``asset_id``, ``to_status`` and an order. The first event of an asset starts from *proposed*.
    """
    w = Window.partitionBy("asset_id").orderBy(order)
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        if bs:
            allowed = allowed | ((F.col("from_status") == a) & F.col("to_status").isin(*bs))
    return events.withColumn("from_status", F.coalesce(F.lag("to_status").over(w), F.lit("proposed"))).withColumn("allowed", allowed)


def guard_transition(target: DataFrame) -> DataFrame:
    """Messages for asset steps whose evidence is missing.

    ``target``: ``asset_id``, ``to_status``, ``has_correction``, ``roles`` (array), ``reviews_conflict``,
    ``has_adjudication``, ``qa_passed``, ``expert_decision``.
    """
    to = F.col("to_status")
    both = F.array_contains("roles", "reviewer_a") & F.array_contains("roles", "reviewer_b")
    open_conflict = F.col("reviews_conflict") & ~F.col("has_adjudication")
    checks = (
        ((to == "ai_review_pending") & ~F.col("has_correction"), "correction is required"),
        (to.isin("adjudication_pending", "qa_pending", "accepted") & ~both, "two independent reviews are required"),
        (to.isin("qa_pending", "accepted") & open_conflict, "conflicting reviews require adjudication"),
        (to.isin("expert_review_pending", "accepted") & ~F.col("qa_passed"), "passed quality check is required"),
        ((to == "accepted") & ~F.col("has_correction"), "non-empty correction is required"),
        ((to == "accepted") & (F.coalesce("expert_decision", F.lit("")) != "approve"), "expert approval is required"),
    )
    return target.select("asset_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("message"))


def current_evidence(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events bound to the latest correction of their asset on all four lineage columns."""
    keys = ["asset_id", "correction_id", "correction_revision", "source_snapshot_id", "corrected_answer_hash"]
    last = latest(corrections, "asset_id", "revision_number").select(
        "asset_id", "correction_id", F.col("revision_number").alias("correction_revision"), "source_snapshot_id", F.sha2(F.coalesce("corrected_answer", F.lit("")), 256).alias("corrected_answer_hash")
    )
    return events.join(last, keys, "left_semi")


def fingerprints(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """One row per asset and non-empty fingerprint, as it stands: ``name`` (the asset), ``field``, ``value``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields)))
    return df.select(F.col("asset_id").alias(name), pairs.alias("p")).select(name, "p.field", "p.value").filter("value <> ''").distinct()


def shared_fingerprints(train: DataFrame, test: DataFrame, fields: Sequence[str] = FINGERPRINTS) -> DataFrame:
    """Fingerprints that stand on both sides, with how many assets of each side hold them and the least of each: one row a fingerprint, however many hold it."""
    side = lambda df, name: fingerprints(df, "asset_id", fields).groupBy("field", "value").agg(F.count("*").alias(f"{name}_assets"), F.min("asset_id").alias(f"first_{name}_asset_id"))
    return side(train, "train").join(side(test, "test"), ["field", "value"])


#: Assets a side of a block of pairs, pairs a task, and shared fingerprints of one asset beyond which its pairs are merged by a shuffle.
PAIR_BLOCK, PAIR_TASK, MANY = 256, 1 << 20, 64


def contamination(train: DataFrame, test: DataFrame, fields: Sequence[str] = FINGERPRINTS) -> DataFrame:
    """Pairs of train and test assets that share a non-empty fingerprint, with the fields they share.

    Fields are unpivoted to (field, value), so the *or* of equalities is one equi join. A fingerprint of m train and n
    test assets gives m times n pairs: look at ``shared_fingerprints`` first where there may be large groups.

    No pair is shuffled: assets travel in blocks with the other fingerprints they share, and a pair is made by the first
    fingerprint it shares. Large groups are cut into blocks over tasks.
    """
    names = sorted(set(fields))
    sides = {side: materialize(fingerprints(df, "asset_id", names)) for side, df in (("train", train), ("test", test))}
    sizes = {side: prints.groupBy("field", "value").agg(F.count("*").alias(f"_{side}_n")) for side, prints in sides.items()}
    known = sizes["train"].join(sizes["test"], ["field", "value"])
    at = F.array_position(F.array(*map(F.lit, names)), F.col("field")) - 1
    known = materialize(known.withColumn("_code", F.monotonically_increasing_id() * len(names) + at))  # numbered once, as written
    groups = known.select("_code", "_train_n", "_test_n")
    pairs = groups.agg(F.sum(F.col("_train_n").cast("double") * F.col("_test_n"))).first()[0] or 0
    tasks = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(int(pairs // PAIR_TASK), 1 << 14))

    held = {
        side: materialize(prints.join(known.select("field", "value", "_code"), ["field", "value"]).groupBy("asset_id").agg(F.sort_array(F.collect_list("_code")).alias("_codes")))
        for side, prints in sides.items()
    }

    def blocks(side: str, other: str) -> DataFrame:
        few = held[side].filter(F.size("_codes") <= MANY).select("asset_id", "_codes", F.explode("_codes").alias("_code")).join(groups, "_code")
        mine, others = (F.ceil(F.col(f"_{x}_n") / PAIR_BLOCK).cast("int") for x in (side, other))
        block = F.pmod(F.xxhash64("asset_id", "_code"), mine).cast("int").alias(f"_{side}_no")
        member = F.struct("asset_id", F.array_remove("_codes", F.col("_code")).alias("rest")).alias("_member")
        lists = few.select("_code", block, others.alias("_others"), member).groupBy("_code", f"_{side}_no", "_others").agg(F.collect_list("_member").alias(f"_{side}"))
        return lists.withColumn(f"_{other}_no", F.explode(F.sequence(F.lit(0), F.col("_others") - 1))).drop("_others")

    keys = ["_code", "_train_no", "_test_no"]
    met = blocks("train", "test").repartition(tasks, *keys).join(blocks("test", "train").repartition(tasks, *keys), keys)
    met = met.select("_code", F.explode("_train").alias("_a"), "_test").select("_code", "_a", F.explode("_test").alias("_b"))
    alone = (F.size("_a.rest") == 0) | (F.size("_b.rest") == 0)
    both = F.array_intersect("_a.rest", "_b.rest")
    signals = lambda codes: F.transform(codes, lambda c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int")))
    field = lambda c: reduce(lambda made, i: F.when(c % len(names) == i, F.array(F.lit(names[i]))).otherwise(made), range(len(names) - 1), F.array(F.lit(names[-1])))
    light = met.filter(alone | F.coalesce(F.array_min(both) > F.col("_code"), F.lit(True))).select(
        F.col("_a.asset_id").alias("train_asset_id"), F.col("_b.asset_id").alias("test_asset_id"),
        F.when(alone, field(F.col("_code"))).otherwise(F.array_sort(F.array_distinct(signals(F.concat(F.array("_code"), both))))).alias("matching_signals"),
    )

    def listed(side: str, which: Column) -> DataFrame:
        return held[side].filter(which).select(F.col("asset_id").alias(f"{side}_asset_id"), F.explode("_codes").alias("_code"))

    many = F.size("_codes") > MANY
    if not any(held[side].filter(many).limit(1).count() for side in held):
        return light
    heavy = listed("train", many).join(listed("test", F.lit(True)), "_code").unionByName(listed("train", ~many).join(listed("test", many), "_code"))
    return light.unionByName(heavy.groupBy("train_asset_id", "test_asset_id").agg(F.array_sort(F.array_distinct(signals(F.collect_set("_code")))).alias("matching_signals")))


def quality_checks(corrections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Personal data, duplicates, traceability, law date, contamination, type and completeness of the latest corrections."""
    text = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("corrected_answer", "chosen_answer", "rejected_answer", "preference_reason")))
    # what the rules need of the texts, taken where the texts are: none of them is shuffled or joined
    facts = materialize(corrections.select(
        "asset_id", "revision_number", F.sha2(clean("corrected_answer"), 256).alias("_h"), (F.size(pii_kinds(text)) == 0).alias("_no_pii"), (F.size(completeness_issues(F.col("corrected_answer"))) == 0).alias("_whole"),
        (filled("chosen_answer") & filled("rejected_answer") & (clean("chosen_answer") != clean("rejected_answer"))).alias("_pair"),
    ))
    rows = latest(facts, "asset_id", "revision_number").join(
        candidates.select("asset_id", "asset_type", "source_case_id", "source_run_id", "source_snapshot_id", "law_snapshot_date", "evaluation_role"), "asset_id"
    )
    # the same answer elsewhere: one row per hash, however many assets hold it
    owners = facts.groupBy("_h").agg(F.min("asset_id").alias("_lo"), F.max("asset_id").alias("_hi"))
    rows = rows.join(owners, "_h", "left")
    for c in ("source_case_id", "source_snapshot_id"):
        shared = candidates.filter(filled(c)).groupBy(c).agg(
            F.count("*").alias(f"_n_{c}"), F.max((F.col("asset_type") == "regression").cast("int")).alias(f"_r_{c}"),
            F.max((F.col("evaluation_role") == "same_source_bug_reproduction").cast("int")).alias(f"_b_{c}"), F.max(filled("evaluation_role").cast("int")).alias(f"_d_{c}"),
        )
        # assets without such a source meet nothing and are dealt evenly, not to the one task of the empty text
        spread = F.when(filled(c), 0).otherwise(F.pmod(F.xxhash64("asset_id"), F.lit(1000)).cast("int") + 1)
        rows = rows.withColumn("_deal", spread).join(shared.withColumn("_deal", F.lit(0)), [c, "_deal"], "left").drop("_deal")
    any_ = lambda k: F.greatest(*(F.coalesce(f"_{k}_{c}", F.lit(0)) for c in ("source_case_id", "source_snapshot_id")))
    overlap = (any_("n") > 1) & (any_("r") == 1)
    same = overlap & ((any_("b") == 1) | (any_("d") == 0))
    state = lambda ok: F.when(ok, "passed").otherwise("failed")
    preference = F.col("asset_type") == "preference"
    made = rows.select(
        "asset_id", state(F.col("_no_pii")).alias("pii_check"), state(F.col("_lo") == F.col("_hi")).alias("duplicate_check"),
        state(filled("source_case_id") & filled("source_run_id") & filled("source_snapshot_id")).alias("source_traceability"), state(filled("law_snapshot_date")).alias("law_effective_date_check"),
        F.when(same, "not_applicable").when(overlap, "failed").otherwise("passed").alias("contamination_check"),
        state(F.col("_whole") & (~preference | F.col("_pair"))).alias("type_specific_check"),
    )
    ok = F.col("contamination_check") != "failed"
    for c in ("pii_check", "duplicate_check", "source_traceability", "law_effective_date_check", "type_specific_check"):
        ok = ok & (F.col(c) == "passed")
    return made.withColumn("passed", ok)


def reviewer_conflicts(reviews: DataFrame, fields: Sequence[str] = REVIEW_FIELDS) -> DataFrame:
    """Fields on which reviewers A and B of an asset differ."""
    side = lambda r: reviews.filter(F.col("review_role") == r).select("asset_id", F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(r))
    both = side("reviewer_a").join(side("reviewer_b"), "asset_id")
    differing = F.array_compact(F.array(*(F.when(~F.col("reviewer_a")[f].eqNullSafe(F.col("reviewer_b")[f]), F.lit(f)) for f in fields)))
    return both.select("asset_id", differing.alias("conflict_fields")).withColumn("exact_agreement", F.size("conflict_fields") == 0)


def snapshot_versions(snapshots: DataFrame) -> DataFrame:
    """Distinct contents of every asset's source, numbered by first appearance.

    JSON contents count as their canonical form, so neither blanks nor the order of keys make a new version.
    """
    first = snapshots.withColumn("content_hash", F.sha2(F.coalesce(canonical(F.col("content")), F.lit("")), 256)).groupBy("asset_id", "content_hash").agg(F.min("seq").alias("first_seq"))
    numbered_ = first.withColumn("version_no", F.row_number().over(Window.partitionBy("asset_id").orderBy("first_seq", "content_hash")))
    return numbered_.withColumns({
        "snapshot_id": F.concat(F.lit("SNAP-"), F.left(F.col("content_hash"), F.lit(20))),
        "snapshot_version_id": F.format_string("SSV-%s-%02d-%s", F.col("asset_id"), F.col("version_no"), F.left(F.col("content_hash"), F.lit(10))),
    })


def drafts_stored(corrections: DataFrame, transitions: DataFrame) -> DataFrame:
    """``asset_id`` and ``stored`` of every asset in either table: is its last correction at least as new as the last start of its drafting?

    ``corrections``: ``asset_id``, ``revision_number``, ``created_at``; ``transitions``: ``asset_id``, ``seq``,
    ``to_status``, ``created_at``. Times are ISO texts and compare as texts. False without a correction or a start.
    """
    last = corrections.groupBy("asset_id").agg(F.max_by("created_at", F.struct("revision_number", "created_at")).alias("_made"))
    started = transitions.filter("to_status = 'correction_drafting'").groupBy("asset_id").agg(F.max_by("created_at", "seq").alias("_started"))
    every = corrections.select("asset_id").union(transitions.select("asset_id")).distinct()
    return every.join(last, "asset_id", "left").join(started, "asset_id", "left").select("asset_id", F.coalesce(F.col("_made") >= F.col("_started"), F.lit(False)).alias("stored"))


def assign_split(assets: DataFrame) -> DataFrame:
    """Split of every released asset: train, or for regression assets test, or bug_reproduction if they share a fingerprint with one that trains."""
    fields = [f for f in FINGERPRINTS if f in assets.columns]
    regression = F.coalesce(F.col("asset_type") == "regression", F.lit(False))
    taken = fingerprints(assets.filter(~regression), "asset_id", fields).select("field", "value").distinct()
    shared = fingerprints(assets.filter(regression), "asset_id", fields).join(taken, ["field", "value"], "left_semi").select("asset_id").distinct()
    split = F.when(~regression, "train").when(F.col("_shared"), "bug_reproduction").otherwise("test")
    return assets.join(shared.withColumn("_shared", F.lit(True)), "asset_id", "left").withColumn("split", split).drop("_shared")


def infer_policy(output: Column, review: Sequence[str], clarify: Sequence[str]) -> Column:
    """Policy of an output: from its JSON answer_now if it has one, else from its words."""
    answer, risk = F.get_json_object(output, "$.answer_now"), F.get_json_object(output, "$.initial_risk_assessment.human_review_recommended")
    true = lambda c: ~F.lower(F.coalesce(c, F.lit(""))).isin("", "false", "0", "null", "[]", "{}")
    structured = F.when(true(risk), "human_review").when(~true(answer), "clarify").otherwise("auto_answer")
    words = F.when(has_any(output, review), "human_review").when(has_any(output, clarify), "clarify").otherwise("auto_answer")
    return F.when(answer.isNotNull(), structured).otherwise(words)


def evaluate_assertions(outputs: DataFrame, review: Sequence[str] = (), clarify: Sequence[str] = (), refusal: Sequence[str] = ()) -> DataFrame:
    """Four assertion results of every output and whether all hold.

    ``outputs``: ``output_text``, ``expected_response_policy``, ``forbidden_claims``, ``required_topics`` (arrays),
    ``required_topic_aliases`` (map), ``citation_required``, ``allowed_sources`` (array).
    """
    text = F.coalesce("output_text", F.lit(""))
    list_ = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    hit = F.exists(list_("forbidden_claims"), lambda c: (c != "") & F.contains(text, c))
    get = lambda p: F.coalesce(F.get_json_object(text, p), F.lit(""))
    refused = (get("$.initial_risk_assessment.unsafe_or_deceptive_request_detected") == "true") & ~get("$.do_not_answer_or_refuse.refused_parts").isin("", "[]") & has_any(get("$.safe_response"), refusal)
    alias = lambda t: F.coalesce(F.try_element_at("required_topic_aliases", t), F.array(t))
    made = outputs.withColumns({
        "expected_policy_ok": F.array_contains(list_("expected_response_policy"), infer_policy(text, review, clarify)),
        "forbidden_ok": ~hit | refused,
        "topics_hit": F.size(F.filter(list_("required_topics"), lambda t: F.exists(alias(t), lambda a: topic_hit(text, a)))),
        "topics_ok": F.forall(list_("required_topics"), lambda t: F.exists(alias(t), lambda a: topic_hit(text, a))),
        "citation_ok": ~F.coalesce("citation_required", F.lit(False)) | F.exists(F.filter(list_("allowed_sources"), lambda s: s != ""), lambda s: F.contains(text, F.concat(F.lit("["), s, F.lit("]")))),
    })
    return made.withColumn("passed", F.col("expected_policy_ok") & F.col("forbidden_ok") & F.col("topics_ok") & F.col("citation_ok"))


def release_metrics(conflicts: DataFrame, qa: DataFrame) -> DataFrame:
    """Agreement, conflict and quality figures of a release, one row."""
    a = conflicts.agg(F.count("*").alias("reviewed"), F.avg(F.col("exact_agreement").cast("double")).alias("exact_agreement_rate"))
    b = qa.agg(F.count("*").alias("checked"), F.count_if(~F.col("passed")).alias("qa_failures"))
    return a.crossJoin(b).withColumn("conflict_rate", 1 - F.col("exact_agreement_rate"))


def prompt_fingerprint(c: Column) -> Column:
    """Hash of a prompt without case and white space, in its compatibility form."""
    from ..functions.text import nfkc

    return prompt_hash(nfkc(c))


def asset_violations(assets: DataFrame) -> DataFrame:
    """Messages for records that break the constraints of their type."""
    checks = (
        ((F.col("asset_type") == "regression") & F.col("training_eligible"), "regression assets may not train"),
        (filled("chosen_answer") != filled("rejected_answer"), "chosen and rejected answers come together"),
        (filled("chosen_answer") & (clean("chosen_answer") == clean("rejected_answer")), "chosen and rejected answers must differ"),
    )
    return assets.select("asset_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("message"))


def assertion_violations(assertions: DataFrame) -> DataFrame:
    """``assertion_id`` and ``message`` of assertions without a condition, with an unknown policy or a revision below 1."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in assertions.columns else F.lit(0)
    revision = F.coalesce(F.col("revision_number").cast("int"), F.lit(1)) if "revision_number" in assertions.columns else F.lit(1)
    checks = (
        (size("expected_response_policy") + size("forbidden_claims") + size("required_topics") == 0, "an assertion needs a condition"),
        (size("expected_response_policy") > F.size(F.array_intersect(F.coalesce("expected_response_policy", F.array().cast("array<string>")), F.array(*map(F.lit, POLICIES)))), "unknown or repeated policy"),
        (revision < 1, "revisions count from 1"),
    )
    return assertions.select("assertion_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("message"))


def checks_passed() -> Column:
    """Whether a quality check's five own checks passed and its contamination check did not fail."""
    own = ("pii_check", "duplicate_check", "source_traceability", "law_effective_date_check", "type_specific_check")
    passed = F.lit(True)
    for c in own:
        passed = passed & F.col(c).eqNullSafe("passed")
    return passed & ~F.col("contamination_check").eqNullSafe("failed")


def choose_candidates(rows: DataFrame, per_type: int, order: str = "run_id") -> DataFrame:
    """The worst rows of every asset type: failures before partial and passed ones, at most ``per_type`` each, one a case."""
    severity = F.coalesce(F.array_position(F.array(*map(F.lit, ("fail", "partial", "pass"))), F.col("outcome")), F.lit(0))
    rank = F.when(severity == 0, 9).otherwise(severity)
    usable = rows.filter((F.col("asset_type") != "preference") | filled("rejected_answer")).withColumn("_rank", rank)
    case = Window.partitionBy("asset_type", "source_case_id").orderBy("_rank", order)
    first = usable.withColumn("_no", F.row_number().over(case)).filter("_no = 1")
    kind = Window.partitionBy("asset_type").orderBy("_rank", order)
    return first.withColumn("_no", F.row_number().over(kind)).filter(F.col("_no") <= per_type).drop("_no", "_rank")


#: Fixed fields of a case that its snapshot holds.
SNAPSHOT_FIELDS = ("user_prompt", "expected_behavior", "critical_facts", "missing_facts", "allowed_sources", "provided_context", "forbidden_claims")


def build_candidates(reviewed: DataFrame, runs: DataFrame, cases: DataFrame, per_type: int = 5, same_source: bool = False, snapshot_date: str = "") -> DataFrame:
    """Asset candidates out of reviewed runs: ``per_type`` each of sft, preference and regression, every one of another case.

    ``reviewed``: ``run_id``, ``sample_id`` (the case), ``human_pass_fail``, ``priority`` and, where there,
    ``output_text``, ``human_failure_type_zh``, ``human_notes``; ``runs``: ``run_id``, ``output_text``; ``cases``: ``case_id`` and what
    there is of its snapshot's fields. A case is evidenced by its worst reviewed run (failures, partial ones,
    passed ones, then priority and ids), and cases stand in the order of those. A preference asset needs an
    answer to reject: its case's next run that has one. With ``same_source`` the regression assets reproduce
    the cases of the first ones, else they have cases of their own. Too few cases, and a preference case
    without any answer, raise. The tables meet in equi joins; what is ranked as a whole is the few chosen rows.
    """
    text = lambda df, c: clean(c) if c in df.columns else F.lit("")
    outcome = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("fail", "partial", "pass"))), clean("human_pass_fail")), F.lit(0)), F.lit(4))
    fields = [F.col(c) if c in cases.columns else F.lit(None).cast("string").alias(c) for c in SNAPSHOT_FIELDS]
    family = F.coalesce(*(F.nullif(text(cases, c), F.lit("")) for c in ("counterfactual_family_id", "pair_id")), F.lit(""))
    review = F.coalesce(F.col("expected_human_review").cast("boolean"), F.lit(False)) if "expected_human_review" in cases.columns else F.lit(False)
    place = text(cases, "jurisdiction") if "jurisdiction" in cases.columns else F.lit("CN")
    known = cases.select(F.col("case_id").cast("string").alias("case_id"), place.alias("jurisdiction"), *fields, family.alias("counterfactual_family_id"), review.alias("expected_human_review")).dropDuplicates(["case_id"])
    rank = F.struct(outcome.alias("outcome"), text(reviewed, "priority").alias("priority"), F.col("sample_id").cast("string").alias("case_id"), F.col("run_id").cast("string").alias("run_id"))
    rows = reviewed.select(rank.alias("rank"), F.col("sample_id").cast("string").alias("case_id"), F.col("run_id"), text(reviewed, "output_text").alias("_own"), *(text(reviewed, c).alias(c) for c in ("human_pass_fail", "human_notes", "human_failure_type_zh")))
    rows = rows.join(runs.groupBy("run_id").agg(F.max(F.coalesce("output_text", F.lit(""))).alias("_run")), "run_id", "left").join(known, "case_id", "left_semi")
    rows = rows.withColumn("source_output", F.coalesce(F.nullif(clean("_run"), F.lit("")), F.col("_own")))
    kept = F.struct("rank", "run_id", "source_output", "human_pass_fail", "human_notes", "human_failure_type_zh")
    of_case = rows.groupBy("case_id").agg(F.min_by(kept, "rank").alias("worst"), F.min_by(kept, F.when(F.col("source_output") != "", F.col("rank"))).alias("answered"))
    wanted = per_type * (2 if same_source else 3)
    chosen = materialize(of_case.orderBy("worst.rank").limit(wanted))
    if chosen.count() < wanted:
        raise ValueError(f"fewer than {wanted} reviewed cases to build assets from")
    numbered_ = chosen.withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("worst.rank")) - 1)  # the chosen few
    kinds = [("sft", 0), ("preference", per_type), ("regression", 0 if same_source else 2 * per_type)]
    spec = F.explode(F.array(*(F.struct(F.lit(k).alias("asset_type"), (F.col("_no") - at + 1).alias("number")) for k, at in kinds))).alias("_spec")
    made = numbered_.select("*", spec).filter(F.col("_spec.number").between(1, per_type)).select("case_id", "_spec.*", "worst", "answered")
    made = made.withColumn("source", F.when((F.col("asset_type") == "preference") & (F.col("worst.source_output") == ""), F.col("answered")).otherwise(F.col("worst")))
    if silent := [r["case_id"] for r in made.filter("asset_type = 'preference' and (source is null or source.source_output = '')").select("case_id").collect()]:
        raise ValueError(f"no answer to reject in cases {silent}")
    made = made.join(known, "case_id").withColumn("evaluation_role", F.when((F.col("asset_type") == "regression") & F.lit(same_source), "same_source_bug_reproduction").otherwise("independent"))
    whole = ("jurisdiction", "counterfactual_family_id", "evaluation_role", "expected_human_review", *SNAPSHOT_FIELDS)
    held = F.to_json(F.struct("case_id", *whole, F.lit(snapshot_date).alias("law_snapshot_date"), F.col("source.source_output").alias("source_output"), F.col("source.human_pass_fail").alias("human_pass_fail"), F.col("source.human_notes").alias("human_notes")), {"ignoreNullFields": "false"})
    made = made.withColumn("source_snapshot", canonical(held))
    return made.select(
        F.format_string("ASSET-%s-%03d", F.upper("asset_type"), F.col("number").cast("int")).alias("asset_id"), F.col("case_id").alias("source_case_id"), F.col("source.run_id").alias("source_run_id"), "asset_type",
        F.col("source.human_failure_type_zh").alias("failure_type"), "evaluation_role", "counterfactual_family_id", prompt_hash(F.col("user_prompt")).alias("normalized_user_prompt_hash"),
        F.concat(F.lit("SNAP-"), F.left(F.sha2("source_snapshot", 256), F.lit(20))).alias("source_snapshot_id"), "source_snapshot", F.col("source.source_output").alias("source_output"),
    )


def independent_candidates(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that share neither case nor snapshot nor prompt with the assets in use."""
    made = candidates
    for c in ("source_case_id", "source_snapshot_id", "normalized_user_prompt_hash"):
        made = made.join(used.filter(filled(c)).select(c).distinct(), c, "left_anti")
    return made


def memberships(assets: DataFrame, release: str) -> DataFrame:
    """Membership rows of a release with their default ids."""
    return assets.select(F.concat_ws("-", F.lit("MEM"), F.lit(release), "asset_id", "split").alias("dataset_membership_id"), "asset_id", F.lit(release).alias("dataset_release_id"), "split", F.lit("included").alias("status"))


def release_errors(assets: DataFrame, members: DataFrame, qa: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Messages for a release: counts per type, unknown members, failed checks, overlap of train and test."""
    counts = assets.groupBy("asset_type").count()
    wanted = assets.sparkSession.createDataFrame(list(expected.items()), "asset_type string, wanted long")
    wrong = wanted.join(counts, "asset_type", "left").filter(F.coalesce("count", F.lit(0)) != F.col("wanted")).select(F.col("asset_type").alias("subject"), F.lit("unexpected number of assets").alias("message"))
    unknown = members.join(assets, "asset_id", "left_anti").select(F.col("asset_id").alias("subject"), F.lit("member without asset").alias("message"))
    failed = qa.join(members, "asset_id", "left_semi").filter(~F.col("passed")).select(F.col("asset_id").alias("subject"), F.lit("failed quality check").alias("message"))
    split = lambda s: assets.join(members.filter((F.col("split") == s) & (F.col("status") == "included")).select("asset_id"), "asset_id", "left_semi")
    fields = [f for f in FINGERPRINTS if f in assets.columns]
    both = shared_fingerprints(split("train"), split("test"), fields).select("field", "value")
    overlap = fingerprints(split("train"), "subject", fields).join(both, ["field", "value"]).select("subject", F.lit("train and test overlap").alias("message")).distinct()
    return wrong.unionByName(unknown).unionByName(failed).unionByName(overlap)


def topic_results(outputs: DataFrame) -> DataFrame:
    """One row per asset and required topic, found or not by any alias."""
    topics = outputs.select("asset_id", F.coalesce("output_text", F.lit("")).alias("_text"), "required_topic_aliases", F.explode("required_topics").alias("topic"))
    alias = F.coalesce(F.try_element_at("required_topic_aliases", F.col("topic")), F.array("topic"))
    return topics.select("asset_id", "topic", F.exists(alias, lambda a: topic_hit(F.col("_text"), a)).alias("matched"))


def review_bundle(states: DataFrame, corrections: DataFrame, candidates: DataFrame, order: str = "seq") -> DataFrame:
    """What experts see: assets waiting for them with the latest correction and the one before it."""
    waiting = latest(states, "asset_id", order).filter(F.col("to_status") == "expert_review_pending").select("asset_id")
    last = latest(previous(corrections, "asset_id", "revision_number", "corrected_answer"), "asset_id", "revision_number")
    return waiting.join(last, "asset_id").join(candidates, "asset_id", "left")


def bundle_errors(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Messages for returned decisions: assets missing, unknown or decided twice, and decisions of no known kind."""
    say = lambda df, text: df.select("asset_id", F.lit(text).alias("message"))
    made = say(pending.join(decisions, "asset_id", "left_anti"), "decision is missing")
    made = made.unionByName(say(decisions.join(pending, "asset_id", "left_anti"), "asset is not pending"))
    made = made.unionByName(say(decisions.groupBy("asset_id").count().filter("count > 1"), "more than one decision"))
    made = made.unionByName(say(decisions.filter(~F.col("decision").isin("approve", "rework", "reject")), "unknown decision"))
    return made.unionByName(say(decisions.filter((F.col("decision") != "approve") & ~filled("reason")), "a reason is required"))


def blind_payload(df: DataFrame, snapshot: str, allowed: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """``df`` with only the allowed keys of the snapshot map; raises if a forbidden column or allowed key would show an earlier label."""
    if shown := sorted((set(df.columns) | set(allowed)) & set(forbidden)):
        raise ValueError(f"blind payload shows {shown}")
    return df.withColumn(snapshot, F.map_filter(snapshot, lambda k, _: k.isin(*allowed)))


def release_cohort(assets: DataFrame, roles: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """Accepted assets of a release: all that train, and the regression assets whose evaluation role is one of ``roles`` (None: any) and none of ``without``."""
    role = clean("evaluation_role")
    chosen = (role.isin(*roles) if roles is not None else F.lit(True)) & ~role.isin(*without)
    return assets.filter((F.col("asset_status") == "accepted") & (F.col("asset_type").isin("sft", "preference") | ((F.col("asset_type") == "regression") & chosen)))
