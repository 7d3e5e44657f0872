"""Rules of dataset releases on small fixtures, one broken rule at a time."""

import json

import pytest
from pyspark.sql import functions as F

from arbiterlake.operators import assets, execution, releases


def messages(df, subject="asset_id"):
    return sorted((r[subject], r["message"]) for r in df.collect())


def test_regression_splits_look_at_training_assets_only(spark):
    rows = [("a", "sft", "c1", "s1"), ("b", "regression", "c1", "s2"), ("c", "regression", "c2", "s3"), ("d", "regression", "c2", "s4"), ("e", "regression", "c3", "s1"), ("f", None, "", None)]
    df = spark.createDataFrame(rows, "asset_id string, asset_type string, source_case_id string, source_snapshot_id string").withColumn("evaluation_role", F.when(F.col("asset_id") == "b", releases.DISCLOSED))
    split = assets.assign_split(df)
    assert {r.asset_id: r.split for r in split.collect()} == {"a": "train", "b": "bug_reproduction", "c": "test", "d": "test", "e": "bug_reproduction", "f": "train"}
    assert messages(releases.undisclosed_overlaps(split)) == [("e", "source overlaps training data without disclosure")]
    assert assets.assign_split(df.limit(0)).count() == 0


def test_memberships_name_ids_that_the_log_holds(spark):
    log = spark.createDataFrame([("MEM-r-a-test", "a", "r", "test", "deprecated"), ("MEM-r-a-train", "a", "r", "train", "included")], "dataset_membership_id string, asset_id string, dataset_release_id string, split string, status string")
    split = spark.createDataFrame([("a", "test")], "asset_id string, split string")
    made, again = releases.update_memberships(log, split, "r")
    assert sorted((r.split, r.status) for r in made.collect()) == [("test", "deprecated"), ("test", "included"), ("train", "deprecated")]
    assert [r[0] for r in again.collect()] == ["MEM-r-a-test"]
    kept, again = releases.update_memberships(log, split.withColumn("split", F.lit("train")), "r")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, log.collect())) and again.count() == 0


def test_open_adjudications_take_the_proposal(spark):
    fields = {"response_policy": "p", "legal_conclusion_supported": True, "critical_facts_covered": True}
    rows = [("a", "reviewer_a", "approve"), ("a", "reviewer_b", "rework"), ("b", "reviewer_a", "approve"), ("b", "reviewer_b", "approve"), ("c", "reviewer_a", "approve")]
    reviews = spark.createDataFrame(rows, "asset_id string, review_role string, decision string").withColumns({k: F.lit(v) for k, v in fields.items()})
    candidates = reviews.select("asset_id", F.lit("s").alias("source_snapshot_id")).distinct()
    corrections = candidates.select("asset_id", F.lit("k").alias("correction_id"), F.lit(1).alias("revision_number"), F.lit("text").alias("corrected_answer"))
    made, wrong = releases.adjudicate(reviews, releases.current_corrections(corrections, candidates), made_before := candidates.limit(0))
    assert made_before.count() == 0
    assert sorted((r.asset_id, r.status, r.conflicts, r.proposed_decision) for r in made.collect()) == [("a", "adjudication_pending", ["decision"], None), ("b", "not_required", [], "approve")]
    assert messages(wrong) == [("c", "both independent reviews are required")]
    answers = spark.createDataFrame([("a", 'so: {"proposed_decision": "reject", "rationale": "wrong"}')], "asset_id string, answer string")
    pending = made.filter("status = 'adjudication_pending'")
    assert [(r.proposed_decision, r.rationale, r.status) for r in releases.propose(pending, answers).collect()] == [("reject", "wrong", "proposed_adjudication")]
    assert [r.proposed_decision for r in releases.propose(pending, answers.withColumn("answer", F.lit("no idea"))).collect()] == ["rework"]


def test_answers_without_an_object_are_asked_again(spark):
    def client():
        given = iter(["no", "[1]", '```{"a": 1}```'])
        return lambda prompt: (next(given), {})

    df = spark.createDataFrame([("p",)], "prompt string")
    got = execution.call_model(df, releases.json_client(client), pause=0.0).collect()[0]
    assert json.loads(got.answer.strip("`")) == {"a": 1} and got.error == ""
    assert execution.call_model(df, releases.json_client(client), attempts=2, pause=0.0).collect()[0].error != ""


def test_approvals_that_cannot_be_bound(spark):
    candidates = spark.createDataFrame([(x, "s", "accepted" if x != "d" else "rejected") for x in "abcd"], "asset_id string, source_snapshot_id string, asset_status string")
    corrections = spark.createDataFrame([("a", "k1", 1, "t"), ("a", "k2", 2, "t "), ("a", "k3", 3, "u"), ("b", "k", 1, "t")], "asset_id string, correction_id string, revision_number int, corrected_answer string")
    reviews = spark.createDataFrame([("a", 1, "e1", ["why"]), ("a", 2, "e2", ["why", "x"]), ("b", 1, "e3", ["why"])], "asset_id string, seq int, event_id string, findings array<string>").withColumns({"review_role": F.lit("final_expert"), "decision": F.lit("approve")})
    sent = [("a", 1, "accepted", " t ", "why"), ("b", 1, "accepted", "v", "else"), ("c", 1, "rejected", "t", "why")]
    submissions = spark.createDataFrame(sent, "asset_id string, seq int, expert_decision string, corrected_answer string, expert_override_reason string").withColumns({"submission_file": F.lit("f"), "submission_file_sha256": F.lit("0")})
    bound, wrong = releases.bind_approvals(submissions, corrections, reviews, candidates)
    assert [(r.binding_id, r.correction_id, r.original_review_event_id) for r in bound.collect()] == [("EAB-a-02", "k2", "e2")]
    assert messages(wrong) == [("b", "no approval with the submission's reason"), ("b", "submitted text matches no correction"), ("c", "no accepted expert submission")]


def test_expert_bundles(spark):
    good = ("accepted", "read", "yes", "1.5", "legal_phd")
    rows = [("a", *good), ("b", "maybe", " ", "perhaps", "soon", ""), ("c", *good), ("c", *good)]
    df = spark.createDataFrame(rows, "asset_id string, expert_decision string, expert_override_reason string, expert_override string, review_elapsed_seconds string, reviewer_role string")
    pending = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "asset_id string")
    got = messages(releases.decision_errors(pending.filter("asset_id <> 'a'"), df))
    assert [m for a, m in got if a == "a"] == ["asset is not pending"] and len([m for a, m in got if a == "b"]) == 5
    assert ("c", "more than one decision") in got and ("d", "decision is missing") in got
    assert releases.decision_errors(pending.filter("asset_id = 'a'"), df.filter("asset_id = 'a'")).count() == 0


def test_results_that_may_not_be_recorded(spark):
    results = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", " "), ("x", "r3")], "asset_id string, rerun_id string")
    candidates = spark.createDataFrame([("a", "regression", "accepted"), ("b", "sft", None), ("c", "regression", "accepted")], "asset_id string, asset_type string, asset_status string")
    members = spark.createDataFrame([("a", "included"), ("c", "deprecated")], "asset_id string, status string")
    got = messages(releases.result_errors(results, candidates, members, members.filter("asset_id = 'a'")))
    assert got == [
        ("b", "results are for regression assets only"), ("b", "the asset has no assertion"), ("b", "the asset is in no release"), ("b", "the asset is not accepted"),
        ("c", "rerun_id is blank"), ("c", "the asset has no assertion"), ("c", "the asset is in no release"), ("x", "unknown asset"),
    ]


@pytest.mark.parametrize("fault, message", [
    ({}, None), ({"rerun": ["r1", "r1"]}, "rerun_id values are not unique"), ({"status": "unknown"}, "invalid regression_status"), ({"scoring": "scoring-v1"}, "results are not uniformly scoring-v2"),
    ({"attempts": [1, 2]}, "results must come from exactly one attempt"), ({"official": 2}, "official attempt mismatch"), ({"logs": ["r1", "r3"]}, "rerun_id of results and run logs differ"), ({"logs": ["r1"]}, "expected 2 run logs"),
    ({"folders": [1, 2]}, "attempt ledger and folders differ"), ({"selected": 3}, "official attempt was never selected"), ({"rate": "pending"}, "regression pass rate mismatch"),
])
def test_official_results(spark, fault, message):
    f = {"rerun": ["r1", "r2"], "status": "failed", "scoring": "scoring-v2", "attempts": [1, 1], "official": 1, "logs": ["r1", "r2"], "folders": [1], "selected": 1, "rate": "0.5"} | fault
    results = spark.createDataFrame([(f["rerun"][0], "passed", "scoring-v2", f["attempts"][0]), (f["rerun"][1], f["status"], f["scoring"], f["attempts"][1])], "rerun_id string, regression_status string, scoring_revision string, attempt int")
    logs = spark.createDataFrame([(x,) for x in f["logs"]], "rerun_id string")
    events = spark.createDataFrame([("attempt_recorded", 1), ("official_attempt_selected", f["selected"])], "event_type string, attempt int")
    metrics = spark.createDataFrame([("regression_pass_rate", f["rate"])], "metric string, value string")
    got = messages(releases.release_result_errors(results, logs, events, spark.createDataFrame([(x,) for x in f["folders"]], "attempt int"), metrics, f["official"], "scoring-v2", 2), "subject")
    assert (not got) if message is None else ("release", message) in got


def test_blind_reviews_from_answers(spark):
    current = spark.createDataFrame([("a", "s", "k", 2, "t", "h"), ("b", "s", "k", 1, "t", "h"), ("c", "s", None, None, None, None)], "asset_id string, source_snapshot_id string, correction_id string, correction_revision int, corrected_answer string, corrected_answer_hash string")
    said = '```{"decision": "approve", "findings": [" x ", ""], "response_policy": "odd", "legal_conclusion_supported": true, "should_clarify": true}```'
    answers = spark.createDataFrame([("a", "p", said), ("b", "p", "no"), ("c", "p", said)], "asset_id string, prompt string, answer string")
    made, wrong = releases.review_events(answers, current, "reviewer_a")
    r = made.collect()[0]
    assert made.count() == 1 and (r.event_id, r.decision, r.findings, r.response_policy, r.citation_support) == ("REV-a-reviewer_a-blind-v2-02", "approve", ["x"], "human_review", "not_applicable")
    assert (r.legal_conclusion_supported, r.critical_facts_covered, r.should_clarify, r.should_human_review) == (True, None, True, False)
    assert messages(wrong) == [("b", "the answer holds no JSON object")]


def test_requeue_and_replacements(spark):
    candidates = spark.createDataFrame([("a", "qa_pending"), ("b", "qa_pending"), ("c", "accepted")], "asset_id string, asset_status string")
    corrections = spark.createDataFrame([("a", 1, "fine."), ("a", 2, "**cut"), ("b", 1, "fine."), ("c", 1, "")], "asset_id string, revision_number int, corrected_answer string")
    assert [(r.asset_id, r.issues, r.to_status) for r in releases.requeue(candidates, corrections).collect()] == [("a", ["unbalanced_bold"], "rework_required")]
    wanted = spark.createDataFrame([("n1", "s1"), ("n2", "s2")], "asset_id string, source_case_id string")
    reviewed = spark.createDataFrame([("s1", "r1", "pass", "x"), ("s1", "r3", "fail", "y"), ("s1", "r2", "fail", "z"), ("s1", "r0", "fail", " "), ("s2", "r9", "", "")], "sample_id string, run_id string, human_pass_fail string, output_text string")
    runs = spark.createDataFrame([("r2", "full z")], "run_id string, output_text string")
    made, wrong = releases.replacements(wanted, reviewed, runs)
    assert [tuple(r) for r in made.collect()] == [("n1", "s1", "r2", "fail", "full z")] and messages(wrong) == [("n2", "no reviewed answer for the case")]


def test_review_batches(spark):
    role, license_, baseline = "independent", "self_authored_internal", "synthetic_mock_baseline"
    pending = spark.createDataFrame([("a", "c1", "s1", role, license_, baseline), ("b", "c2", "s2", "", "", "")], "asset_id string, source_case_id string, source_snapshot_id string, evaluation_role string, source_license_status string, source_run_evidence_type string")
    batch = spark.createDataFrame([("a", "s1", "t", ""), ("b", "other", "u", "accepted"), ("x", "s", "t", "")], "asset_id string, source_snapshot_id string, corrected_answer string, expert_decision string")
    training = spark.createDataFrame([("t", "c2", "s9")], "asset_id string, source_case_id string, source_snapshot_id string")
    corrections = spark.createDataFrame([("a", "k", 1, "t"), ("b", "k", 1, "t")], "asset_id string, correction_id string, revision_number int, corrected_answer string")
    reviews = spark.createDataFrame([("a", "reviewer_a"), ("a", "reviewer_b"), ("b", "reviewer_a")], "asset_id string, review_role string").withColumn("review_protocol_version", F.lit("blind-v2"))
    only = reviews.filter("asset_id = 'a'")
    checks = only.select("asset_id", F.lit(1).alias("seq"), F.lit(True).alias("passed"))
    got = messages(releases.review_batch_errors(batch, pending, training, corrections, reviews, only, checks, only.select("asset_id", F.lit(2).alias("revision_number")), only))
    assert [m for a, m in got if a == "a"] == [] and [m for a, m in got if a == "x"] == ["asset is not pending"]
    assert {m for a, m in got if a == "b"} == {
        "candidate is not independent", "source is not self-authored", "baseline evidence boundary missing", "missing current blind reviews", "missing current blind adjudication", "missing passed quality check",
        "missing assertion of revision 2 or later", "missing source snapshot version", "batch row has another snapshot", "batch row has another correction", "expert_decision must be blank before the review", "source overlaps training data",
    }


def test_cut_off_answers_are_asked_again(spark):
    def client():
        given = iter([("", {}), ("half", {"finish_reason": "Length"}), ("whole.", {"finish_reason": "stop"})])
        return lambda prompt: next(given)

    df = spark.createDataFrame([("p",)], "prompt string")
    assert [(r.answer, r.error) for r in execution.call_model(df, releases.whole_client(client), pause=0.0).collect()] == [("whole.", "")]
    assert "truncated" in execution.call_model(df, releases.whole_client(client), attempts=2, pause=0.0).collect()[0].error


def test_drafts_number_after_the_last_revision(spark):
    candidates = spark.createDataFrame([("a", "preference", "bad"), ("b", "preference", ""), ("c", "sft", "bad")], "asset_id string, asset_type string, source_output string")
    earlier = spark.createDataFrame([("a", 9)], "asset_id string, revision_number int")
    answers = spark.createDataFrame([("a", " good "), ("b", "good"), ("c", " ")], "asset_id string, answer string")
    made, wrong = releases.draft_corrections(candidates, earlier, answers)
    assert sorted((r.correction_id, r.corrected_answer, r.chosen_answer, r.rejected_answer) for r in made.collect()) == [("COR-a-10", "good", "good", "bad"), ("COR-b-01", "good", "", "")]
    assert messages(wrong) == [("c", "empty output")]


def test_release_tables(spark):
    rows = [("a", "sft", "accepted", "", "c1", "s1", "public_redacted"), ("b", "regression", "accepted", "", "c1", "s2", ""), ("c", "regression", "accepted", "", "c2", "s3", ""), ("d", "sft", "rejected", "", "c2", "s3", "public_redacted")]
    candidates = spark.createDataFrame(rows, "asset_id string, asset_type string, asset_status string, evaluation_role string, source_case_id string, source_snapshot_id string, public_visibility string")
    log = spark.createDataFrame([], "dataset_membership_id string, asset_id string, dataset_release_id string, split string, status string")
    corrections = spark.createDataFrame([("a", "k1", 1, "old"), ("a", "k2", 2, "new"), ("d", "k", 1, "x")], "asset_id string, correction_id string, revision_number int, corrected_answer string")
    events = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first")], "asset_id string, seq int, event_id string")
    assertions = spark.createDataFrame([("c", 1, "t")], "asset_id string, revision_number int, topic string")
    made, wrong = releases.build_release(candidates, "r", log, corrections, events, events, events, events, assertions, events, {"sft": 1, "regression": 1})
    records = {r.asset_id: r for r in made["accepted_assets"].collect()}
    assert {k: r.split for k, r in records.items()} == {"a": "train", "b": "bug_reproduction", "c": "test"}
    assert records["a"].correction.corrected_answer == "new" and records["a"].adjudication.event_id == "second" and [e.event_id for e in records["a"].review_events] == ["first", "second"]
    assert records["b"].correction is None and records["c"].regression_assertion.topic == "t"
    assert [(r.asset_id, r.corrected_answer) for r in made["public_redacted_samples"].collect()] == [("a", "new")]
    assert made["dataset_memberships"].count() == 3 and made["contamination_audit"].first().status == "passed"
    assert messages(wrong, "subject") == [("b", "source overlaps training data without disclosure"), ("regression", "unexpected number of assets")]
    again, wrong = releases.build_release(candidates, "r", made["dataset_memberships"], corrections, events, events, events, events, assertions, events)
    assert again["dataset_memberships"].count() == 3 and messages(wrong, "subject") == [("b", "source overlaps training data without disclosure")]
