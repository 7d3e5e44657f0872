"""Expressions and rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from arbiterlake.functions import text as tx
from arbiterlake.functions import values as vs
from arbiterlake.operators import assets, calibration, claims, dashboard, judging, retrieval, routing, traces
from arbiterlake.sources import sinks, tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, want", [("True", True), ("是", True), ("required", True), ("False", False), ("", False), (None, False), ("2", True), ("0.0", False), ("maybe", False)])
def test_parse_bool(spark, value, want):
    assert one(spark, value, vs.parse_bool) is want


@pytest.mark.parametrize("value, want", [("　 a\n", "a"), (None, ""), ("  ", "")])
def test_clean(spark, value, want):
    assert one(spark, value, tx.clean) == want


def test_tokens_bridge_cjk_gaps(spark):
    assert one(spark, "Ab 合x同_1", tx.tokens) == ["ab", "x", "_1", "合", "同", "合同"]
    assert one(spark, None, tx.tokens) == []


def test_source_ids(spark):
    assert one(spark, "see [ABC_1] and LAW-12-B, not _LAW-1", tx.source_ids) == ["ABC_1", "LAW-12-B"]


def test_claims(spark):
    assert one(spark, "1. first long claim;short\nsecond. claim here!", tx.claims_of_text) == ["first long claim", "second. claim here"]


def test_completeness(spark):
    assert one(spark, "a" * 200, tx.completeness_issues) == ["no_terminal_punctuation"]
    assert one(spark, "**a", tx.completeness_issues) == ["unbalanced_bold"]
    assert one(spark, None, tx.completeness_issues) == ["empty"]


def test_pii(spark):
    assert one(spark, "call 13812345678 or a.b@c.org", tx.pii_kinds) == ["mobile", "email"]


def test_prompt_hash_and_nfkc(spark):
    assert one(spark, "Ａ b", lambda c: tx.prompt_hash(tx.nfkc(c))) == one(spark, "aB", tx.prompt_hash)


def test_points_and_shorten(spark):
    assert one(spark, "答 +3分 （10分）", tx.points) == 10
    assert one(spark, "a  b c d", lambda c: tx.shorten(c, 4)) == "a b…"


def test_error_tags(spark):
    tags = one(spark, '["overclaim", {"coarse_error_tag": "other"}, "odd"]', vs.error_tags)
    assert [tuple(t) for t in tags] == [("overclaim", ""), ("needs_human_review", "non_standard_error_tag"), ("needs_human_review", "")]
    assert one(spark, "not json", vs.error_tags) == []


def test_hash_modulo(spark):
    import hashlib

    assert one(spark, "abc", lambda c: vs.hash_modulo(c, 7)) == int(hashlib.sha256(b"abc").hexdigest(), 16) % 7


def test_router_policies(spark):
    rows = [
        ("1", "s", "[]", "low", "high", "False", 0.9, "", None), ("2", "s", "[]", "low", "high", "False", 0.9, "", '["A"]'), ("3", "s", '["missing_facts"]', "low", "high", "False", 0.9, "", None),
        ("4", "s", "[]", "high", "high", "False", 0.9, "", None), ("5", "s", '["unsafe_action_suggestion"]', "low", "high", "False", 0.9, "", None),
        ("6", "s", '[{"coarse_error_tag":"needs_human_review","error_subtype":"empty_model_output"}]', "low", "high", "False", 0.9, "", None),
    ]
    df = spark.createDataFrame(rows, "run_id string, sample_id string, error_tags string, risk_level string, judge_confidence string, needs_human_review string, score_rate double, run_status string, rag_source_ids string")
    got = {r.run_id: (r.response_policy, r.workflow_status) for r in routing.route(df).collect()}
    assert got == {
        "1": ("auto_answer", "released"), "2": ("grounded_answer", "released"), "3": ("clarify", "released"), "4": ("human_review", "pending_review"), "5": ("block", "blocked"), "6": ("block", "blocked"),
    }


def test_write_back_violations(spark):
    routed = spark.createDataFrame([("1", "clarify", "pending_review", True), ("2", "clarify", "released", True)], "run_id string, response_policy string, workflow_status string, requires_correction boolean")
    seen = spark.createDataFrame([("1", "auto_answer", "released", "yes", "no"), ("2", "", "reviewed", "", ""), ("9", "", "", "", "")], "run_id string, adjudicated_triage_label string, target_workflow_status string, reviewer_approved string, correction_completed string")
    _, broken = routing.review_write_back(routed, seen)
    assert {tuple(r) for r in broken.collect()} == {("1", "release requires completed correction"), ("2", "invalid workflow transition"), ("9", "unknown run_id")}


def test_gate_blocks_on_one_unsafe_row(spark):
    scores = spark.createDataFrame([("1", "s", "consultation", "m", "V0", 0.9, '["unsafe_action_suggestion"]', "low"), ("2", "s", "consultation", "m", "V0", 0.9, "[]", "low")], "run_id string, sample_id string, task_category string, model_alias string, version string, score_rate double, error_tags string, risk_level string")
    runs = scores.select("run_id", "version")
    row = routing.release_gate(runs, scores, routing.route(scores)).first()
    assert row.release_gate_decision == "blocked" and row.unsafe_action_count == 1 and row.runs == 2


def test_delta(spark):
    scores = spark.createDataFrame([("s", "m", "V0", 0.4), ("s", "m", "V3", 0.7), ("t", "m", "V0", 0.1)], "sample_id string, model_alias string, version string, score_rate double")
    got = {r.sample_id: r.delta for r in dashboard.score_delta(scores).collect()}
    assert got["s"] == pytest.approx(0.3) and got["t"] is None


def test_retrieval_keeps_k_rows(spark):
    corpus = spark.createDataFrame([("a", "x y"), ("b", "x x z"), ("c", "q")], "source_id string, doc string")
    queries = spark.createDataFrame([(1, "x"), (2, "nothing")], "query_id int, query string")
    got = {(r.query_id, r.rank): r.source_id for r in retrieval.retrieve(queries, corpus, 2).collect()}
    assert got[1, 1] == "b" and got[1, 2] == "a" and got[2, 1] == "a" and got[2, 2] == "b"


def test_entailment_ladder(spark):
    pack = claims.Markers(reviewable=("must",), conditional=("if",), asserting=("must",), denying=("never",))
    rows = [(1, 1, "tenant must pay rent [SRC-1]"), (1, 2, "tenant must pay rent [SRC-9]"), (1, 3, "tenant must pay rent now"), (1, 4, "hello nice weather"), (1, 5, "owner must repair never [SRC-2]")]
    made = claims.entailment(spark.createDataFrame(rows, "run_id int, claim_index int, claim string"), spark.createDataFrame([(1, "SRC-1", "the tenant must pay the rent src"), (1, "SRC-2", "never owner repair must")], "run_id int, source_id string, text string"), pack)
    got = {r.claim_index: r.entailment_label for r in made.collect()}
    assert got == {1: "supported", 2: "fabricated_citation", 3: "no_citation", 4: "not_reviewable", 5: "contradicted"}


def test_json_claims(spark):
    df = spark.createDataFrame([('{"a": ["first claim text", {"b": "second claim text"}]}',), ("plain",)], "output_text string")
    assert [r.claim for r in claims.split_claims(df).collect()] == ["first claim text", "second claim text"]


def test_judge_payload(spark):
    df = spark.createDataFrame([('{"dimension_scores":{"risk_coverage":9},"atomic_scores":[{"score":5,"max_score":1}],"risk_level":"odd"}',)], "payload string")
    row = judging.normalize_payload(df).first()
    assert (row.total_score, row.max_score, row.risk_level, row.judge_confidence) == (3, 19, "high", "medium")


def test_self_judges_leave(spark):
    cols = "run_id int, judge_order int, model_alias string, model_vendor string, model_family string, model_name string, judge_alias string, judge_vendor string, judge_family string, judge_name string"
    pairs = spark.createDataFrame([(1, 0, "M-1", "v", "f", "n", "m 1", "", "", ""), (1, 1, "M-1", "v", "f", "n", "other", "", "", ""), (2, 0, "M-1", "v", "f", "n", "m_1", "", "", "")], cols)
    assert {(r.run_id, r.judge_order) for r in judging.exclude_self(pairs).collect()} == {(1, 1), (2, 0)}


def test_kappa(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("", "y")], "a string, b string")
    row = calibration.agreement(df, "a", "b").first()
    assert row.pairs == 3 and row.kappa == pytest.approx((2 / 3 - 4 / 9) / (1 - 4 / 9))
    assert calibration.agreement(df.limit(0), "a", "b").first().kappa is None
    assert calibration.agreement(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first().kappa == 1.0


def test_stratified_counts(spark):
    df = spark.range(100).selectExpr("id as run_id", "id % 4 as task_category")
    assert calibration.stratified(df, 8, ("task_category",)).groupBy("task_category").count().filter("count = 2").count() == 4


@pytest.mark.parametrize("text, want", [("we promise always wins", True), ("we never say always wins", False), ("no promise here; but always wins", True), (None, False)])
def test_overclaim(spark, text, want):
    pack = traces.TracePack(promises=("always wins",), negations=("never",), scoped_negations=("no promise",))
    assert one(spark, text, lambda c: traces.overclaims(c, pack)) is want


def test_replay_and_append(spark):
    events = spark.createDataFrame([("a", 1, "correction_drafting"), ("a", 2, "accepted")], "asset_id string, seq int, to_status string")
    assert [r.allowed for r in assets.replay(events).orderBy("seq").collect()] == [True, False]
    log = spark.createDataFrame([("k", "1")], "key string, v string")
    rows, bad = assets.append_once(log, spark.createDataFrame([("k", "1"), ("n", "2"), ("n", "2"), ("m", "1"), ("m", "2")], "key string, v string"), "key")
    assert [r.key for r in bad.collect()] == ["m"] and {r.key for r in rows.collect()} >= {"n"} and "k" not in {r.key for r in rows.collect()}


def test_old_evidence_is_ignored(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    corrections = spark.createDataFrame([("a", "c1", 1, "s", "old"), ("a", "c2", 2, "s", "new")], "asset_id string, correction_id string, revision_number int, source_snapshot_id string, corrected_answer string")
    events = spark.createDataFrame([("a", "c1", 1, "s", sha("old")), ("a", "c2", 2, "s", sha("new"))], "asset_id string, correction_id string, correction_revision int, source_snapshot_id string, corrected_answer_hash string")
    assert [r.correction_id for r in assets.current_evidence(events, corrections).collect()] == ["c2"]


def test_quality_check_finds_pii_and_duplicates(spark):
    c = spark.createDataFrame([("a", 1, "Same.", "x", "mail me@site.org", ""), ("b", 1, " Same. ", "x", "y", "")], "asset_id string, revision_number int, corrected_answer string, chosen_answer string, rejected_answer string, preference_reason string")
    k = spark.createDataFrame([("a", "preference", "1", "r", "s1", "2024", ""), ("b", "regression", "1", "r", "s2", "2024", "independent")], "asset_id string, asset_type string, source_case_id string, source_run_id string, source_snapshot_id string, law_snapshot_date string, evaluation_role string")
    got = {r.asset_id: r for r in assets.quality_checks(c, k).collect()}
    assert got["a"].pii_check == "failed" and got["b"].duplicate_check == "failed" and got["b"].contamination_check == "failed" and not got["a"].passed


def test_assertions(spark):
    df = spark.createDataFrame([('{"answer_now": false, "text": "pay the rent"}', ["clarify"], ["guilty"], ["rent"], {"rent": ["the rent"]}, False, [])], "output_text string, expected_response_policy array<string>, forbidden_claims array<string>, required_topics array<string>, required_topic_aliases map<string,array<string>>, citation_required boolean, allowed_sources array<string>")
    assert assets.evaluate_assertions(df).first().passed


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline', ["x"])], "id string, text string, tags array<string>")
    sinks.write_csv(df, f"{tmp_path}/t.csv", single=True)
    row = tables.read_csv(spark, f"{tmp_path}/t.csv").first()
    assert row.text == 'a "quoted"\nline' and row.tags == '["x"]'
    assert tables.read_optional_csv(spark, f"{tmp_path}/none.csv", "id string").count() == 0
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n[1]\n{"id": "2"}\n')
    good, bad = tables.read_jsonl(spark, f"{tmp_path}/l.jsonl", "id string")
    assert good.count() == 2 and bad.count() == 1
    assert tables.expand_env({"a": ["${X}-1"]}, {"X": "y"}) == {"a": ["y-1"]}
    with pytest.raises(ValueError):
        tables.load_corpus(spark.createDataFrame([("a", "", "", "", ""), (" a", "", "", "", "")], "source_id string, title string, source_type string, jurisdiction string, text string"))


def test_merge_keeps_first_shard(spark):
    a, b = spark.createDataFrame([(1, "a")], "run_id int, v string"), spark.createDataFrame([(1, "b", 0), (2, "b", 0)], "run_id int, v string, w int")
    assert {(r.run_id, r.v) for r in sinks.merge_shards([a, b], ["run_id"]).collect()} == {(1, "a"), (2, "b")}


def test_quality_check_moves_no_text(spark):
    c = spark.createDataFrame([(f"a{i}", 1, f"answer {i} " * 50, "x", "y", "") for i in range(40)], "asset_id string, revision_number int, corrected_answer string, chosen_answer string, rejected_answer string, preference_reason string")
    k = spark.createDataFrame([(f"a{i}", "sft", f"c{i}", f"r{i}", "" if i % 2 else f"s{i}", "2024", "") for i in range(40)], "asset_id string, asset_type string, source_case_id string, source_run_id string, source_snapshot_id string, law_snapshot_date string, evaluation_role string")
    made = assets.quality_checks(c, k)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "corrected_answer" not in plan and "_deal" in plan
    got = {r.asset_id: r for r in made.collect()}
    assert len(got) == 40 and all(r.source_traceability == ("failed" if int(a[1:]) % 2 else "passed") and r.contamination_check == "passed" for a, r in got.items())


def test_ensembles_gather_no_lists(spark):
    rows = [(1, 0, '["overclaim"]', 0.5, "low"), (1, 1, '["fabricated_citation"]', 0.5, "low"), (2, 0, '["missing_facts"]', 0.5, "low"), (2, 1, None, 0.5, "low")]
    df = spark.createDataFrame([(i, o, "primary", t, s, r) for i, o, t, s, r in rows], "run_id int, judge_order int, judge_role string, error_tags string, score_rate double, risk_level string")
    made = judging.ensemble_summary(df)
    assert "collect_set" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.run_id: (r.final_data_asset_routes, r.disagreement_reasons) for r in made.collect()}
    assert got == {1: (["preference", "badcase", "regression"], "critical_failure_mismatch|response_policy_mismatch"), 2: (["eval", "sft"], "response_policy_mismatch")}


def test_contamination_shuffles_no_pairs(spark):
    def plain(train, test):
        found = {}
        for a, *x in train:
            for b, *y in test:
                for f, v, w in zip(("s", "h"), x, y):
                    if v and v == w:
                        found.setdefault((a, b), set()).add(f)
        return {k: sorted(v) for k, v in found.items()}

    one = [(f"a{i}", "hot" if i % 3 else "", f"h{i // 4}") for i in range(900)] + [(None, "hot", None), ("a1", None, "h3"), ("x", "h3", "hot")] + [("many", f"m{i}", f"h{i}") for i in range(70)]
    two = [(f"b{i}", "hot" if i % 2 else None, f"h{i % 90}") for i in range(700)] + [(None, "hot", "h3"), ("b1", "m7", ""), ("y", "m7", "h9")]
    shape = "asset_id string, s string, h string"
    made = assets.contamination(spark.createDataFrame(one, shape), spark.createDataFrame(two, shape), ("s", "h"))
    got = [(r.train_asset_id, r.test_asset_id, r.matching_signals) for r in made.collect()]
    want = plain(one, two)
    assert len(got) == len(want) and {(a, b): m for a, b, m in got} == want
    light = assets.contamination(spark.createDataFrame(one[:900], shape), spark.createDataFrame(two[:700], shape), ("s", "h"))
    plan = light._jdf.queryExecution().optimizedPlan().toString()
    assert "_train_no" in plan and "collect_set" not in plan and light.count() == len(plain(one[:900], two[:700]))
