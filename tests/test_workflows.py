"""Execution, reports, case banks, releases, streaming and the command line on small fixtures."""

import pytest
from pyspark.sql import functions as F

from arbiterlake import cli
from arbiterlake.operators import assets, cases, execution, reports
from arbiterlake.streaming import eventlog


def test_render_guards():
    with pytest.raises(ValueError):
        execution.render("{gold}", ["gold"], hidden=["gold"])
    with pytest.raises(ValueError):
        execution.render("{other}", ["x"])


def test_failed_calls_become_rows(spark):
    def client():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return prompt.upper(), {"input_tokens": 3, "output_tokens": 1}

        return ask

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "run_id long, prompt string")
    got = {r.run_id: (r.answer, r.error, r.input_tokens) for r in execution.call_model(df, client).collect()}
    assert got == {1: ("OK", "", 3), 2: ("", "no answer", None)}


def test_plan_passes_the_base_answer_on(spark):
    plan = spark.createDataFrame([("r0", "s", "m", "V0"), ("r2", "s", "m", "V2"), ("r3", "s", "m", "V3")], "run_id string, sample_id string, model_alias string, version string")
    samples = spark.createDataFrame([("s", "why")], "sample_id string, user_question string")
    call = lambda df: df.withColumns({"answer": F.concat(F.lit("<"), F.col("prompt"), F.lit(">")), "error": F.lit("")})
    got = {r.run_id: r.output_text for r in execution.execute_plan(plan, samples, call, "{user_question}|{base_answer}").collect()}
    assert got == {"r0": "<why|>", "r2": "<why|<why|>>", "r3": "<why|>"}


def test_report_gate(spark):
    table = spark.createDataFrame([("V1", "no", 0.9, 10, 0, 0), ("V2", "no", 0.9, 10, 3, 0), ("V3", "no", 0.9, 10, 0, 1)], "version string, needs_human_review string, score_rate double, reviewable_claim_count long, citation_gate_issue_count long, claim_entailment_release_blocker_count long")
    table = table.withColumns({"claim_entailment_rows": F.lit(10), "reviewable_strict_citation_defect_count": F.lit(0)})
    got = {r.version: (r.gate_decision, r.citation_issue_rate) for r in reports.workflow_comparison(table).collect()}
    assert got == {"V1": ("candidate_auto_answer", 0.0), "V2": ("limited_release", 0.3), "V3": ("blocked", 0.0)}


def test_claim_totals_of_nothing(spark):
    row = reports.claim_totals(spark.createDataFrame([], "run_id string, entailment_label string, reviewable_legal_claim string")).first()
    assert row.claim_entailment_rows == 0 and row.supported_claim_count == 0


def test_redacted_samples(spark):
    rows = spark.createDataFrame([(1, "a", "m", "V0"), (2, "b", "m", "V0"), (3, "z", "m", "V0"), (4, "c", "n", "V1")], "run_id int, sample_id string, model_alias string, version string")
    assert [r.run_id for r in reports.redacted_samples(rows, ["z"], 3).collect()] == [3, 1, 4]


def test_case_bank(spark):
    ddl = "case_id string, user_prompt string, slice string, jurisdiction string, expected_behavior string, critical_facts array<string>, forbidden_claims array<string>, rubric array<struct<criterion:string,dimension:string,weight:bigint>>, pair_id string, pair_variant string, expected_data_asset_routes array<string>"
    rows = [
        ("c1", "p", "s", "j", "b", ["f", ""], [], [("x", "d", 5), ("y", "d", 1)], "p1", "A", ["eval"]), ("c2", "", "odd", "j", "b", [], [], [("x", "d", 0)], "", "", ["other"]), ("c2", "my password", "s", "j", "b", [], [], [("x", "d", 1)], "", "", []),
    ]
    df = spark.createDataFrame(rows, ddl)
    errors = {tuple(r) for r in cases.case_errors(df, ("user_prompt",), {"slice": ("s",)}).collect()}
    assert errors == {
        ("c2", "missing user_prompt"), ("c2", "invalid slice"), ("c2", "rubric needs positive weights"), ("c2", "invalid asset route"), ("c2", "private data"), ("c2", "duplicate case_id"), ("c1", "incomplete pair"),
    }
    made = cases.import_cases(df.filter("case_id = 'c1'"))
    assert [(r.rubric_id, r.max_score) for r in made["rubric_items"].orderBy("rubric_id").collect()] == [("c1-R01", 5), ("c1-R02", 1)]
    assert made["gold_labels"].first().expected_answer_points == "b；关键事实：f"
    moved = cases.migrate_routes(df, "expected_data_asset_routes", {"other": "sft"})
    assert moved.filter("user_prompt = ''").first().expected_data_asset_routes == ["sft"]


def test_release_errors(spark):
    made = spark.createDataFrame([("a", "sft", "c1"), ("b", "regression", "c1")], "asset_id string, asset_type string, source_case_id string")
    members = spark.createDataFrame([("a", "train", "included"), ("b", "test", "included"), ("x", "test", "included")], "asset_id string, split string, status string")
    qa = spark.createDataFrame([("a", True), ("b", False)], "asset_id string, passed boolean")
    got = {tuple(r) for r in assets.release_errors(made, members, qa, {"sft": 1, "regression": 2}).collect()}
    assert got == {("regression", "unexpected number of assets"), ("x", "member without asset"), ("b", "failed quality check"), ("a", "train and test overlap")}


def test_candidates_prefer_failures(spark):
    rows = spark.createDataFrame([("r1", "c1", "sft", "pass", ""), ("r2", "c1", "sft", "fail", ""), ("r3", "c2", "sft", "partial", ""), ("r4", "c3", "preference", "fail", "")], "run_id string, source_case_id string, asset_type string, outcome string, rejected_answer string")
    assert [r.run_id for r in assets.choose_candidates(rows, 2).orderBy("run_id").collect()] == ["r2", "r3"]


def test_stream_keeps_first_event(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(1, i), (2 + i, i)], "key int, v int").withColumn("at", F.to_timestamp(F.lit("2024-01-01"))).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key int, v int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = eventlog.first_per_key(stream, "key", "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.key for r in spark.table("firsts").collect()) == [1, 2, 3]


def test_command_line(spark, tmp_path):
    scores = spark.createDataFrame([("1", "s", '["missing_facts"]', "low", 0.5)], "run_id string, sample_id string, error_tags string, risk_level string, score_rate double")
    scores.write.parquet(f"{tmp_path}/scores.parquet")
    assert cli.main(["route-data", "--scores", f"{tmp_path}/scores.parquet", "--output", f"{tmp_path}/routed.parquet"]) == 0
    assert spark.read.parquet(f"{tmp_path}/routed.parquet").first().response_policy == "clarify"


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_json_in_text(spark):
    from arbiterlake.functions import jsontext as js

    df = spark.createDataFrame([('note {bad} then {"b": "}", "a": 1} {"c": 2}', "x"), ("[1]", '["p", "q"]'), (None, "")], "x string, y string")
    got = df.select(js.first_object(F.col("x")).alias("o"), js.list_or_scalar(F.col("y")).alias("l"), js.fenced_object(F.col("x")).alias("f")).collect()
    assert [r.o for r in got] == ['{"a": 1, "b": "}"}', None, None] and [r.l for r in got] == [["x"], ["p", "q"], []] and got[0].f is None


def test_manifest_and_markdown(spark):
    from arbiterlake.sources import sinks

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    one, two = sinks.manifest({"t": df}), sinks.manifest({"t": df.orderBy(F.desc("k"))})
    assert one == two and one["inputs"]["t"]["rows"] == 2
    assert "a\\|b" in sinks.markdown(df.orderBy("k"), "T")


def test_trace_cases(spark):
    from arbiterlake.operators import traces

    ddl = "case_id string, initial_user_message string, turn_plan array<struct<turn:bigint,user_message:string>>, expected_trace_review_recommendation string"
    df = spark.createDataFrame([("a", "hi", [(1, "x"), (2, "y")], "blocked"), ("b", "", [(2, "x")], "odd")], ddl)
    got = {tuple(r) for r in traces.trace_case_errors(df, ("initial_user_message",), ("blocked",)).collect()}
    assert got == {("b", "missing initial_user_message"), ("b", "turns are not numbered from 1"), ("b", "invalid recommendation")}


def test_expert_bundle(spark):
    states = spark.createDataFrame([("a", 1, "expert_review_pending"), ("b", 1, "expert_review_pending"), ("b", 2, "accepted")], "asset_id string, seq int, to_status string")
    corrections = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "asset_id string, revision_number int, corrected_answer string")
    row = assets.review_bundle(states, corrections, spark.createDataFrame([("a", "t")], "asset_id string, asset_type string")).first()
    assert (row.asset_id, row.corrected_answer, row.previous_corrected_answer) == ("a", "new", "old")
    pending = spark.createDataFrame([("a",), ("c",)], "asset_id string")
    decisions = spark.createDataFrame([("a", "rework", ""), ("z", "approve", "")], "asset_id string, decision string, reason string")
    assert {tuple(r) for r in assets.bundle_errors(pending, decisions).collect()} == {("c", "decision is missing"), ("z", "asset is not pending"), ("a", "a reason is required")}


def test_badcase_cards_fill_up_and_errors_choose_in_turn(spark):
    from arbiterlake.operators import dashboard

    runs = [("r1", "s1", "a"), ("r2", "s2", "a"), ("r3", "s2", "b"), ("r4", "s3", "b"), ("r5", "s2", "c"), ("r6", "s1", "a")]
    routing = spark.createDataFrame([(r, s, "V0", "consultation", "block", e, "P0", "released") for r, s, e in runs], "run_id string, sample_id string, version string, task_category string, response_policy string, main_error_type string, priority string, workflow_status string")
    scores = spark.createDataFrame([(r, 0.5) for r, _, _ in runs], "run_id string, score_rate double")
    cards = lambda limit: [(r.run_id, r.phase) for r in dashboard.badcase_cards(routing, scores, limit).orderBy("phase", "run_id").collect()]
    # a takes s2 before b can, so b takes s3 and c, with s2 only, takes none
    assert cards(80) == [("r1", 1), ("r2", 2), ("r4", 2), ("r3", 4), ("r5", 4), ("r6", 4)]
    assert cards(4) == [("r1", 1), ("r2", 2), ("r4", 2), ("r6", 4)]  # by sample before id


def test_overclaims_equal_plain_rule(spark):
    import random

    from arbiterlake.operators import traces

    pack = traces.TracePack(promises=("absolutely certain to win", "win", "sure"), negations=("not", "never"), scoped_negations=("cannot say",))

    def plain(text):
        for promise in pack.promises:
            at = text.find(promise)
            while at >= 0:
                scope = text[max(0, at - 48) : at]
                cut = max([scope.rfind(b) + len(b) for b in pack.boundaries if b in scope], default=0)
                scope = scope[cut:]
                near = scope[-12:] + text[at : at + len(promise) + 4]
                if not any(n in near for n in pack.negations) and not any(n in scope for n in pack.scoped_negations):
                    return True
                at = text.find(promise, at + len(promise))
        return False

    rng = random.Random(3)
    words = ["absolutely certain to win", "win", "sure", "not", "never", "we cannot say", ".", "; ", "a", "long words between", "\n", "。"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", "not absolutely certain to win"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", traces.overclaims(F.col("t"), pack).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: plain(t or "") for i, t in enumerate(texts)} and plain("not absolutely certain to win")


def test_rates_round_like_the_quotient(spark):
    from arbiterlake.functions import values as vs

    pairs = [(a, b) for b in (8, 16, 32, 64, 96, 160, 320, 640, 1280, 2000, 20000, 40000) for a in range(0, b + 1, max(1, b // 400))] + [(7, 0), (0, 5), (625, 20000), (1875, 20000), (10**9, 3 * 10**9)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", vs.rate(F.col("a"), F.col("b")).alias("four"), vs.rate(F.col("a"), F.col("b"), 3).alias("three"))
    for r in df.collect():
        assert (r.four, r.three) == ((round(r.a / r.b, 4), round(r.a / r.b, 3)) if r.b else (0.0, 0.0)), r


def test_bad_lines_come_with_their_number(spark, tmp_path):
    from arbiterlake.sources import tables

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n[1]\n{"x": 2}\n{"x": \n')
    (tmp_path / "b.jsonl").write_text('5\n{"x": 3}\n')
    good, bad = tables.read_jsonl(spark, str(tmp_path), "x int")
    assert sorted(r.x for r in good.collect()) == [1, 2, 3]
    assert sorted((r.file.rpartition("/")[2], r.line, r.value) for r in bad.collect()) == [("a.jsonl", 3, "not json"), ("a.jsonl", 4, "[1]"), ("a.jsonl", 6, '{"x": '), ("b.jsonl", 1, "5")]
    many = "\n".join('{"x": 1}' if i % 1000 else f"bad {i}" for i in range(20_000))
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "c.jsonl").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        _, bad = tables.read_jsonl(spark, str(tmp_path / "large"), "x int")
        assert sorted((r.line, r.value) for r in bad.collect()) == [(i + 1, f"bad {i}") for i in range(0, 20_000, 1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_base_prompts_are_sent_once(spark, tmp_path):
    plan = spark.createDataFrame([("r0", "s", "m", "V0"), ("r2", "s", "m", "V2"), ("r3", "s", "m", "V3")], "run_id string, sample_id string, model_alias string, version string")
    samples = spark.createDataFrame([("s", "why")], "sample_id string, user_question string")
    folder = str(tmp_path)

    def client():
        import uuid

        def ask(prompt):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return uuid.uuid4().hex, {}

        return ask

    got = {r.run_id: r for r in execution.execute_plan(plan, samples, lambda df: execution.call_model(df, client), "{user_question}|{base_answer}").collect()}
    sent = sorted(p.read_text() for p in tmp_path.iterdir())
    assert sent == sorted(["why|", "why|", f"why|{got['r0'].output_text}"])


def test_claims_of_json_answers(spark):
    from arbiterlake.operators import claims

    df = spark.createDataFrame([(1, '{"a": "first claim here", "b": [{"c": "second claim; third claim there"}], "n": 5}'), (2, "plain claim one! {not json"), (3, None)], "run_id int, output_text string")
    got = sorted((r.run_id, r.claim_index, r.claim) for r in claims.split_claims(df).collect())
    assert got == [(1, 1, "first claim here"), (1, 2, "second claim"), (1, 3, "third claim there"), (2, 1, "plain claim one"), (2, 2, "{not json")]
    assert claims.split_claims(df).columns == ["run_id", "output_text", "claim", "claim_index"]


def test_marked_csv_reads_back(spark, tmp_path):
    from arbiterlake.sources import sinks, tables

    sinks.write_csv(spark.createDataFrame([("é", [1, 2])], "name string, list array<int>"), f"{tmp_path}/t.csv", single=True)
    part = next(p for p in (tmp_path / "t.csv").iterdir() if p.name.startswith("part"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,")
    row = tables.read_csv(spark, f"{tmp_path}/t.csv").first()
    assert (row.name, row.list) == ("é", "[1,2]")


def test_look_ups_and_lists(spark):
    from arbiterlake.sources import sinks, tables

    table = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, no int, v string")
    found, missing = tables.lookup(spark.createDataFrame([("a",), ("c",)], "k string"), table, "k", "no")
    assert [r.v for r in found.collect()] == ["y"] and [r.k for r in missing.collect()] == ["c"]
    assert tables.listed(table, k="a, b", v="z").count() == 1 and tables.listed(table, k="").count() == 3
    for call in (lambda: tables.listed(table, k="a,q"), lambda: tables.matched(spark.createDataFrame([("q",)], "k string"), table, "k"), lambda: sinks.replace_all(table, "k", "/nowhere")):
        with pytest.raises(ValueError):
            call()
    ledger = spark.createDataFrame([("a", 1, "completed"), ("a", 2, "failed"), ("b", 1, "failed")], "asset_id string, attempt int, status string")
    assert {r.asset_id: r.attempt for r in sinks.next_attempt(ledger).collect()} == {"a": 3, "b": 2}
    assert [(r.asset_id, r.attempt) for r in sinks.official_attempts(ledger).collect()] == [("a", 1)]


def test_turn_prompt_blind_payload_and_cohort(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yes")], "now", {"a": "1", "score": "9"})], "h array<struct<role:string,content:string>>, m string, snap map<string,string>")
    assert df.select(execution.turn_prompt("Turns:\n{history}\nLast: {message}", F.col("h"), F.col("m")).alias("p")).first().p == "Turns:\nuser: hi\nassistant: yes\nLast: now"
    assert assets.blind_payload(df, "snap", ("a",), ("label",)).first().snap == {"a": "1"}
    with pytest.raises(ValueError):
        assets.blind_payload(df.withColumn("label", F.lit(1)), "snap", ("a",), ("label",))
    rows = spark.createDataFrame([("s", "sft", "", "accepted"), ("r", "regression", "independent", "accepted"), ("q", "regression", "other", "accepted"), ("x", "sft", "", "rejected")], "asset_id string, asset_type string, evaluation_role string, asset_status string")
    ids = lambda **k: {r.asset_id for r in assets.release_cohort(rows, **k).collect()}
    assert (ids(), ids(roles=("independent",)), ids(without=("independent",))) == ({"s", "r", "q"}, {"s", "r"}, {"s", "q"})
    made = spark.createDataFrame([("grounded_qa", "citation_grounding", False), ("", "adversarial_trap", True)], "t string, s string, e boolean")
    got = made.select(*(v.alias(k) for k, v in cases.slice_columns(F.col("t"), F.col("s"), F.col("e")).items())).collect()
    assert [tuple(r) for r in got] == [("case_analysis", "medium", "medium"), ("consultation", "hard", "high")]


def test_regression_figures_and_guards(spark):
    from arbiterlake.operators import regression

    results = spark.createDataFrame([("a", "passed", "scoring-v2"), ("b", "failed", "scoring-v2"), ("c", "passed", "scoring-v3")], "asset_id string, regression_status string, scoring_revision string")
    metrics = spark.createDataFrame([("regression_pass_rate", "0"), ("other", "7")], "metric string, value string")
    fresh, several = regression.refresh_metrics(metrics, results)
    assert {tuple(r) for r in fresh.collect()} == {("regression_pass_rate", "0.6667"), ("other", "7")} and several.count() == 2
    assert regression.refresh_metrics(metrics, results.filter("scoring_revision = 'scoring-v2'"))[1].count() == 0
    files = spark.createDataFrame([(1, "b.csv", "h2"), (1, "a.csv", "h1"), (2, "a.csv", "h3")], "attempt int, name string, sha256 string")
    assert {(r.event_id, r.event_type, tuple(sorted(r.file_sha256.items()))) for r in regression.attempt_events(files).collect()} == {
        ("REG-ATTEMPT-01-RECORDED", "attempt_recorded", (("a.csv", "h1"), ("b.csv", "h2"))), ("REG-ATTEMPT-02-RECORDED", "attempt_recorded", (("a.csv", "h3"),)),
    }
    one = lambda *rows: spark.createDataFrame([(r,) for r in rows], "sample_id string")
    runs = spark.createDataFrame([("r1", "s1", "V0"), ("r2", "s2", "V0"), ("r3", "s2", "V0"), ("r4", "s1", "V1")], "run_id string, sample_id string, version string")
    routing = spark.createDataFrame([("r1", "clarify"), ("r1", "clarify")], "run_id string, response_policy string")
    made, wrong = regression.baselines(one("s1", "s2", "s3"), one("s1", "s2"), one("s1", "s2", "s3"), runs, routing, F.col("version") == "V0")
    assert [(r.sample_id, r.run_id, r.response_policy) for r in made.collect()] == [("s1", "r1", "clarify")]
    assert {tuple(r) for r in wrong.collect()} == {("s2", "expected one baseline run, found 2"), ("s3", "expected one baseline run, found 0"), ("s3", "missing gold")}


def test_command_line_from_judge_output_to_gate(spark, tmp_path):
    rows = [(f"r{i}", f"s{i % 3}", "core", "consultation", "m", f"V{i % 4}", "text", "failed" if i == 5 else "ok", "" if i == 4 else '{"risk_level": "low", "error_tags": ["missing_facts"], "dimension_scores": {"legal_grounding": 2}}') for i in range(8)]
    runs = spark.createDataFrame(rows, "run_id string, sample_id string, source_dataset string, task_category string, model_alias string, version string, output_text string, run_status string, raw_judge_output string")
    runs.write.parquet(f"{tmp_path}/runs.parquet")
    assert cli.main(["all", "--runs", f"{tmp_path}/runs.parquet", "--output", f"{tmp_path}/out"]) == 0
    from arbiterlake.sources import tables

    gate = tables.read_csv(spark, f"{tmp_path}/out/release_gate")
    assert sum(int(r.runs) for r in gate.collect()) == 8 and {r.release_gate_decision for r in gate.collect()} <= {"blocked", "limited_release"}
    routed = tables.read_csv(spark, f"{tmp_path}/out/routing")
    assert {r.response_policy for r in routed.filter("run_id = 'r5'").collect()} == {"block"} and {r.response_policy for r in routed.filter("run_id = 'r1'").collect()} == {"clarify"}
    assert routed.filter("run_id = 'r4'").first().response_policy == "human_review"


def test_command_line_retrieval(spark, tmp_path):
    samples = spark.createDataFrame([("q1", "what of the deposit", "", "", "qa")], "sample_id string, user_question string, known_facts string, legal_concepts string, task_type string")
    corpus = spark.createDataFrame([("C1", "t", "note", "x", "deposit rules", "deposit"), ("C2", "t", "note", "x", "other things", "")], "source_id string, title string, source_type string, jurisdiction string, text string, tags string")
    for name, df in (("samples", samples), ("corpus", corpus)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert cli.main(["retrieve-contexts", "--samples", f"{tmp_path}/samples.parquet", "--corpus", f"{tmp_path}/corpus.parquet", "--output", f"{tmp_path}/out.parquet"]) == 0
    got = spark.read.parquet(f"{tmp_path}/out.parquet").orderBy("rank").collect()
    assert [(r.source_id, r.metadata_boost) for r in got] == [("C1", 0.12), ("C2", 0.0)] and got[0].retrieval_score > got[1].retrieval_score


def test_versions_go_in_levels_and_go_on_where_they_were_cut_off(spark, tmp_path):
    versions = ["V0", "V1", "V2", "V3", "V4"]
    plan = spark.createDataFrame([(f"{s}-{v}", s, "m", v) for s in ("s", "t") for v in versions], "run_id string, sample_id string, model_alias string, version string")
    samples = spark.createDataFrame([("s", "why"), ("t", "how")], "sample_id string, user_question string")
    needs = spark.createDataFrame([("V2", "V0"), ("V2", "V1"), ("V4", "V2"), ("V4", "V9")], "version string, needs string")
    assert [sorted(r[0] for r in x.collect()) for x in execution.in_levels(plan, needs)] == [["V0", "V1", "V3"], ["V2"], ["V4"]]
    circle = needs.union(spark.createDataFrame([("V0", "V4")], needs.schema))
    with pytest.raises(ValueError, match="circle"):
        execution.in_levels(plan, circle)
    asked = []

    def call(df):
        asked.append(sorted(r.run_id for r in df.select("run_id").collect()))
        if len(asked) == 2 and len(asked[-1]) == 2:
            raise RuntimeError("cut off")
        failed = (F.col("run_id") == "t-V1") & F.lit(len(asked) == 1)
        return df.withColumns({"answer": F.when(failed, "").otherwise(F.concat(F.lit("<"), F.col("prompt"), F.lit(">"))), "error": F.when(failed, "no answer").otherwise("")})

    contexts = spark.createDataFrame([("s", 1, "S1", "text")], "sample_id string, rank int, source_id string, text string")
    run = lambda: execution.execute_graph(plan, samples, call, "{user_question}{context}|{base_answer}", needs, contexts, ("V1",), log=str(tmp_path / "log"))
    with pytest.raises(RuntimeError, match="cut off"):
        run()
    got = {r.run_id: (r.output_text, r.run_status) for r in run().collect()}
    assert asked == [sorted(f"{s}-{v}" for s in "st" for v in ("V0", "V1", "V3")), ["s-V2", "t-V2"], ["t-V1"], ["s-V2", "t-V2"], ["s-V4", "t-V4"]]
    assert len(got) == 10 and all(s == "ok" for _, s in got.values())
    assert got["s-V2"][0] == "<why|<why|>\n\n<why[S1] text|>>" and got["t-V4"][0] == "<how|<how|<how|>\n\n<how|>>>" and got["s-V3"][0] == "<why|>"
    assert execution.execute_graph(plan.limit(0), samples, call, "{user_question}", needs).count() == 0
