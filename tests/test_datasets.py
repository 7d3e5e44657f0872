"""Datasets from folders of sheets and manifests, configuration, templates, evidence and trace runs."""

import json

import pytest
from pyspark.sql import functions as F

from arbiterlake import cli
from arbiterlake.functions import text as tx
from arbiterlake.operators import cases as case_bank
from arbiterlake.operators import traces
from arbiterlake.sources import datasets


def sheet(folder, name, *lines):
    (folder / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_normal_sheets_round_trip_through_a_manifest(spark, tmp_path):
    sheet(tmp_path, "Eval_Input", "sample_id,user_question,task_type,legal_domain,law_snapshot_date,gone", " s1 ,why,draft letter,x,,", "s2,how,,,2024-01-01,", ",,,,,")
    sheet(tmp_path, "Gold_Labels", "sample_id,key_missing_facts,human_review_note", "s1,f1,n", "s2,f2,")
    sheet(tmp_path, "Rubric_Items", "sample_id,rubric_id,max_score", "s1,R2,1.0", "s1,R1,")
    extra = datasets.build_dataset(spark, str(tmp_path), "extra")
    made = datasets.build_dataset(spark, str(tmp_path), "core", {"eval_input": extra["eval_input"].withColumn("sample_id", F.concat("sample_id", F.lit("x")))}, jurisdiction="j", snapshot="2020-01-01")
    got = {r.sample_id: r for r in made["eval_input"].collect()}
    assert set(got) == {"s1", "s2", "s1x", "s2x"} and tuple(made["eval_input"].columns) == datasets.VISIBLE
    assert (got["s1"].task_category, got["s1"].law_snapshot_date, got["s1"].jurisdiction, got["s2"].task_category, got["s2"].task_type, got["s2"].law_snapshot_date) == ("document_drafting", "2020-01-01", "j", "consultation", "consultation", "2024-01-01")
    assert {(r.sample_id, r.core_sample_flag, r.deep_badcase_flag) for r in made["sample_metadata"].collect()} == {("s1", "yes", "no"), ("s2", "yes", "no")}
    out = str(tmp_path / "out")
    said = datasets.write_dataset(made, out, "d", "1")
    assert {s["source_dataset"]: s["expected_samples"] for s in said["sources"]} == {"core": 2, "extra": 2}
    back = datasets.load_dataset(spark, f"{out}/dataset_manifest.json")
    gold = {r.sample_id: r for r in back["gold_labels"].collect()}
    assert [(i["rubric_id"], i["max_score"]) for i in json.loads(gold["s1"].rubric_items)] == [("R1", 2), ("R2", 1)] and gold["s2"].rubric_items == "[]" and gold["s1"].human_review_note == "n"
    with pytest.raises(ValueError, match="rubric_items"):
        datasets.bundle(made["eval_input"].withColumn("rubric_items", F.lit("")), made["gold_labels"], made["rubric_items"])
    sheet(tmp_path, "Gold_Labels", "sample_id,key_missing_facts", "s1,f1")
    with pytest.raises(ValueError, match="s2"):
        datasets.build_dataset(spark, str(tmp_path), "core")


def test_old_sheets(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        datasets.sheet_kind(spark, str(tmp_path))
    sheet(tmp_path, "Task_Set", "sample_id,user_question,known_facts,legal_concepts,key_missing_facts,expected_clarification_questions,expected_answer_points,risk_points,expected_behavior", "s1,q,k,l,a,b,c,d,e", "s2,q,,,,,,,")
    sheet(tmp_path, "Sample_Index", "sample_id,task_type,legal_domain", "s1,Case study,x")
    sheet(tmp_path, "Rubric_Items", "sample_id,rubric_id,max_score", "s1,R1,1", "other,R1,1")
    sheet(tmp_path, "Error_Tags_Data_Routing", "sample_id,route_reason", "s1, look ")
    made = datasets.build_dataset(spark, str(tmp_path), "core")
    assert {(r.sample_id, r.task_category, r.task_type) for r in made["eval_input"].collect()} == {("s1", "case_analysis", "Case study"), ("s2", "consultation", "")}
    assert {(r.sample_id, r.human_review_note, r.expected_behavior) for r in made["gold_labels"].collect()} == {("s1", "look", "e"), ("s2", "", "")}
    assert [(r.sample_id, r.task_category, r.max_score) for r in made["rubric_items"].collect()] == [("s1", "case_analysis", 1)]
    sheet(tmp_path, "Task_Set", "sample_id,user_question", "s1,q")
    with pytest.raises(ValueError, match="known_facts"):
        datasets.build_dataset(spark, str(tmp_path), "core")


def test_configuration_and_templates(spark, tmp_path):
    (tmp_path / ".env").write_text("# a\nexport KEY='x=1'\nNAME=n\nbroken\n")
    (tmp_path / "c.json").write_text('{"a": ["${KEY}", "${NONE}"], "b": 1}')
    env = datasets.read_env(spark, str(tmp_path / ".env"))
    assert env == {"KEY": "x=1", "NAME": "n"} and datasets.read_env(spark, str(tmp_path / "none")) == {}
    assert datasets.read_config(spark, str(tmp_path / "c.json"), env) == {"a": ["x=1", ""], "b": 1}
    (tmp_path / "v0.md").write_text("one\ntwo {question}")
    assert datasets.read_templates(spark, str(tmp_path)) == {"v0": "one\ntwo {question}"}


def test_evidence_and_public_package(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    out = tmp_path / "out"
    with pytest.raises(FileNotFoundError, match="b.txt"):
        datasets.copy_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], str(out))
    assert not out.exists()
    datasets.copy_files(spark, [str(tmp_path / "a.txt")], str(out))
    assert (out / "a.txt").read_text() == "a"
    df = spark.createDataFrame([("x", "secret"), ("y", "")], "id string, note string")
    with pytest.raises(ValueError, match="t"):
        datasets.public_package({"t": df}, {"t": ["id", "note"]}, str(tmp_path / "p"), "secret")
    assert not (tmp_path / "p").exists()
    assert datasets.public_package({"t": df}, {"t": ["id"]}, str(tmp_path / "p"), "secret") == {"t": 2}


def test_traces_see_their_own_answers(spark):
    cases = spark.createDataFrame([("c1", [(1, "one"), (2, "two"), (3, "three")]), ("c2", [(None, "fail"), (2, "next")])], "case_id string, turn_plan array<struct<turn:int,user_message:string>>")
    models = spark.createDataFrame([("m",), ("n",)], "model_alias string")
    call = lambda df: df.withColumns({"answer": F.concat(F.lit("<"), F.regexp_replace("prompt", "\n", "/"), F.lit(">")), "error": F.when(F.col("user_message") == "fail", "timeout").otherwise("")})
    turns = traces.run_traces(cases, models, call, "{history}|{message}")
    got = {(r.trace_id, r.turn_index): (r.agent_message, r.status) for r in turns.collect()}
    assert len(got) == 10
    assert got["TRACE-c1-m", 2] == ("<user: one/assistant: <|one>|two>", "ok")
    assert got["TRACE-c1-n", 3][0].endswith("assistant: <user: one/assistant: <|one>|two>|three>")
    assert got["TRACE-c2-m", 1] == ("", "failed") and got["TRACE-c2-m", 2][0] == "<user: fail/assistant: |next>"
    assert traces.run_traces(cases.limit(0), models, call, "{message}").count() == 0
    evaluated = spark.createDataFrame([("TRACE-c1-m", "c1", "m", "d", "u", 3, 1.0, True, True, False, False, "blocked")], "trace_id string, case_id string, model_alias string, legal_domain string, user_behavior string, turn_count int, material_fact_coverage double, bad_premise_challenged boolean, human_review_recommended boolean, safe_redirection boolean, lexical_overclaim_flag boolean, trace_review_recommendation string")
    frames = traces.evidence(evaluated, turns)
    figures = {r.metric: r.value for r in frames["trace_metrics_summary"].collect()}
    assert (figures["traces"], figures["turns"], figures["api_completed_turns"], figures["human_calibration_status"]) == ("1", "10", "8", "pending")
    assert [tuple(r) for r in frames["risk_route_summary"].collect()] == [("u", "d", "blocked", 1)]
    assert len(json.loads(frames["redacted_trace_samples"].first().turn_output_hashes)) == 3
    assert "agent_message" not in frames["turn_level_summary"].columns and frames["human_trace_calibration_template"].first().human_notes == ""


def test_rubrics_of_benchmarks(spark):
    numbered = "总分10分\n1. 指出主体（3分）\r\n2、short\n3. a longer line without any points here\n4．依据 ＋5分"
    sections = "一、格式（共20分）\n标题 (5分)\n二、 事实\n时间 +8分"
    df = spark.createDataFrame([(numbered, sections)], "n string, s string")
    r = df.select(case_bank.rubric_items(F.col("n"), "D").alias("n"), case_bank.section_items(F.col("s")).alias("s"), case_bank.section_items(F.lit("plain")).alias("p"), case_bank.section_items(F.lit("总分5分")).alias("t"), tx.points(F.lit("（5分钟）"), 7).alias("q")).first()
    assert [(x.points, x.item[:2]) for x in r.n] == [(3, "1."), (2, "3."), (5, "4．")]
    assert [(x.dimension, x.points) for x in r.s] == [("一、格式", 5), ("二、 事实", 8)]
    assert [(x.dimension, x.points, x.item) for x in r.p] == [("plain", 10, "plain")] and r.q == 7
    assert [(x.dimension, x.points, x.item) for x in r.t] == [("Document Rubric", 2, "总分5分")]
    rows = [(2, "q2", "ctx", "", [("要点（4分）", "事实认定", ""), ("y", "结论", "3.0")]), (1, "q1", "ctx", "lab", [("z", None, None)]), (3, "q3", "", "", [])]
    bank = spark.createDataFrame(rows, "no int, question string, context string, label string, rubrics array<struct<criterion:string,tags:string,points:string>>")
    made = case_bank.import_benchmark(bank, "case_analysis", "PB-CASE", "pb", "no", 2, {"label": "实务案例"})
    assert [(r.sample_id, r.user_question, r.legal_concepts) for r in made["eval_input"].orderBy("sample_id").collect()] == [("PB-CASE-001", "q1", "lab"), ("PB-CASE-002", "q2", "实务案例")]
    assert [(r.rubric_id, r.rubric_dimension, r.max_score, r.criticality) for r in made["rubric_items"].orderBy("rubric_id").collect()] == [("PB-CASE-001-R01", "Case Analysis", 5, "high"), ("PB-CASE-002-R01", "Legal Facts", 4, "high"), ("PB-CASE-002-R02", "Case Conclusion", 3, "high")]
    talks = spark.createDataFrame([(1, "talk", numbered)], "no int, conversation string, rubrics string")
    asked = case_bank.import_benchmark(talks, "consultation", "PB-CONS", "pb", "no", 5)
    assert asked["eval_input"].first().known_facts == "talk" and asked["rubric_items"].count() == 3 and asked["sample_metadata"].first().human_review_required == "yes"


def test_package_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3"\n4\n5,6,7\n')
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    import hashlib

    right = hashlib.sha256((tmp_path / "b.csv").read_bytes()).hexdigest()
    got = datasets.file_errors(spark, str(tmp_path), {"a.csv": "0", "b.csv": right, "c.csv": "0"})
    assert {tuple(r) for r in got.collect()} == {("a.csv", "hash mismatch"), ("c.csv", "missing file")}
    assert [(r.file.rsplit("/", 1)[-1], r.n_rows) for r in datasets.width_errors(spark, str(tmp_path)).collect()] == [("a.csv", 2)]
    df = spark.createDataFrame([("1", "secret")], "id string, note string")
    got = datasets.table_errors(df, "t", ["id", "gone"], ["note"], least=2, private="secret")
    assert {r.message for r in got.collect()} == {"missing column gone", "restricted column note", "unexpected number of rows: 1", "private data in 1 rows"}
    assert datasets.table_errors(df, "t", ["id"], most=1).count() == 0


def test_commands_over_folders(spark, tmp_path):
    sheet(tmp_path, "Eval_Input", "sample_id,user_question", "s1,why")
    sheet(tmp_path, "Gold_Labels", "sample_id,key_missing_facts", "s1,f1")
    sheet(tmp_path, "Rubric_Items", "sample_id,rubric_id", "s1,R1")
    assert cli.main(["prepare-data", "--workbook", str(tmp_path), "--source", "core", "--output", str(tmp_path / "out")]) == 0
    made = spark.read.option("header", True).csv(str(tmp_path / "out" / "eval_input"))
    assert [r.user_question for r in made.collect()] == ["why"]
    bad = tmp_path / "manifest.json"
    bad.write_text('{"files": {"gone.csv": {"sha256": "0"}}}')
    with pytest.raises(SystemExit, match="gone.csv"):
        cli.main(["check-package", "--folder", str(tmp_path), "--manifest", str(bad), "--output", str(tmp_path / "o")])
