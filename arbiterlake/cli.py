"""Command line: each command reads tables by path, applies operators and writes a table.

``python -m arbiterlake.cli release-gate --runs r.csv --scores s.csv --routing t.csv --output out``. Inputs end in
``.csv``, ``.jsonl``/``.json`` or are Parquet; outputs are CSV folders, or Parquet if they end in ``.parquet``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assets, calibration, cases, claims, dashboard, execution, judging, markers, regression, releases, reports, retrieval, routing, traces
from .sources import datasets, sinks, tables, workbook
from .sources.scratch import materialize


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by path; ``book.xlsx#Sheet`` is a sheet of a workbook."""
    if ".xlsx#" in path.lower():
        return workbook.read_sheet(spark, *path.rsplit("#", 1))
    if path.endswith(".csv"):
        return tables.read_csv(spark, path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str) -> None:
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        sinks.write_csv(df, path)


def must_be_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(20).collect()
    if found:
        raise SystemExit(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in found))


def _write_back(t):
    made, broken = routing.review_write_back(t["routing"], t["adjudications"])
    must_be_empty(broken, "invalid adjudications")
    return made


def _summarize(t):
    runs, scores, routed = routing.output_status(t["runs"]), t["scores"], t["routing"]
    return {
        "kpis": dashboard.kpis(runs, scores, routed), "dataset_coverage": dashboard.coverage(runs), "task_summary": dashboard.task_summary(scores, routed),
        "version_summary": dashboard.version_summary(scores, runs), "cost_latency": dashboard.cost_latency(runs), "deployment_policy": dashboard.deployment_policy(scores, routed, runs),
        "route_summary": dashboard.route_summary(routed), "policy_summary": dashboard.policy_summary(routed), "model_patterns": dashboard.model_patterns(scores),
        "score_delta": dashboard.score_delta(scores), "badcases": dashboard.badcase_cards(routed, scores), "runs": runs, "scores": scores, "routing": routed,
    }


def _mock_runs(t):
    plan = t["plan"]
    styles = ("It depends on", "The answer concerns", "More facts are needed on", "Review is advised for")
    call = lambda df: df.withColumns({
        "answer": execution.mock_answer(F.concat_ws("|", F.col("run_id").cast("string"), "version"), F.col("prompt"), styles), "error": F.lit(""),
        "input_tokens": execution.estimated_tokens(F.col("prompt")), "output_tokens": F.lit(16),
    })
    return execution.execute_plan(plan, t["samples"], call, "{user_question}\n{context}\n{base_answer}")


def _entailment(t):
    """With the pack of markers that ``--markers`` names; without one every claim is open to review.

    ``--rag-only yes`` leaves out runs without contexts, ``--cases`` names the cases whose ``allowed_sources`` bound the citations.
    """
    runs, allowed = t["runs"], None
    pack = markers.load_pack(runs.sparkSession, t["markers"], claims.Markers) if t.get("markers") else claims.Markers(reviewable=("",))
    if t.get("rag_only") in ("yes", "true", "1"):
        runs = runs.join(t["contexts"].select("run_id").distinct(), "run_id", "left_semi")
    if t.get("cases"):
        bounds = load(runs.sparkSession, t["cases"]).select(F.col("case_id").cast("string").alias("case_id"), F.col("allowed_sources").alias("allowed_source_ids"))
        allowed = runs.select("run_id", F.col("sample_id").cast("string").alias("case_id")).join(bounds, "case_id").select("run_id", "allowed_source_ids")
    return claims.entailment(claims.split_claims(runs).select("run_id", "claim_index", "claim"), t["contexts"], pack, allowed)


def _release(t):
    made, wrong = releases.build_release(t["assets"], "release", *(t[n] for n in ("memberships", "corrections", "reviews", "adjudications", "checks", "bindings", "assertions", "versions")))
    must_be_empty(wrong, "invalid release")
    return made


def _validate_cases(t):
    errors = cases.case_errors(t["cases"], ("case_id", "user_prompt"), {})
    must_be_empty(errors, "invalid cases")
    return t["cases"].groupBy().count()


def _all(t):
    """From recorded runs with their judge's raw output to scores, routing, gate and dashboard."""
    runs = routing.output_status(t["runs"])
    judged = judging.judge_pass(runs)
    scores = judged.select(
        *(c for c in ("run_id", "sample_id", "source_dataset", "task_category", "model_alias", "version") if c in judged.columns), "total_score", "max_score", "score_rate",
        F.to_json("error_tags").alias("error_tags"), "risk_level", "judge_confidence", "needs_human_review", "parsed_ok", "run_status",
    )
    scores = materialize(scores)  # three branches read it
    routed = routing.route(scores)
    sheets = _summarize({"runs": runs, "scores": scores, "routing": routed})
    return {**sheets, "release_gate": routing.in_gate_order(routing.release_gate(runs, scores)), "review_sheet": calibration.in_sheet_order(calibration.review_sample(calibration.review_base(scores, routed)))}


def _retrieve(t):
    queries = t["samples"].select(F.col("sample_id").alias("query_id"), retrieval.query_text().alias("query"))
    corpus = tables.load_corpus(t["corpus"])
    return retrieval.retrieve(queries, corpus.withColumn("doc", retrieval.document_text()), boost=True)


def _validate_release(t):
    counts = {r["asset_type"]: r["wanted"] for r in t["expected"].select("asset_type", F.col("wanted").cast("long").alias("wanted")).collect()}  # one row a type
    errors = assets.release_errors(t["assets"], t["members"], t["qa"], counts)
    must_be_empty(errors, "invalid release")
    return assets.release_metrics(assets.reviewer_conflicts(t["reviews"]), t["qa"])


def _apply_bundle(t):
    must_be_empty(assets.bundle_errors(t["pending"], t["decisions"]), "invalid decisions")
    return t["pending"].join(t["decisions"], "asset_id")


def _upgrade(t):
    made, missing = regression.revise_assertions(t["registry"], t["aliases"])
    must_be_empty(missing, "assets without assertion")
    return made


def _rescore(t):
    made, missing = regression.score_runs(t["logs"], t["registry"], t["results"])
    must_be_empty(missing, "logs without assertion")
    return made


def _decide(t):
    must_be_empty(releases.decision_errors(t["pending"], t["decisions"]), "invalid decisions")
    return releases.expert_events(t["decisions"], releases.current_corrections(t["corrections"], t["candidates"]), t["reviews"])


def _bind(t):
    made, wrong = releases.bind_approvals(t["submissions"], t["corrections"], t["reviews"], t["candidates"])
    must_be_empty(wrong, "approvals that cannot be bound")
    return made


def _settle(t):
    made, wrong = releases.adjudicate(t["reviews"], releases.current_corrections(t["corrections"], t["candidates"]), t["adjudications"])
    must_be_empty(wrong, "assets without both reviews")
    return made


def _blind(t, role):
    made, wrong = releases.review_events(t["answers"], releases.current_corrections(t["corrections"], t["candidates"]), role)
    must_be_empty(wrong, "answers without an object")
    return made


def _draft(t):
    made, wrong = releases.draft_corrections(t["candidates"], t["corrections"], t["answers"])
    must_be_empty(wrong, "blank answers")
    return made


def _replace(t):
    made, wrong = releases.replacements(t["wanted"], t["reviewed"], t["runs"])
    must_be_empty(wrong, "cases without an answer")
    return made


def _mock_traces(t):
    call = lambda df: df.withColumns({"answer": execution.mock_answer(F.col("trace_id"), F.col("user_message"), ("It depends on", "Please tell me about", "Review is advised for")), "error": F.lit("")})
    return traces.run_traces(t["cases"], t["models"], call, "{history}\n{message}")


def _check_package(spark, a):
    said = datasets.read_config(spark, a["manifest"]).get("files") or {}
    hashes = {n: m["sha256"] for n, m in said.items() if isinstance(m, dict) and "sha256" in m}
    must_be_empty(datasets.file_errors(spark, a["folder"], hashes), "invalid package")
    must_be_empty(datasets.width_errors(spark, a["folder"]), "rows that do not fit their header")
    return spark.createDataFrame([(a["folder"], len(hashes))], "folder string, files int")


#: command -> (arguments, function of the session and the arguments), for commands that read folders or take values
FOLDER_COMMANDS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "prepare-data": (("workbook", "source"), lambda s, a: datasets.build_dataset(s, a["workbook"], a["source"])),
    "prepare-practice-benchmark": (("items", "kind", "prefix", "source", "order", "limit"), lambda s, a: cases.import_benchmark(load(s, a["items"]), a["kind"], a["prefix"], a["source"], a["order"], int(a["limit"]))),
    "validate": (("manifest",), lambda s, a: datasets.load_dataset(s, a["manifest"])),
    "check-package": (("folder", "manifest"), _check_package),
}

#: command -> (input tables, function of the loaded tables)
COMMANDS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "validate-cases": (("cases",), _validate_cases),
    "prepare-cases": (("cases",), lambda t: cases.import_cases(t["cases"])),
    "run-models": (("plan", "samples"), _mock_runs),
    "run-judge": (("payloads",), lambda t: judging.normalize_payload(t["payloads"])),
    "run-judge-ensemble": (("scores",), lambda t: {"summary": judging.ensemble_summary(t["scores"]), "disagreement": judging.disagreement(t["scores"])}),
    "route-data": (("scores",), lambda t: routing.route(t["scores"])),
    "apply-review-adjudications": (("routing", "adjudications"), _write_back),
    "summarize": (("runs", "scores", "routing"), _summarize),
    "sample-human-review": (("scores", "routing"), lambda t: calibration.review_sample(calibration.review_base(t["scores"], t["routing"]))),
    "summarize-human-calibration": (("reviewed",), lambda t: calibration.calibration_summary(t["reviewed"])),
    "release-gate": (("runs", "scores", "routing", "claims"), lambda t: routing.release_gate(t["runs"], t["scores"], t["routing"], t["claims"])),
    "build-claim-entailment": (("runs", "contexts"), _entailment),
    "merge-model-outputs": (("first", "second"), lambda t: sinks.merge_shards([t["first"], t["second"]], ["run_id"])),
    "retrieval-report": (("table",), lambda t: reports.workflow_comparison(t["table"])),
    "trace-report": (("traces",), lambda t: traces.trace_metrics(t["traces"])),
    "build-asset-candidates": (("rows",), lambda t: assets.choose_candidates(t["rows"], 5)),
    "build-independent-regression-candidates": (("candidates", "used"), lambda t: assets.independent_candidates(t["candidates"], t["used"])),
    "adjudicate-assets": (("reviews",), lambda t: assets.reviewer_conflicts(t["reviews"])),
    "run-asset-qa": (("corrections", "candidates"), lambda t: assets.quality_checks(t["corrections"], t["candidates"])),
    "split-assets": (("assets",), lambda t: assets.assign_split(t["assets"])),
    "build-dataset-release": (("assets", "memberships", "corrections", "reviews", "adjudications", "checks", "bindings", "assertions", "versions"), _release),
    "check-contamination": (("train", "test"), lambda t: assets.contamination(t["train"], t["test"])),
    "replay-states": (("events",), lambda t: assets.replay(t["events"])),
    "run-asset-regression": (("outputs",), lambda t: assets.evaluate_assertions(t["outputs"])),
    "all": (("runs",), _all),
    "judge-runs": (("runs",), lambda t: judging.judge_pass(t["runs"])),
    "retrieve-contexts": (("samples", "corpus"), _retrieve),
    "claim-rates": (("claims",), lambda t: routing.claim_rates(t["claims"])),
    "build-expert-review-bundle": (("states", "corrections", "candidates"), lambda t: assets.review_bundle(t["states"], t["corrections"], t["candidates"])),
    "apply-expert-review-bundle": (("pending", "decisions"), _apply_bundle),
    "validate-dataset-release": (("assets", "members", "qa", "reviews", "expected"), _validate_release),
    "upgrade-regression-assertions": (("registry", "aliases"), _upgrade),
    "rescore-regression": (("logs", "registry", "results"), _rescore),
    "audit-assertions": (("logs", "registry"), lambda t: regression.assertion_audit(t["logs"], t["registry"])),
    "refresh-release": (("metrics", "results"), lambda t: dict(zip(("metrics", "revisions"), regression.refresh_metrics(t["metrics"], t["results"])))),
    "validate-traces": (("cases",), lambda t: traces.trace_case_errors(t["cases"], ("case_id", "initial_user_message"), ("blocked", "human_review_required", "candidate_limited_release"))),
    "run-traces": (("cases", "models"), _mock_traces),
    "trace-evidence": (("traces", "turns"), lambda t: traces.evidence(t["traces"], t["turns"])),
    "draft-corrections": (("candidates", "corrections", "answers"), _draft),
    "run-blind-review-a": (("answers", "corrections", "candidates"), lambda t: _blind(t, "reviewer_a")),
    "run-blind-review-b": (("answers", "corrections", "candidates"), lambda t: _blind(t, "reviewer_b")),
    "settle-adjudications": (("reviews", "corrections", "candidates", "adjudications"), _settle),
    "finalize-assets": (("pending", "decisions", "corrections", "candidates", "reviews"), _decide),
    "backfill-asset-lineage": (("submissions", "corrections", "reviews", "candidates"), _bind),
    "requeue-incomplete-corrections": (("candidates", "corrections"), lambda t: releases.requeue(t["candidates"], t["corrections"])),
    "build-replacement-candidates": (("wanted", "reviewed", "runs"), _replace),
    "release-figures": (("members", "reviews", "adjudications", "states", "checks"), lambda t: reports.long_metrics(releases.release_figures(t["members"], t["reviews"], t["adjudications"], t["states"], t["checks"]))),
    "rescore-topics": (("outputs",), lambda t: assets.topic_results(t["outputs"])),
}


#: Files that a command may also read, by option.
OPTIONS = {"build-claim-entailment": ("markers", "rag_only", "cases")}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="arbiterlake")
    commands = made.add_subparsers(dest="command", required=True)
    for name, (inputs, _) in {**COMMANDS, **FOLDER_COMMANDS}.items():
        one = commands.add_parser(name)
        for table in inputs:
            one.add_argument(f"--{table}", required=True)
        for option in OPTIONS.get(name, ()):
            one.add_argument(f"--{option.replace('_', '-')}")
        one.add_argument("--output", required=True)
    return made


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"arbiterlake {args.command}").getOrCreate()
    if args.command in FOLDER_COMMANDS:
        inputs, run = FOLDER_COMMANDS[args.command]
        made = run(spark, {t: getattr(args, t) for t in inputs})
    else:
        inputs, run = COMMANDS[args.command]
        made = run({t: load(spark, getattr(args, t)) for t in inputs} | {o: getattr(args, o) for o in OPTIONS.get(args.command, ())})
    if isinstance(made, dict) and args.output.lower().endswith(".xlsx"):
        sinks.write_dashboard(made, args.output)
    elif isinstance(made, dict):
        for name, df in made.items():
            save(df, f"{args.output}/{name}")
    else:
        save(made, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
