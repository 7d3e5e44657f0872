"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vs
from ..operators import assets, calibration, cases, claims, dashboard, execution, judging, markers, regression, releases, reports, retrieval, routing, traces
from ..sources import sinks, snapshots, workbook
from ..sources.scratch import fresh_folder
from . import driver_tables as dt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL of the same rows and column names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rel(spark, sf_dir, sql):
    return dt.relation(spark, sf_dir, sql)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark, sf_dir):
    return routing.output_status(_rel(spark, sf_dir, dt.RUNS))


def _routed(spark, sf_dir):
    return routing.route(_rel(spark, sf_dir, dt.SCORES))


def _rate(part: str, whole: str, scale: int = 10000) -> str:
    """The quotient, rounded by its exact binary value."""
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE CAST(format('{{:.{len(str(scale)) - 1}f}}', ({part})::DOUBLE / ({whole})::DOUBLE) AS DOUBLE) END"


def _mean(total: str, n: str, places: int, unit: int = 1) -> str:
    """Mean of whole numbers over ``unit``, half up."""
    return f"CAST((2 * ({total}) * {10**places} + {unit} * ({n})) // (2 * {unit} * ({n})) AS DOUBLE) / {10**places}"


RUNS, SCORES, CLAIMS, REVIEWS, STATES, ASSETS = (dt.text(x) for x in (dt.RUNS, dt.SCORES, dt.CLAIMS, dt.REVIEWS, dt.STATES, dt.ASSETS))

#: Tags of a score row as a list of names; unknown ones renamed as the router does.
_NAMES = "list_transform(CAST(json(error_tags) AS JSON[]), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.coarse_error_tag') ELSE json_extract_string(x, '$') END)"
_KNOWN = f"list_transform({_NAMES}, lambda x: CASE WHEN x IN {vs.COARSE_TAGS} THEN x ELSE 'needs_human_review' END)"


def _routed_sql(source: str) -> str:
    """Every score row of ``source`` with its decision."""
    return f"""
(WITH t AS (SELECT *, {_KNOWN} AS tags FROM {source} source),
f AS (SELECT *, list_has_any(tags, ['fabricated_citation', 'unsafe_action_suggestion']) OR run_status = 'failed' AS blocking,
  risk_level = 'high' OR judge_confidence = 'low' OR needs_human_review = 'True' OR parsed_ok = 'no' AS review,
  coalesce(list_filter({list(routing.PRIORITY)}, lambda p: list_contains(tags, p))[1], 'no_detected_error') AS main FROM t)
SELECT run_id, sample_id, task_category, model_alias, version, score_rate, risk_level, error_tags, tags,
  CASE WHEN blocking THEN 'block' WHEN review THEN 'human_review' WHEN list_contains(tags, 'missing_facts') THEN 'clarify'
    WHEN retrieval_status = 'hit' OR list_has_any(tags, ['missing_evidence_warning', 'unverified_basis']) THEN 'grounded_answer' ELSE 'auto_answer' END AS response_policy,
  CASE WHEN blocking OR review THEN CASE WHEN run_status = 'failed' AND main = 'no_detected_error' THEN 'run_failed' ELSE main END
    WHEN list_contains(tags, 'overclaim') THEN 'overclaim' WHEN list_contains(tags, 'missing_facts') THEN 'missing_facts'
    WHEN list_contains(tags, 'missing_evidence_warning') THEN 'missing_evidence_warning' WHEN list_contains(tags, 'weak_fact_rule_application') THEN 'weak_fact_rule_application' ELSE main END AS main_error_type,
  CASE WHEN blocking OR review THEN 'human_review' WHEN list_contains(tags, 'overclaim') THEN CASE WHEN score_rate < 0.66 THEN 'badcase' ELSE 'preference' END
    WHEN list_contains(tags, 'missing_facts') THEN CASE WHEN score_rate < 0.75 THEN 'sft' ELSE 'eval' END
    WHEN list_contains(tags, 'missing_evidence_warning') THEN 'sft' ELSE 'eval' END AS data_route,
  list_filter(['eval', 'sft', 'preference', 'badcase', 'regression'], lambda r:
    (r IN ('badcase', 'regression') AND list_has_any(tags, ['fabricated_citation', 'unsafe_action_suggestion', 'unverified_basis', 'needs_human_review']))
    OR (r IN ('preference', 'regression') AND list_contains(tags, 'overclaim'))
    OR (r = 'sft' AND list_has_any(tags, ['missing_facts', 'missing_evidence_warning', 'missing_procedure_warning']))
    OR (r = 'eval' AND (list_has_any(tags, ['weak_fact_rule_application', 'jurisdiction_risk']) OR len(tags) = 0))) AS asset_routes
FROM f)
"""


_ROUTED = _routed_sql(SCORES)
_STATUS = "CASE response_policy WHEN 'block' THEN 'blocked' WHEN 'human_review' THEN 'pending_review' ELSE 'released' END"
_PRIORITY = "CASE WHEN response_policy IN ('block', 'human_review') OR risk_level = 'high' THEN 'P0' WHEN risk_level = 'medium' THEN 'P1' ELSE 'P2' END"

_SUMMARY = f"""
SELECT run_id, count(*) AS claim_entailment_rows, count_if(reviewable_legal_claim = 'yes') AS reviewable_claim_count,
  count_if(reviewable_legal_claim = 'yes' AND entailment_label IN {routing.STRICT_LABELS}) AS reviewable_strict_citation_defect_count,
  count_if(reviewable_legal_claim = 'yes' AND entailment_label IN {routing.ISSUE_LABELS}) AS citation_gate_issue_count,
  count_if(entailment_label IN {routing.BLOCKER_LABELS}) AS claim_entailment_release_blocker_count,
  count_if(entailment_label = 'supported') AS supported_claim_count, count_if(entailment_label = 'out_of_scope_source') AS out_of_scope_source_count
FROM {CLAIMS} GROUP BY run_id
"""


@query(_SUMMARY)
def claim_summary(spark, sf_dir):
    made = routing.claim_summary(_rel(spark, sf_dir, dt.CLAIMS))
    return made.select("run_id", "claim_entailment_rows", "reviewable_claim_count", "reviewable_strict_citation_defect_count", "citation_gate_issue_count", "claim_entailment_release_blocker_count", "supported_claim_count", "out_of_scope_source_count")


@query(f"""
WITH m AS (SELECT s.*, {_NAMES} AS names, r.response_policy, u.model_vendor, u.model_family, u.workflow_condition, u.workflow_name,
  coalesce(c.claim_entailment_rows, 0) AS n_claims, coalesce(c.reviewable_claim_count, 0) AS n_open, coalesce(c.citation_gate_issue_count, 0) AS n_issue,
  coalesce(c.claim_entailment_release_blocker_count, 0) AS n_block, coalesce(c.out_of_scope_source_count, 0) AS n_scope
  FROM {SCORES} s JOIN (SELECT run_id, response_policy FROM {_ROUTED}) r USING (run_id) JOIN {RUNS} u USING (run_id) LEFT JOIN ({_SUMMARY}) c USING (run_id)),
g AS (SELECT task_category, model_vendor, model_family, model_alias, workflow_condition, workflow_name, count(*) AS runs,
  count_if(list_contains(names, 'fabricated_citation')) AS fabricated_citation_count, count_if(list_contains(names, 'unsafe_action_suggestion')) AS unsafe_action_count,
  count_if(list_has_any(names, ['fabricated_citation', 'unsafe_action_suggestion']) OR response_policy = 'block' OR n_block > 0 OR (risk_level = 'high' AND response_policy NOT IN ('human_review', 'block'))) AS n_critical,
  count_if(response_policy = 'human_review') AS n_review, count_if(response_policy = 'block') AS n_blocked, count_if(list_contains(names, 'overclaim')) AS n_over,
  count_if(parsed_ok = 'no') AS n_unparsed, sum(n_claims)::BIGINT AS claim_entailment_rows, sum(n_open)::BIGINT AS reviewable_claim_count, sum(n_issue)::BIGINT AS citation_gate_issue_count,
  sum(n_block)::BIGINT AS claim_entailment_release_blocker_count, sum(n_scope)::BIGINT AS out_of_scope_source_count FROM m GROUP BY ALL),
r AS (SELECT *, {_rate('n_critical', 'runs')} AS critical_failure_rate, {_rate('n_review', 'runs')} AS human_review_rate, {_rate('n_blocked', 'runs')} AS blocked_response_rate,
  {_rate('n_over', 'runs')} AS overclaim_rate, {_rate('n_unparsed', 'runs')} AS judge_parse_failure_rate, {_rate('citation_gate_issue_count', 'greatest(reviewable_claim_count, 1)')} AS citation_gate_issue_rate FROM g)
SELECT task_category, model_vendor, model_family, model_alias, workflow_condition, workflow_name, runs, critical_failure_rate, fabricated_citation_count, unsafe_action_count,
  human_review_rate, blocked_response_rate, overclaim_rate, judge_parse_failure_rate, claim_entailment_rows, reviewable_claim_count, citation_gate_issue_count, citation_gate_issue_rate,
  claim_entailment_release_blocker_count, out_of_scope_source_count,
  concat_ws('; ', CASE WHEN fabricated_citation_count > 0 THEN 'fabricated citation/legal basis' END, CASE WHEN unsafe_action_count > 0 THEN 'unsafe action suggestion' END,
    CASE WHEN judge_parse_failure_rate > 0.02 THEN 'judge parse failure above 2%' END, CASE WHEN blocked_response_rate > 0 THEN 'one or more response rows are blocked' END,
    CASE WHEN claim_entailment_release_blocker_count > 0 THEN 'claim-level citation release blocker' END, CASE WHEN out_of_scope_source_count > 0 THEN 'source-boundary citation failure' END) AS blockers
FROM r
""")
def release_gate(spark, sf_dir):
    """Flagship: per-run claim counts, three-way join and one decision per task, model and workflow."""
    made = routing.release_gate(_rel(spark, sf_dir, dt.RUNS), _rel(spark, sf_dir, dt.SCORES), None, _rel(spark, sf_dir, dt.CLAIMS))
    return made.select(
        *routing.GATE_KEYS, "runs", "critical_failure_rate", "fabricated_citation_count", "unsafe_action_count", "human_review_rate", "blocked_response_rate", "overclaim_rate",
        "judge_parse_failure_rate", "claim_entailment_rows", "reviewable_claim_count", "citation_gate_issue_count", "citation_gate_issue_rate",
        "claim_entailment_release_blocker_count", "out_of_scope_source_count", "blockers",
    )


_COUNTS = {
    "claim_entailment_rows": "count(*)", "reviewable_claim_count": "count_if(open)", "reviewable_strict_citation_defect_count": f"count_if(open AND l IN {routing.STRICT_LABELS})",
    **dict.fromkeys(("reviewable_claim_needs_review_count", "citation_gate_issue_count", "reviewable_citation_issue_count"), f"count_if(open AND l IN {routing.ISSUE_LABELS})"),
    **dict.fromkeys(("claim_entailment_release_blocker_count", "all_claim_source_boundary_blocker_count"), f"count_if(l IN {routing.BLOCKER_LABELS})"),
    **{c: f"count_if(l = '{name}')" for c, name in (
        ("supported_claim_count", "supported"), ("partially_supported_claim_count", "partially_supported"), ("unsupported_claim_entailment_count", "unsupported"), ("no_citation_claim_count", "no_citation"),
        ("out_of_scope_source_count", "out_of_scope_source"), ("fabricated_claim_citation_count", "fabricated_citation"), ("contradicted_claim_count", "contradicted"))},
}
_ALL_COUNTS = f"SELECT run_id, {', '.join(f'{v} AS {k}' for k, v in _COUNTS.items())} FROM (SELECT run_id, reviewable_legal_claim = 'yes' AS open, entailment_label AS l FROM {CLAIMS}) GROUP BY run_id"
_GATE_SHARES = {
    "critical_failure_rate": f"list_has_any(names, ['fabricated_citation', 'unsafe_action_suggestion']) OR response_policy = 'block' OR claim_entailment_release_blocker_count > 0 OR (risk_level = 'high' AND response_policy NOT IN ('human_review', 'block'))",
    "high_risk_rate": "risk_level = 'high'", "human_review_rate": "response_policy = 'human_review'", "blocked_response_rate": "response_policy = 'block'", "grounded_answer_rate": "response_policy = 'grounded_answer'",
    "overclaim_rate": "list_contains(names, 'overclaim')", "missing_evidence_warning_rate": "list_contains(names, 'missing_evidence_warning')",
    "weak_fact_rule_application_rate": "list_contains(names, 'weak_fact_rule_application')", "judge_parse_failure_rate": "parsed_ok = 'no'", "parsed_ok_rate": "parsed_ok = 'yes'",
}


@query(f"""
WITH m AS (SELECT s.*, {_NAMES} AS names, r.response_policy, u.model_vendor, u.model_family, u.workflow_condition, u.workflow_name, u.latency_ms, {', '.join(f'coalesce(c.{k}, 0) AS {k}' for k in _COUNTS)}
  FROM {SCORES} s JOIN (SELECT run_id, response_policy FROM {_ROUTED}) r USING (run_id) JOIN {RUNS} u USING (run_id) LEFT JOIN ({_ALL_COUNTS}) c USING (run_id)),
g AS (SELECT task_category, model_vendor, model_family, model_alias, workflow_condition, workflow_name, count(*) AS runs, {_mean('sum(run_id * 7 % 101)', 'count(*)', 4, 100)} AS avg_score_rate,
  {', '.join(f'{_rate(f"count_if({v})", "count(*)")} AS {k}' for k, v in _GATE_SHARES.items())},
  count_if(list_contains(names, 'fabricated_citation')) AS fabricated_citation_count, count_if(list_contains(names, 'unsafe_action_suggestion')) AS unsafe_action_count,
  count_if(task_category = 'consultation' AND risk_level = 'high' AND response_policy NOT IN ('human_review', 'block')) AS high_risk_consultation_not_reviewed_count,
  {', '.join(f'sum({k})::BIGINT AS {k}' for k in _COUNTS)}, {_mean('sum(latency_ms)', 'count(*)', 2)} AS avg_latency_ms, sum(run_id % 97)::DOUBLE / 1000 AS total_estimated_cost FROM m GROUP BY 1, 2, 3, 4, 5, 6),
r AS (SELECT *, {_rate('reviewable_strict_citation_defect_count', 'greatest(reviewable_claim_count, 1)')} AS reviewable_strict_citation_defect_rate, {_rate('citation_gate_issue_count', 'greatest(reviewable_claim_count, 1)')} AS citation_gate_issue_rate FROM g),
b AS (SELECT *, concat_ws('; ', CASE WHEN fabricated_citation_count > 0 THEN 'fabricated citation/legal basis' END, CASE WHEN unsafe_action_count > 0 THEN 'unsafe action suggestion' END,
    CASE WHEN judge_parse_failure_rate > 0.02 THEN 'judge parse failure above 2%' END, CASE WHEN high_risk_consultation_not_reviewed_count > 0 THEN 'high-risk consultation not routed to human_review' END,
    CASE WHEN blocked_response_rate > 0 THEN 'one or more response rows are blocked' END, CASE WHEN claim_entailment_release_blocker_count > 0 THEN 'claim-level citation release blocker' END,
    CASE WHEN out_of_scope_source_count > 0 THEN 'source-boundary citation failure' END) AS blockers,
  concat_ws('; ', CASE WHEN human_review_rate > 0.35 THEN 'narrow auto-answer scope or improve escalation calibration' END, CASE WHEN overclaim_rate > 0.10 THEN 'build preference pairs for overclaim control' END,
    CASE WHEN missing_evidence_warning_rate > 0.15 THEN 'add evidence-risk SFT examples' END, CASE WHEN weak_fact_rule_application_rate > 0.15 THEN 'add case-analysis eval and reasoning examples' END,
    CASE WHEN citation_gate_issue_rate > 0.15 THEN 'improve claim-level citation coverage and entailment' END) AS required_mitigations FROM r),
d AS (SELECT *, CASE WHEN blockers <> '' THEN 'blocked' WHEN critical_failure_rate = 0 AND blocked_response_rate = 0 AND human_review_rate <= 0.15 AND avg_score_rate >= 0.8 AND parsed_ok_rate >= 0.98 THEN 'candidate_auto_answer'
  ELSE 'limited_release' END AS release_gate_decision FROM b)
SELECT *, release_gate_decision AS release_decision FROM d
""")
def release_gate_full(spark, sf_dir):
    """All measures, blockers, mitigations and the decision."""
    return routing.release_gate(_rel(spark, sf_dir, dt.RUNS), _rel(spark, sf_dir, dt.SCORES), None, _rel(spark, sf_dir, dt.CLAIMS))


@query(f"""
SELECT run_id, sample_id, task_category, model_alias, version, main_error_type, risk_level, {_STATUS} AS workflow_status, response_policy,
  array_to_string(asset_routes, ',') AS data_asset_routes, data_route, {_PRIORITY} AS priority, len(tags) > 0 OR response_policy IN ('block', 'human_review', 'clarify') AS requires_correction FROM {_ROUTED}
""")
def route_scores(spark, sf_dir):
    made = _routed(spark, sf_dir)
    return made.select("run_id", "sample_id", "task_category", "model_alias", "version", "main_error_type", "risk_level", "workflow_status", "response_policy", F.array_join("data_asset_routes", ",").alias("data_asset_routes"), "data_route", "priority", "requires_correction")


@query(f"""
SELECT run_id, CASE WHEN run_status = 'failed' THEN 'failed' ELSE 'completed' END AS api_call_status, trim(output_text) <> '' AS has_nonempty_output,
  CASE WHEN run_status = 'failed' THEN 'not_available' WHEN trim(output_text) = '' THEN 'empty' ELSE 'nonempty' END AS content_status,
  CASE WHEN run_status = 'failed' THEN 'failed' WHEN trim(output_text) = '' THEN 'empty_output' ELSE 'ok' END AS run_status,
  CASE WHEN run_status <> 'failed' AND trim(output_text) = '' AND error_message = '' THEN 'API call completed but returned empty answer content' ELSE error_message END AS error_message FROM {RUNS}
""")
def output_status(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "api_call_status", "has_nonempty_output", "content_status", "run_status", "error_message")


@query("""
WITH m AS (SELECT DISTINCT p_brand AS model_alias FROM part), v AS (SELECT unnest(['V0', 'V3']) AS version), w AS (SELECT unnest(['V1', 'V2']) AS version)
SELECT concat_ws('-', 'RUN', n_nationkey, model_alias, version) AS run_id, n_nationkey AS sample_id, model_alias, version, 'full' AS run_scope FROM nation, m, v
UNION ALL SELECT concat_ws('-', 'RUN', n_nationkey, model_alias, version), n_nationkey, model_alias, version, 'deep' FROM nation, m, w WHERE n_regionkey = 1
""")
def run_plan(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "sample_id")
    models = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_alias")).distinct()
    return routing.run_plan(nation, models, ["V0", "V3"], ["V0", "V1", "V2", "V3"], ["V0", "V3"], nation.filter("n_regionkey = 1"))


@query(f"""
SELECT sample_id, model_alias, avg(score_rate) FILTER (version = 'V0') AS first_score, avg(score_rate) FILTER (version = 'V3') AS second_score,
  avg(score_rate) FILTER (version = 'V3') - avg(score_rate) FILTER (version = 'V0') AS delta FROM (SELECT * REPLACE (score_rate::DECIMAL(9,2)::DOUBLE AS score_rate) FROM {SCORES} ORDER BY run_id) GROUP BY 1, 2
""")
def score_delta(spark, sf_dir):
    return dashboard.score_delta(_rel(spark, sf_dir, dt.SCORES))


_TAGS = f"(SELECT task_category, model_alias, run_id, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS tag FROM (SELECT *, {_NAMES} AS names FROM {SCORES}))"


@query(f"""
SELECT task_category, tag, tag_count, tag_rank FROM (SELECT *, row_number() OVER (PARTITION BY task_category ORDER BY tag_count DESC, first_row, first_pos) AS tag_rank FROM
  (SELECT task_category, tag, count(*) AS tag_count, min(run_id * 100 + pos) // 100 AS first_row, min(run_id * 100 + pos) % 100 AS first_pos FROM {_TAGS} GROUP BY 1, 2)) WHERE tag_rank <= 3
""")
def top_error_tags(spark, sf_dir):
    return dashboard.top_tags(_rel(spark, sf_dir, dt.SCORES), "task_category")


@query(f"SELECT source_dataset, task_category, count(DISTINCT sample_id) AS samples, count(run_id) AS runs FROM {RUNS} GROUP BY 1, 2")
def dataset_coverage(spark, sf_dir):
    return dashboard.coverage(_rel(spark, sf_dir, dt.RUNS))


@query(f"""
WITH v AS (SELECT version, {_mean('sum(run_id * 7 % 101)', 'count(*)', 3, 100)} AS avg_score_rate, {_rate("count_if(risk_level = 'high')", 'count(*)', 1000)} AS high_risk_rate, {_rate("count_if(needs_human_review = 'True')", 'count(*)', 1000)} AS human_review_rate FROM {SCORES} GROUP BY 1)
SELECT * FROM v LEFT JOIN (SELECT DISTINCT version, workflow_condition, workflow_name FROM {RUNS}) USING (version)
""")
def version_summary(spark, sf_dir):
    return dashboard.version_summary(_rel(spark, sf_dir, dt.SCORES), _rel(spark, sf_dir, dt.RUNS))


def _top_tags(key: str) -> str:
    return f"""SELECT {key}, string_agg(tag, ', ' ORDER BY tag_rank) AS top_error_tags, coalesce(string_agg(action, '; ' ORDER BY tag_rank) FILTER (action IS NOT NULL), '') AS data_action FROM
  (SELECT *, CASE tag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dashboard.ACTIONS.items())} END AS action, row_number() OVER (PARTITION BY {key} ORDER BY tag_count DESC, first_place) AS tag_rank FROM
    (SELECT {key}, tag, count(*) AS tag_count, min(run_id * 100 + pos) AS first_place FROM {_TAGS} GROUP BY 1, 2)) WHERE tag_rank <= 3 GROUP BY 1"""


_MEASURES = f"""count(DISTINCT sample_id) AS samples, count(*) AS runs, {_mean('sum(run_id * 7 % 101)', 'count(*)', 3, 100)} AS avg_score_rate,
  {_rate("count_if(risk_level = 'high')", 'count(*)', 1000)} AS high_risk_rate, {_rate("count_if(needs_human_review = 'True')", 'count(*)', 1000)} AS human_review_rate"""


@query(f"""
WITH b AS (SELECT task_category, {_MEASURES} FROM {SCORES} GROUP BY 1),
p AS (SELECT task_category, string_agg(concat(response_policy, ':', n), '; ' ORDER BY response_policy) AS response_policy_mix FROM (SELECT task_category, response_policy, count(*) AS n FROM {_ROUTED} GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM b LEFT JOIN ({_top_tags('task_category')}) USING (task_category) LEFT JOIN p USING (task_category)
""")
def task_summary(spark, sf_dir):
    return dashboard.task_summary(_rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir))


@query(f"""
SELECT task_category, model_alias, version, workflow_condition, workflow_name, count(*) AS runs, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms, CAST(sum(estimated_cost::DECIMAL(18,6)) AS DOUBLE) AS total_estimated_cost
FROM {RUNS} GROUP BY ALL
""")
def cost_latency(spark, sf_dir):
    runs = _rel(spark, sf_dir, dt.RUNS)
    keys = ["task_category", "model_alias", "version", "workflow_condition", "workflow_name"]
    made = dashboard.cost_latency(runs).select(*keys, "runs", "total_estimated_cost")
    return made.join(runs.groupBy(*keys).agg(F.sum("latency_ms").alias("total_latency_ms")), keys)


@query(f"""
SELECT task_category, model_alias, version, workflow_condition, workflow_name, count(*) AS runs, round(CAST(sum(estimated_cost::DECIMAL(18,6)) AS DOUBLE), 6) AS total_estimated_cost FROM {RUNS} GROUP BY ALL
""")
def dashboard_workbook(spark, sf_dir):
    """The dashboard's summaries written as one workbook, and a sheet of it read back."""
    runs, scores, routed = _runs(spark, sf_dir), _rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir)
    keys = ["task_category", "model_alias", "version", "workflow_condition", "workflow_name"]
    sheets = {
        "Dataset_Coverage": dashboard.coverage(runs), "Task_Category_Summary": dashboard.task_summary(scores, routed), "Version_Summary": dashboard.version_summary(scores),
        "Cost_Latency": dashboard.cost_latency(runs).select(*keys, "runs", "total_estimated_cost"), "Data_Routing_Summary": dashboard.route_summary(routed), "Response_Policy": dashboard.policy_summary(routed),
    }
    path = f"{fresh_folder(spark)}.xlsx"
    workbook.write_workbook(sheets, path)
    return workbook.read_sheet(spark, path, "Cost_Latency").withColumn("total_estimated_cost", F.round(F.col("total_estimated_cost").cast("double"), 6))


@query(f"""
WITH b AS (SELECT s.task_category, u.workflow_condition, u.workflow_name, s.risk_level, r.response_policy FROM {SCORES} s JOIN (SELECT run_id, response_policy FROM {_ROUTED}) r USING (run_id) JOIN {RUNS} u USING (run_id)),
g AS (SELECT task_category, workflow_condition, workflow_name, count(*) AS runs, {_rate("count_if(risk_level = 'high')", 'count(*)')} AS high_risk_rate,
  {_rate("count_if(response_policy = 'human_review')", 'count(*)')} AS human_review_rate, {_rate("count_if(response_policy = 'block')", 'count(*)')} AS blocked_response_rate FROM b GROUP BY 1, 2, 3)
SELECT *, CASE WHEN high_risk_rate <= 0.05 AND human_review_rate <= 0.15 THEN 'candidate for auto-answer only if critical checks pass'
  WHEN high_risk_rate >= 0.2 THEN 'route to human review or stronger workflow before release' ELSE 'limited release with monitoring and targeted data production' END AS policy_hint FROM g
""")
def deployment_policy(spark, sf_dir):
    made = dashboard.deployment_policy(_rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir), _rel(spark, sf_dir, dt.RUNS))
    return made.select("task_category", "workflow_condition", "workflow_name", "runs", "high_risk_rate", "human_review_rate", "blocked_response_rate", "policy_hint")


@query(f"""
SELECT data_route, task_category, count(run_id) AS count, array_to_string(list_sort(list_distinct(list(CAST(sample_id AS VARCHAR))))[1:5], ', ') AS example_sample_ids FROM {_ROUTED} GROUP BY 1, 2
""")
def route_summary(spark, sf_dir):
    return dashboard.route_summary(_routed(spark, sf_dir))


@query(f"SELECT {_STATUS} AS workflow_status, response_policy, count(*) AS count FROM {_ROUTED} GROUP BY 1, 2")
def policy_summary(spark, sf_dir):
    return dashboard.policy_summary(_routed(spark, sf_dir))


@query(f"SELECT data_asset_route, task_category, count(*) AS count FROM (SELECT task_category, unnest(asset_routes) AS data_asset_route FROM {_ROUTED}) GROUP BY 1, 2")
def asset_route_summary(spark, sf_dir):
    return dashboard.asset_route_summary(_routed(spark, sf_dir))


@query(f"""
SELECT model_alias, human_review_rate, coalesce(top_error_tags, '') AS dominant_error_patterns FROM (SELECT model_alias, {_rate("count_if(needs_human_review = 'True')", 'count(*)', 1000)} AS human_review_rate FROM {SCORES} GROUP BY 1)
LEFT JOIN ({_top_tags('model_alias')}) USING (model_alias)
""")
def model_patterns(spark, sf_dir):
    return dashboard.model_patterns(_rel(spark, sf_dir, dt.SCORES))


@query(f"""
WITH s AS (SELECT count(DISTINCT sample_id) AS total_samples, count(DISTINCT task_category) AS total_task_categories, 1::BIGINT AS total_source_datasets, {_mean("sum(run_id * 7 % 101) FILTER (version = 'V0')", "count_if(version = 'V0')", 3, 100)} AS avg_v0_score,
  {_mean("sum(run_id * 7 % 101) FILTER (version = 'V3')", "count_if(version = 'V3')", 3, 100)} AS avg_v3_score, {_rate("count_if(risk_level = 'high')", 'count(*)', 1000)} AS high_risk_rate FROM {SCORES}),
u AS (SELECT count(*) AS total_runs, count(*) AS total_api_run_rows, count_if(trim(output_text) <> '') AS nonempty_answer_count, count_if(trim(output_text) = '') AS empty_answer_count, {_mean('sum(latency_ms)', 'count(*)', 1)} AS avg_latency_ms,
  sum(run_id % 97)::DOUBLE / 1000 AS total_estimated_cost FROM {RUNS}),
r AS (SELECT count_if(response_policy = 'human_review') AS human_review_queue_size, count_if(response_policy = 'block') AS blocked_response_count FROM {_ROUTED}),
e AS (SELECT round(avg(d), 3) AS avg_score_delta FROM (SELECT avg(score_rate) FILTER (version = 'V3') - avg(score_rate) FILTER (version = 'V0') AS d FROM {SCORES} GROUP BY sample_id, model_alias)),
t AS (SELECT top_error_tags AS top_3_error_tags, data_action AS recommended_data_actions FROM ({_top_tags('every')}))
SELECT *, '{dashboard.BOUNDARY}' AS dashboard_boundary FROM s, u, r, e, t
""".replace(f"FROM {_TAGS} GROUP BY 1, 2", f"FROM (SELECT *, 1 AS every FROM {_TAGS}) GROUP BY 1, 2"))
def dashboard_kpis(spark, sf_dir):
    return dashboard.kpis(_runs(spark, sf_dir), _rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir))


_CARDS = f"""
WITH RECURSIVE j AS (SELECT r.*, {_PRIORITY} AS priority, coalesce(list_position(['block', 'human_review', 'clarify', 'grounded_answer', 'auto_answer'], response_policy), 6) AS pr FROM {_ROUTED} r),
b AS MATERIALIZED (SELECT *, concat(sample_id, '|', version, '|', response_policy) AS k, row_number() OVER (ORDER BY pr, task_category, priority, score_rate, sample_id, version, model_alias, run_id) AS n FROM j),
cells AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kind, o) AS no, * FROM (
  SELECT 1 AS kind, (pr - 1) * 3 + list_position(['consultation', 'case_analysis', 'document_drafting'], task_category) AS o, concat(response_policy, '/', task_category) AS cell FROM b GROUP BY ALL
  UNION ALL SELECT 2, min(n), concat(response_policy, '/', main_error_type) FROM b GROUP BY 3)),
m AS MATERIALIZED (SELECT c.no, c.kind, b.k, min(b.n) AS n FROM cells c JOIN b ON c.cell = CASE c.kind WHEN 1 THEN concat(response_policy, '/', task_category) ELSE concat(response_policy, '/', main_error_type) END GROUP BY 1, 2, 3),
g AS (SELECT 0::BIGINT AS step, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS ns, CAST([] AS INT[]) AS ps
  UNION ALL SELECT g.step + 1, CASE WHEN min(m.n) IS NULL THEN g.ks ELSE list_append(g.ks, min_by(m.k, m.n)) END, CASE WHEN min(m.n) IS NULL THEN g.ns ELSE list_append(g.ns, min(m.n)) END,
    CASE WHEN min(m.n) IS NULL THEN g.ps ELSE list_append(g.ps, any_value(c.kind)) END
  FROM g JOIN cells c ON c.no = g.step + 1 LEFT JOIN m ON m.no = c.no AND NOT list_contains(g.ks, m.k) GROUP BY g.step, g.ks, g.ns, g.ps),
e AS MATERIALIZED (SELECT * FROM g ORDER BY step DESC LIMIT 1),
p12 AS (SELECT unnest(ns) AS n, unnest(ps) AS phase, generate_subscripts(ns, 1) AS card_no FROM e),
p3 AS (SELECT n, 3 AS phase, row_number() OVER (ORDER BY n) + (SELECT count(*) FROM p12) AS card_no FROM (SELECT k, min(n) AS n FROM b WHERE NOT list_contains((SELECT ks FROM e), k) GROUP BY k) QUALIFY card_no <= 80),
p4 AS (SELECT n, 4 AS phase, row_number() OVER (ORDER BY n) + (SELECT count(*) FROM p12) + (SELECT count(*) FROM p3) AS card_no FROM b WHERE n NOT IN (SELECT n FROM p12) AND n NOT IN (SELECT n FROM p3) QUALIFY card_no <= 80)
SELECT run_id, sample_id, version, task_category, response_policy, main_error_type, priority, score_rate AS score, phase, card_no::INT AS card_no FROM b JOIN (SELECT * FROM p12 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) USING (n)
"""


@query(_CARDS)
def badcase_cards(spark, sf_dir):
    return dashboard.badcase_cards(_routed(spark, sf_dir), _rel(spark, sf_dir, dt.SCORES))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query(f"SELECT doc_id, len({_WORDS}) AS n_tokens, len(list_distinct({_WORDS})) AS n_distinct, len(list_filter(list_distinct({_WORDS}), lambda w: length(w) > 1)) AS n_content FROM documents")
def tokenize(spark, sf_dir):
    words = tx.tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"), F.size(tx.content_tokens(F.col("text"))).alias("n_content"))


def _corpus(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("doc"))


@query(f"""
WITH d AS (SELECT doc_id AS source_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, greatest(sum(len(w)) / greatest(count(*), 1), 1.0) AS avgdl FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS token FROM benchmark),
t AS (SELECT source_id, len(w) AS len, token, count(*) AS tf FROM (SELECT source_id, w, unnest(w) AS token FROM d) GROUP BY 1, 2, 3, w),
f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
x AS (SELECT query_id, source_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))), 6) AS score FROM q JOIN t USING (token) JOIN f USING (token), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM x)
SELECT query_id, rank, source_id, round(score, 3) AS score FROM r WHERE rank <= 4
""")
def bm25_top_k(spark, sf_dir):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.retrieve(queries, _corpus(spark, sf_dir), top_k=4).select("query_id", "rank", "source_id", F.round("bm25_score", 3).alias("score"))


#: Boosts by source type for the driver's languages.
TYPE_RULES = ((("en",), ("the",), 0.25), (("de", "fr"), ("und", "de"), 0.2))


@query(f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, lang, {_WORDS} AS w, list_filter(regexp_split_to_array(lower(regexp_replace(substr(text, 1, 12), '^\\s+|\\s+$', '', 'g')), '[;；,\\s]+'), lambda t: t <> '') AS tags FROM documents),
s AS (SELECT count(*) AS n, greatest(sum(len(w)) / greatest(count(*), 1), 1.0) AS avgdl FROM d),
q AS (SELECT item_id AS query_id, text AS query, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS low FROM benchmark), k AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS token FROM benchmark),
t AS (SELECT source_id, len(w) AS len, token, count(*) AS tf FROM (SELECT source_id, w, unnest(w) AS token FROM d) GROUP BY 1, 2, 3, w), f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
x AS (SELECT query_id, source_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))), 6) AS score FROM k JOIN t USING (token) JOIN f USING (token), s GROUP BY 1, 2),
b AS (SELECT query_id, source_id, coalesce(score, 0) AS score, round(0.12 * len(list_filter(tags, lambda t: contains(low, t))) + CASE WHEN contains(low, source_id) THEN 2.0 ELSE 0.0 END
  + CASE WHEN lang = 'en' AND contains(query, 'the') THEN 0.25 ELSE 0.0 END + CASE WHEN lang IN ('de', 'fr') AND (contains(query, 'und') OR contains(query, 'de')) THEN 0.2 ELSE 0.0 END, 6) AS boost FROM q CROSS JOIN d LEFT JOIN x USING (query_id, source_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score + boost, 6) DESC, source_id) AS rank FROM b WHERE round(score + boost, 6) >= 3)
SELECT query_id, rank, source_id, boost AS metadata_boost, round(score + boost, 3) AS score FROM r WHERE rank <= 4
""")
def boosted_retrieval(spark, sf_dir):
    """BM25 plus the boosts of tags, ids and source types; sources below the minimum score are left out."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    corpus = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("doc"), F.left("text", F.lit(12)).alias("tags"), F.col("lang").alias("source_type"))
    made = retrieval.retrieve(queries, corpus, top_k=4, min_score=3.0, boost=True, rules=TYPE_RULES)
    return made.select("query_id", "rank", "source_id", "metadata_boost", F.round("retrieval_score", 3).alias("score"))


@query(r"""
SELECT doc_id AS run_id, idx AS claim_index, regexp_replace(regexp_replace(part, '^[ \-0-9.、:：]+', ''), '[ \-0-9.、:：]+$', '') AS claim FROM
 (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\n。；;!?！？]+'), lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) >= 8) AS parts FROM documents))
""")
def split_claims(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("output_text"))
    return claims.split_claims(docs).select("run_id", "claim_index", "claim")


@query(r"""
WITH t AS (SELECT conv_id, string_agg(role || chr(10) || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1)
SELECT conv_id AS run_id, idx AS claim_index, regexp_replace(regexp_replace(part, '^[ \-0-9.、:：]+', ''), '[ \-0-9.、:：]+$', '') AS claim FROM
 (SELECT conv_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx FROM
  (SELECT conv_id, list_filter(regexp_split_to_array(regexp_replace(said, '^\s+|\s+$', '', 'g'), '[\n。；;!?！？]+'), lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) >= 8) AS parts FROM t))
""".replace("\\\\", "\\"))
def nested_json_claims(spark, sf_dir):
    """Claims of whole conversations, each one nested JSON document."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    nested = F.to_json(F.struct(F.lit(1).alias("version"), F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("who"), F.struct(F.array(t["text"]).alias("text: said")).alias("what"))).alias("turns")))
    return claims.split_claims(turns.select(F.col("conv_id").alias("run_id"), nested.alias("output_text"))).select("run_id", "claim_index", "claim")


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark)
SELECT doc_id, term, (position(term IN lower(text)) - 1)::INT AS start FROM documents, v WHERE contains(lower(text), term)
""")
def marker_hits(spark, sf_dir):
    """The first place of every long benchmark word in every document, inside longer words too."""
    terms = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return markers.marker_hits(docs, terms, "doc_id", "low", every=False)


#: Marker packs for the driver's invented prose: frequent words of its languages.
PACK = claims.Markers(reviewable=("the", "de", "und"), exempt=("http",), conditional=("if", "si"), limiting=("without",), asserting=("with",), denying=("not",))
TRACE_PACK = traces.TracePack(challenge=("not", "no"), review=("review", "the"), redirect=("for",), promises=("always", "ver ", "ie"), negations=("not", "en"), scoped_negations=("th",))


_CLAIMED = r"""(SELECT doc_id AS run_id, idx AS claim_index, regexp_replace(regexp_replace(part, '^[ \-0-9.、:：]+', ''), '[ \-0-9.、:：]+$', '') AS claim FROM
 (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\n。；;!?！？]+'), lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) >= 8) AS parts FROM documents)))"""
_CONTENT = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda w: length(w) > 1))"
_CITED = r"""list_sort(list_distinct(list_concat(regexp_extract_all(claim, '\[([A-Z][A-Z0-9_-]{2,})\]', 1), regexp_extract_all(claim, '(?:^|[^A-Z0-9_-])([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)(?:$|[^A-Z0-9_-])', 1))))"""
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"""
WITH c AS (SELECT *, {_CONTENT('claim')} AS words, {_CITED} AS cited FROM {_CLAIMED}),
j AS (SELECT c.*, b.item_id, b.text AS source, {_CONTENT("coalesce(b.text, '')")} AS held, concat('SRC-', b.item_id) AS id FROM c LEFT JOIN benchmark b ON c.run_id = b.item_id),
s AS (SELECT *, item_id IS NOT NULL AND (len(cited) = 0 OR list_contains(cited, id)) AS checked, NOT {_ANY('claim', ('http',))} AND {_ANY('claim', ('the', 'de', 'und'))} AS open,
  CASE WHEN len(held) = 0 THEN 0.0 ELSE {_rate('len(list_intersect(words, held))', 'len(words)', 1000)} END AS score FROM j),
l AS (SELECT *, CASE WHEN len(list_filter(cited, lambda x: item_id IS NULL OR x <> id)) > 0 THEN 'fabricated_citation' WHEN NOT open THEN 'not_reviewable' WHEN len(cited) = 0 THEN 'no_citation'
  WHEN checked AND NOT contains(claim, 'without') AND contains(claim, 'with') AND contains(source, 'not') THEN 'contradicted' WHEN score >= 0.45 THEN 'supported' WHEN score >= 0.25 THEN 'partially_supported'
  WHEN {_ANY('claim', ('if', 'si'))} AND score >= 0.12 THEN 'partially_supported' ELSE 'unsupported' END AS entailment_label FROM s)
SELECT run_id, claim_index, open AS reviewable_legal_claim, CASE WHEN checked THEN id ELSE '' END AS best_source_id, score AS support_score, entailment_label,
  CASE entailment_label {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in claims.PRODUCT_ACTIONS.items())} ELSE 'not_applicable' END AS product_action FROM l
""")
def claim_entailment(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("run_id"), F.col("text").alias("output_text"))
    queries = _table(spark, sf_dir, "benchmark").select((F.col("item_id")).alias("run_id"), F.concat(F.lit("SRC-"), F.col("item_id").cast("string")).alias("source_id"), "text")
    return claims.entailment(claims.split_claims(texts).select("run_id", "claim_index", "claim"), queries, PACK).select("run_id", "claim_index", "reviewable_legal_claim", "best_source_id", "support_score", "entailment_label", "product_action")


@query(r"""
SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, length(text) >= 200 AND position(right(t, 1) IN '.。!！?？)）]】"”''’`}') = 0 AS unterminated
FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
""")
def text_checks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.array_contains(tx.pii_kinds(F.col("text")), "email").alias("has_email"), F.array_contains(tx.completeness_issues(F.col("text")), "no_terminal_punctuation").alias("unterminated")
    )


@query(f"""
SELECT count(*) AS total_review_rows, count_if(human_pass_fail <> '' OR human_critical_failure <> '' OR human_route_override <> '') AS completed_review_rows, count_if(judge_human_agreement <> '') AS agreement_labeled_rows,
  {_rate("count_if(judge_human_agreement = 'agree')", "count_if(judge_human_agreement <> '')", 1000)} AS judge_human_agreement_rate, {_rate("count_if(auto_triage_label = adjudicated_triage_label)", 'count(*)', 1000)} AS judge_adjudicated_agreement_rate,
  count_if(human_critical_failure = 'Yes') AS confirmed_critical_failure_count, count_if(human_route_override = 'block') AS human_route_override_count,
  count_if(reviewer_a_triage_label <> '' AND reviewer_b_triage_label <> '') AS reviewer_pair_labeled_rows FROM {REVIEWS}
""")
def calibration_summary(spark, sf_dir):
    made = calibration.calibration_summary(_rel(spark, sf_dir, dt.REVIEWS))
    return made.select("total_review_rows", "completed_review_rows", "agreement_labeled_rows", "judge_human_agreement_rate", "judge_adjudicated_agreement_rate", "confirmed_critical_failure_count", "human_route_override_count", "reviewer_pair_labeled_rows")


@query(f"""
WITH p AS (SELECT reviewer_a_triage_label AS a, reviewer_b_triage_label AS b FROM {REVIEWS} WHERE reviewer_a_triage_label <> '' AND reviewer_b_triage_label <> ''),
t AS (SELECT count(*) AS n, count_if(a = b) AS same FROM p), l AS (SELECT a, count(*) AS na FROM p GROUP BY 1), r AS (SELECT b, count(*) AS nb FROM p GROUP BY 1),
e AS (SELECT coalesce(sum(na * nb), 0)::DOUBLE AS products FROM l JOIN r ON a = b)
SELECT n AS pairs, round(same / n, 6) AS observed_agreement, round((same::DOUBLE * n - products) / (n::DOUBLE * n - products), 6) AS kappa FROM t, e
""")
def reviewer_kappa(spark, sf_dir):
    made = calibration.agreement(_rel(spark, sf_dir, dt.REVIEWS), "reviewer_a_triage_label", "reviewer_b_triage_label")
    return made.select("pairs", F.round("observed_agreement", 6).alias("observed_agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"""
WITH b AS (SELECT *, list_has_any({_NAMES}, ['fabricated_citation', 'unsafe_action_suggestion', 'needs_human_review']) OR risk_level = 'high' OR judge_confidence = 'low' OR needs_human_review = 'True' AS due FROM {SCORES})
SELECT run_id, 'critical_failure' AS review_bucket FROM b WHERE due
""")
def review_sample(spark, sf_dir):
    """Rows that must be reviewed; with the default rate they exceed the target, so no sampled rows join them."""
    return calibration.review_sample(calibration.review_base(_rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir))).select("run_id", "review_bucket")


@query(f"""
WITH b AS (SELECT s.run_id, s.task_category, s.model_alias, s.risk_level, r.response_policy, list_has_any({_NAMES}, ['fabricated_citation', 'unsafe_action_suggestion', 'needs_human_review']) OR s.risk_level = 'high' OR s.judge_confidence = 'low'
  OR s.needs_human_review = 'True' AS due, sha256(concat('42|', s.run_id)) AS h FROM {SCORES} s JOIN (SELECT run_id, response_policy FROM {_ROUTED}) r USING (run_id)),
g AS (SELECT greatest(1, ceil(50.0 / count(*))) AS share FROM (SELECT DISTINCT task_category, model_alias, risk_level FROM b WHERE NOT due)),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_category, model_alias, risk_level ORDER BY h, run_id) AS no FROM b WHERE NOT due), g WHERE no <= share ORDER BY h, run_id LIMIT 50)
SELECT run_id, 'critical_failure' AS review_bucket, response_policy AS auto_triage_label FROM b WHERE due UNION ALL SELECT run_id, 'random_calibration', response_policy FROM x
""")
def review_sample_random(spark, sf_dir):
    base = calibration.review_base(_rel(spark, sf_dir, dt.SCORES), _routed(spark, sf_dir))
    return calibration.review_sample(base, random_min=50).select("run_id", "review_bucket", "auto_triage_label")


def _judged(spark, sf_dir):
    scores = _rel(spark, sf_dir, dt.SCORES)
    first = scores.withColumns({"judge_model_alias": F.lit("judge a"), "judge_order": F.lit(0), "judge_role": F.lit("primary")})
    second = scores.withColumns({
        "judge_model_alias": F.lit("judge b"), "judge_order": F.lit(1), "judge_role": F.lit("primary"), "score_rate": (F.col("run_id") * 11 % 101).cast("double") / 100,
        "error_tags": F.when(F.col("run_id") % 6 == 0, '[{"coarse_error_tag":"fabricated_citation"}]').otherwise(F.col("error_tags")),
    })
    return first.unionByName(second)


_SECOND = f"""(SELECT * REPLACE (CAST(run_id * 11 % 101 AS DOUBLE) / 100 AS score_rate, CASE WHEN run_id % 6 = 0 THEN '[{{"coarse_error_tag":"fabricated_citation"}}]' ELSE error_tags END AS error_tags) FROM {SCORES})"""
_BOTH = f"""
(SELECT a.run_id, a.risk_level, a.response_policy AS policy, a.data_route AS route, a.asset_routes AS routes_a, b.asset_routes AS routes_b, a.response_policy = 'block' OR b.response_policy = 'block' AS blocked,
  round(abs(CAST(a.run_id * 7 % 101 AS DOUBLE) / 100 - CAST(a.run_id * 11 % 101 AS DOUBLE) / 100), 3) AS score_gap, (a.run_id * 7 % 101 + a.run_id * 11 % 101) * 5 / 1000 AS score,
  concat_ws('|', CASE WHEN round(abs(CAST(a.run_id * 7 % 101 AS DOUBLE) / 100 - CAST(a.run_id * 11 % 101 AS DOUBLE) / 100), 3) >= 0.2 THEN 'score_gap' END,
    CASE WHEN list_sort(list_distinct(list_intersect(a.tags, {list(judging.CRITICAL)}))) <> list_sort(list_distinct(list_intersect(b.tags, {list(judging.CRITICAL)}))) THEN 'critical_failure_mismatch' END,
    CASE WHEN a.response_policy <> b.response_policy THEN 'response_policy_mismatch' END) AS reasons
 FROM {_ROUTED} a JOIN {_routed_sql(_SECOND)} b USING (run_id))
"""


@query(f"SELECT run_id, 2 AS primary_judge_count, score_gap, reasons AS disagreement_reasons, reasons <> '' AS requires_arbitration FROM {_BOTH}")
def judge_disagreement(spark, sf_dir):
    return judging.disagreement(_judged(spark, sf_dir))


@query(f"""
WITH p AS (SELECT *, CASE WHEN blocked THEN 'block' WHEN reasons <> '' THEN 'human_review' ELSE policy END AS final FROM {_BOTH})
SELECT run_id, CASE WHEN reasons <> '' THEN 'needs_human_calibration' ELSE 'stable' END AS ensemble_status, score AS final_score_rate, risk_level AS final_risk_level,
  CASE final WHEN 'block' THEN 'blocked' WHEN 'human_review' THEN 'pending_review' ELSE 'released' END AS final_workflow_status, final AS final_response_policy,
  array_to_string(list_filter({list(vs.ASSET_ROUTES)}, lambda r: list_contains(routes_a, r) OR list_contains(routes_b, r)), ',') AS final_data_asset_routes,
  CASE WHEN final IN ('human_review', 'block') THEN 'human_review' ELSE route END AS final_data_route, reasons <> '' AS requires_arbitration, final IN ('human_review', 'block') OR reasons <> '' AS requires_human_calibration,
  reasons AS disagreement_reasons FROM p
""")
def ensemble_summary(spark, sf_dir):
    made = judging.ensemble_summary(_judged(spark, sf_dir))
    return made.withColumn("final_data_asset_routes", F.array_join("final_data_asset_routes", ","))


_RAW = """CASE WHEN run_id % 7 = 0 THEN 'no object here' WHEN run_id % 7 = 1 THEN 'so: {"risk_level": "HIGH", "error_tags": ["overclaim", {"coarse_error_tag": "odd"}], "needs_human_review": "yes"} end'
  ELSE '{"dimension_scores": {"risk_coverage": 2, "legal_grounding": 9, "overclaim_control": -1}, "atomic_scores": [{"rubric_id": "R1", "score": 3, "max_score": 2}], "judge_confidence": "low", "judge_reason": " fine "}' END"""


@query(f"""
WITH j AS (SELECT run_id, run_status, {_RAW} AS raw FROM {RUNS}), c AS (SELECT run_id, CASE WHEN run_status <> 'ok' THEN 'failed' WHEN run_id % 7 = 0 THEN 'unparsed' WHEN run_id % 7 = 1 THEN 'tags' ELSE 'scores' END AS kind FROM j)
SELECT run_id, CASE kind WHEN 'scores' THEN 6 ELSE 0 END AS total_score, CASE kind WHEN 'scores' THEN 20 ELSE 18 END AS max_score, CASE kind WHEN 'scores' THEN 0.3 ELSE 0.0 END AS score_rate,
  'high' AS risk_level, CASE kind WHEN 'tags' THEN 'medium' ELSE 'low' END AS judge_confidence, kind <> 'scores' AS needs_human_review,
  CASE kind WHEN 'failed' THEN 'model run failed before judging' WHEN 'unparsed' THEN 'judge output parse failed' WHEN 'tags' THEN '' ELSE 'fine' END AS judge_reason,
  CASE kind WHEN 'failed' THEN 'needs_human_review:model_run_failed' WHEN 'unparsed' THEN 'needs_human_review:judge_parse_failed' WHEN 'tags' THEN 'overclaim:,needs_human_review:non_standard_error_tag' ELSE '' END AS tags,
  kind <> 'unparsed' AS parsed_ok FROM c
""")
def judge_pass(spark, sf_dir):
    """Score rows from raw judge outputs: failed runs, outputs without an object, clipped scores."""
    made = judging.judge_pass(_rel(spark, sf_dir, dt.RUNS).select("run_id", "run_status").withColumn("raw_judge_output", F.expr(_RAW)))
    tags = F.array_join(F.transform("error_tags", lambda t: F.concat_ws(":", t["coarse_error_tag"], t["error_subtype"])), ",")
    return made.select("run_id", "total_score", "max_score", "score_rate", "risk_level", "judge_confidence", "needs_human_review", "judge_reason", tags.alias("tags"), "parsed_ok")


@query(f"""
WITH c AS (SELECT *, reviewable_legal_claim = 'yes' AS open, run_id % 3 = 0 AS cited FROM {CLAIMS})
SELECT run_id, count(*) AS claim_entailment_rows, count_if(open AND cited) AS cited_reviewable_claim_count, {_rate('count_if(open AND cited)', 'count_if(open)')} AS citation_coverage_rate,
  {_rate(f'count_if(open AND entailment_label IN {routing.ISSUE_LABELS})', 'count_if(open)')} AS citation_gate_issue_rate, {_rate(f'count_if(entailment_label IN {routing.BLOCKER_LABELS})', 'count(*)')} AS all_claim_source_boundary_blocker_rate
FROM c GROUP BY run_id
""")
def claim_rates(spark, sf_dir):
    claims_ = _rel(spark, sf_dir, dt.CLAIMS).withColumn("cited_source_ids", F.when(F.col("run_id") % 3 == 0, '["SRC-1"]').otherwise("[]"))
    return routing.claim_rates(claims_).select("run_id", "claim_entailment_rows", "cited_reviewable_claim_count", "citation_coverage_rate", "citation_gate_issue_rate", "all_claim_source_boundary_blocker_rate")


@query(f"""
SELECT run_id, coalesce(b, 0) AS all_claim_source_boundary_blocker_count, coalesce(i, 0) AS reviewable_claim_needs_review_count, needs_human_review, score_rate FROM {SCORES}
LEFT JOIN (SELECT run_id, count_if(entailment_label IN {routing.BLOCKER_LABELS}) AS b, count_if(reviewable_legal_claim = 'yes' AND entailment_label IN {routing.ISSUE_LABELS}) AS i FROM {CLAIMS} GROUP BY 1) USING (run_id)
ORDER BY 2 DESC, 3 DESC, needs_human_review DESC, score_rate, run_id LIMIT 20
""")
def worst_samples(spark, sf_dir):
    counts = ("all_claim_source_boundary_blocker_count", "reviewable_claim_needs_review_count")
    rows = _rel(spark, sf_dir, dt.SCORES).join(routing.claim_summary(_rel(spark, sf_dir, dt.CLAIMS)), "run_id", "left").na.fill(0, list(counts))
    return reports.worst_samples(rows).select("run_id", *counts, "needs_human_review", "score_rate")


@query("""
SELECT conv_id AS trace_id, turn AS turn_index, count(*) OVER w AS n_before, coalesce(string_agg(role, ',') OVER w, '') AS roles_before FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def turn_history(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))
    return traces.history(turns, traces.told(turns)).select("trace_id", "turn_index", F.size("history").cast("long").alias("n_before"), F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("roles_before"))


_BARE = lambda p: f"""len(list_filter(list_transform(range(1, len(string_split(t, '{p}'))), lambda i: {{'b': regexp_replace(right(array_to_string(string_split(t, '{p}')[1:i], '{p}'), 48), '(?s)^.*[.!?;\\n。！？；]', ''),
  'a': substr(t, length(array_to_string(string_split(t, '{p}')[1:i], '{p}')) + {len(p) + 1}, 4)}}), lambda x: NOT {_ANY(f"(right(x.b, 12) || '{p}' || x.a)", TRACE_PACK.negations)} AND NOT {_ANY('x.b', TRACE_PACK.scoped_negations)})) > 0"""  # noqa: E731


@query(f"""
WITH m AS (SELECT conv_id AS trace_id, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1),
f AS (SELECT *, (CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'und') THEN 1 ELSE 0 END)::INT AS hits, trace_id % 2 <> 0 OR {_ANY('t', TRACE_PACK.challenge)} AS challenged, {_ANY('t', TRACE_PACK.review)} AS recommended,
  {' OR '.join(_BARE(p) for p in TRACE_PACK.promises)} AS over FROM m)
SELECT trace_id, hits AS material_fact_hit_count, hits / 2 AS material_fact_coverage, challenged AS bad_premise_challenged, recommended AS human_review_recommended, over AS lexical_overclaim_flag,
  CASE WHEN over OR NOT challenged THEN 'blocked' WHEN trace_id % 3 = 0 OR recommended THEN 'human_review_required' ELSE 'candidate_limited_release' END AS trace_review_recommendation,
  hits >= 2 AND NOT over AND challenged AND (trace_id % 3 <> 0 OR recommended) AS deterministic_trace_triage_flag FROM f
""")
def trace_evaluation(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    agent = talks.filter("role = 'assistant'").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("turn_index"), F.col("text").alias("agent_message"))
    made = traces.trace_texts(agent).withColumns({
        "facts": F.array(F.lit("the"), F.lit("und")), "bad_premises": F.when(F.col("trace_id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "expects_review": F.col("trace_id") % 3 == 0,
    })
    return traces.evaluate_traces(made, TRACE_PACK).select("trace_id", "material_fact_hit_count", "material_fact_coverage", "bad_premise_challenged", "human_review_recommended", "lexical_overclaim_flag", "trace_review_recommendation", "deterministic_trace_triage_flag")


_ALLOWED = " OR ".join(f"(from_status = '{a}' AND to_status IN ({', '.join(repr(b) for b in bs)}))" for a, bs in assets.TRANSITIONS.items() if bs)


@query(f"""
SELECT asset_id, seq, from_status, to_status, {_ALLOWED} AS allowed FROM (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY asset_id ORDER BY seq), 'proposed') AS from_status FROM {STATES})
""")
def state_replay(spark, sf_dir):
    return assets.replay(_rel(spark, sf_dir, dt.STATES)).select("asset_id", "seq", "from_status", "to_status", "allowed")


@query(f"SELECT asset_id, seq, to_status FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq DESC) AS no FROM {STATES}) WHERE no = 1")
def latest_state(spark, sf_dir):
    return assets.latest(_rel(spark, sf_dir, dt.STATES), "asset_id", "seq").select("asset_id", "seq", "to_status")


@query(f"SELECT asset_id, seq, row_number() OVER w AS event_no, lag(to_status) OVER w AS previous_to_status FROM {STATES} WINDOW w AS (PARTITION BY asset_id ORDER BY seq)")
def event_numbers(spark, sf_dir):
    events = assets.numbered(_rel(spark, sf_dir, dt.STATES), "asset_id", "seq", "event_no")
    return assets.previous(events, "asset_id", "seq", "to_status").select("asset_id", "seq", "event_no", "previous_to_status")


_PRINTED = f"(SELECT asset_id, split, source_case_id, source_snapshot_id, sha256(regexp_replace(lower(text), '\\s', '', 'g')) AS h FROM {ASSETS})"


@query(f"""
WITH l AS (SELECT asset_id, split, unnest(['source_snapshot_id', 'normalized_user_prompt_hash']) AS field, unnest([source_snapshot_id, h]) AS value FROM {_PRINTED})
SELECT a.asset_id AS train_asset_id, b.asset_id AS test_asset_id, array_to_string(list_sort(list(DISTINCT field)), ',') AS matching_signals
FROM l a JOIN l b USING (field, value) WHERE a.split = 'train' AND b.split = 'test' AND value <> '' GROUP BY 1, 2
""")
def split_contamination(spark, sf_dir):
    rows = _rel(spark, sf_dir, dt.ASSETS).withColumn("normalized_user_prompt_hash", tx.prompt_hash(F.col("text")))
    fields = ("source_snapshot_id", "normalized_user_prompt_hash")
    made = assets.contamination(rows.filter("split = 'train'"), rows.filter("split = 'test'"), fields)
    return made.withColumn("matching_signals", F.array_join("matching_signals", ","))


@query(f"""
WITH l AS (SELECT asset_id, split, unnest(['source_case_id', 'source_snapshot_id', 'normalized_user_prompt_hash']) AS field, unnest([source_case_id, source_snapshot_id, h]) AS value FROM {_PRINTED})
SELECT field, value, count(DISTINCT asset_id) FILTER (split = 'train') AS train_assets, count(DISTINCT asset_id) FILTER (split = 'test') AS test_assets, min(asset_id) FILTER (split = 'train') AS first_train_asset_id,
  min(asset_id) FILTER (split = 'test') AS first_test_asset_id FROM l WHERE value <> '' GROUP BY 1, 2 HAVING count_if(split = 'train') > 0 AND count_if(split = 'test') > 0
""")
def shared_fingerprints(spark, sf_dir):
    rows = _rel(spark, sf_dir, dt.ASSETS).withColumn("normalized_user_prompt_hash", tx.prompt_hash(F.col("text")))
    fields = ("source_case_id", "source_snapshot_id", "normalized_user_prompt_hash")
    return assets.shared_fingerprints(rows.filter("split = 'train'"), rows.filter("split = 'test'"), fields)


@query(f"""
WITH f AS (SELECT p.asset_id, asset_type, unnest(['case', 'snapshot', 'prompt']) AS field, unnest([p.source_case_id, p.source_snapshot_id, h]) AS value FROM {_PRINTED} p JOIN {ASSETS} a USING (asset_id)),
t AS (SELECT DISTINCT field, value FROM f WHERE asset_type <> 'regression' AND value <> ''), s AS (SELECT DISTINCT asset_id FROM f SEMI JOIN t USING (field, value))
SELECT asset_id, source_case_id, asset_type, CASE WHEN asset_type <> 'regression' THEN 'train' WHEN asset_id IN (SELECT asset_id FROM s) THEN 'bug_reproduction' ELSE 'test' END AS split FROM {ASSETS}
""")
def release_splits(spark, sf_dir):
    rows = _rel(spark, sf_dir, dt.ASSETS).drop("split").withColumn("normalized_user_prompt_hash", tx.prompt_hash(F.col("text")))
    return assets.assign_split(rows).select("asset_id", "source_case_id", "asset_type", "split")


@query("""
SELECT event_id AS key, event_type FROM events WHERE event_id % 4 = 0 AND event_id % 8 <> 0
""")
def append_new_events(spark, sf_dir):
    """All events are offered to a log that lacks every eighth of them; the missing ones are appended."""
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "event_type")
    rows, _ = assets.append_once(events.filter("key % 8 <> 4"), events, "key")
    return rows


@query(f"""
WITH a AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM {ASSETS}), h AS (SELECT sha256(t) AS h, min(asset_id) = max(asset_id) AS alone FROM a GROUP BY 1),
c AS (SELECT source_case_id, count(*) > 1 AND count_if(asset_type = 'regression') > 0 AS shared FROM a GROUP BY 1), n AS (SELECT source_snapshot_id, count(*) AS n, count_if(asset_type = 'regression') AS r FROM a WHERE trim(source_snapshot_id) <> '' GROUP BY 1),
k AS (SELECT asset_id, NOT (regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{{9}}($|[^0-9])') OR regexp_matches(text, '(^|[^0-9])[0-9]{{17}}[0-9Xx]($|[^0-9])') OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS pii, alone,
  trim(source_snapshot_id) <> '' AS traced, greatest(CASE WHEN c.shared THEN 1 ELSE 0 END, CASE WHEN coalesce(n.n, 0) > 1 AND coalesce(n.r, 0) > 0 THEN 1 ELSE 0 END) = 1 AS overlap,
  t <> '' AND len(regexp_extract_all(t, '\\*\\*')) % 2 = 0 AND len(regexp_extract_all(t, '```')) % 2 = 0 AND NOT (length(t) >= 200 AND position(right(t, 1) IN '.。!！?？)）]】"”''’`}}') = 0) AS whole
  FROM a JOIN h ON sha256(a.t) = h.h LEFT JOIN c USING (source_case_id) LEFT JOIN n USING (source_snapshot_id))
SELECT asset_id, CASE WHEN pii THEN 'passed' ELSE 'failed' END AS pii_check, CASE WHEN alone THEN 'passed' ELSE 'failed' END AS duplicate_check, CASE WHEN traced THEN 'passed' ELSE 'failed' END AS source_traceability,
  'passed' AS law_effective_date_check, CASE WHEN overlap THEN 'not_applicable' ELSE 'passed' END AS contamination_check, CASE WHEN whole THEN 'passed' ELSE 'failed' END AS type_specific_check, pii AND alone AND traced AND whole AS passed FROM k
""")
def quality_check(spark, sf_dir):
    rows = _rel(spark, sf_dir, dt.ASSETS)
    corrections = rows.select("asset_id", F.lit(1).alias("revision_number"), F.col("text").alias("corrected_answer"), F.lit("a").alias("chosen_answer"), F.lit("b").alias("rejected_answer"), F.lit("").alias("preference_reason"))
    candidates = rows.select("asset_id", "asset_type", "source_case_id", F.col("asset_id").alias("source_run_id"), "source_snapshot_id", F.lit("2024-01-01").alias("law_snapshot_date"), F.lit("").alias("evaluation_role"))
    return assets.quality_checks(corrections, candidates)


@query("""
SELECT CAST(conv_id AS VARCHAR) AS asset_id, h AS content_hash, first_seq, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq) AS version_no, concat('SNAP-', substr(h, 1, 20)) AS snapshot_id,
  format('SSV-{}-{:02d}-{}', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq), substr(h, 1, 10)) AS snapshot_version_id
FROM (SELECT conv_id, sha256(text) AS h, min(turn) AS first_seq FROM conversations GROUP BY 1, 2)
""")
def source_versions(spark, sf_dir):
    snaps = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("asset_id"), F.col("text").alias("content"), F.col("turn").alias("seq"))
    return assets.snapshot_versions(snaps)


@query("""
WITH j AS (SELECT conv_id, turn, concat('{"by":{"name":"', role, '","rank":', turn // 2, '},"text":', to_json(lower(substr(text, 1, 1)))::VARCHAR, '}') AS content FROM conversations),
h AS (SELECT conv_id, sha256(content) AS h, min(turn) AS first_seq FROM j GROUP BY 1, 2)
SELECT CAST(conv_id AS VARCHAR) AS asset_id, h AS content_hash, first_seq, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq) AS version_no, concat('SNAP-', substr(h, 1, 20)) AS snapshot_id,
  format('SSV-{}-{:02d}-{}', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_seq), substr(h, 1, 10)) AS snapshot_version_id FROM h
""")
def json_source_versions(spark, sf_dir):
    """Versions of JSON sources: blanks and the order of keys, which change from turn to turn, are no new version."""
    letter = F.to_json(F.struct(F.lower(F.left("text", F.lit(1))).alias("text")))
    inner = F.substr(letter, F.lit(2), F.length(letter) - 2)
    by = F.when(F.col("turn") % 3 == 0, F.format_string('{"rank": %d, "name": "%s"}', F.floor(F.col("turn") / 2), F.col("role"))).otherwise(F.format_string('{"name":"%s","rank":%d}', F.col("role"), F.floor(F.col("turn") / 2)))
    content = F.when(F.col("turn") % 2 == 0, F.format_string(' {%s, "by" : %s}', inner, by)).otherwise(F.format_string('{"by":%s,%s}', by, inner))
    snaps = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("asset_id"), content.alias("content"), F.col("turn").alias("seq"))
    return assets.snapshot_versions(snaps)


@query(f"""
SELECT run_id, response_policy, CASE WHEN run_id % 10 = 0 AND {_STATUS} = 'pending_review' THEN 'reviewed' ELSE {_STATUS} END AS workflow_status FROM {_ROUTED}
""")
def review_write_back(spark, sf_dir):
    routed = _routed(spark, sf_dir)
    seen = routed.filter("run_id % 10 = 0 and workflow_status = 'pending_review'").select("run_id", F.lit("").alias("adjudicated_triage_label"), F.lit("no").alias("reviewer_approved"))
    made, _ = routing.review_write_back(routed, seen)
    return made.select("run_id", "response_policy", "workflow_status")


@query(f"SELECT run_id, version, 'first' AS origin FROM {RUNS} WHERE run_id % 3 <> 0 UNION ALL SELECT run_id, version, 'second' FROM {RUNS} WHERE run_id % 3 = 0")
def merge_shards(spark, sf_dir):
    runs = _rel(spark, sf_dir, dt.RUNS).select("run_id", "version")
    first = runs.filter("run_id % 3 <> 0").withColumn("origin", F.lit("first"))
    second = runs.filter("run_id % 2 = 0 or run_id % 3 = 0").withColumns({"origin": F.lit("second"), "note": F.lit("")})
    return sinks.merge_shards([first, second], ["run_id"]).select("run_id", "version", "origin")


@query("SELECT doc_id, length(text) AS text_length, substr(sha256(text), 1, 12) AS text_sha12 FROM documents")
def public_redaction(spark, sf_dir):
    return sinks.public_columns(_table(spark, sf_dir, "documents"), ["doc_id"], ["text"])


@query("""
WITH t AS (SELECT doc_id, NOT contains(text, 'password') AS forbidden_ok, contains(regexp_replace(text, '\\s+', '', 'g'), 'the') AS a, contains(regexp_replace(text, '\\s+', '', 'g'), 'Licensed') OR contains(regexp_replace(text, '\\s+', '', 'g'), 'der') AS b FROM documents)
SELECT doc_id, true AS expected_policy_ok, forbidden_ok, a::INT + b::INT AS topics_hit, a AND b AS topics_ok, true AS citation_ok, forbidden_ok AND a AND b AS passed FROM t
""")
def assertion_results(spark, sf_dir):
    outputs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("output_text"), F.array(F.lit("auto_answer")).alias("expected_response_policy"), F.array(F.lit("password")).alias("forbidden_claims"), F.array(F.lit("the"), F.lit("license")).alias("required_topics"),
        F.create_map(F.lit("license"), F.array(F.lit("Licensed"), F.lit("der"))).alias("required_topic_aliases"), F.lit(False).alias("citation_required"), F.array(F.lit("SRC-1")).alias("allowed_sources"),
    )
    return assets.evaluate_assertions(outputs).select("doc_id", "expected_policy_ok", "forbidden_ok", "topics_hit", "topics_ok", "citation_ok", "passed")


@query(f"""
WITH m AS (SELECT s.version, s.needs_human_review, coalesce(c.reviewable_claim_count, 0) AS n_open, coalesce(c.citation_gate_issue_count, 0) AS n_issue, coalesce(c.claim_entailment_release_blocker_count, 0) AS n_block
  FROM {SCORES} s LEFT JOIN ({_SUMMARY}) c USING (run_id)),
g AS (SELECT version, count(*) AS runs, count_if(needs_human_review = 'True') AS n_review, sum(n_open)::BIGINT AS reviewable_claim_count, sum(n_issue)::BIGINT AS citation_gate_issue_count,
  sum(n_block)::BIGINT AS claim_entailment_release_blocker_count FROM m GROUP BY 1)
SELECT version, runs, reviewable_claim_count, citation_gate_issue_count, claim_entailment_release_blocker_count, {_rate('n_review', 'runs')} AS human_review_rate,
  {_rate('citation_gate_issue_count', 'reviewable_claim_count')} AS citation_issue_rate, CASE WHEN claim_entailment_release_blocker_count > 0 THEN 'source_boundary_or_claim_support_blocker' END AS gate_reason FROM g
""")
def workflow_comparison(spark, sf_dir):
    table = _rel(spark, sf_dir, dt.SCORES).join(routing.claim_summary(_rel(spark, sf_dir, dt.CLAIMS)), "run_id", "left")
    made = reports.workflow_comparison(table)
    blocked = F.when(F.col("claim_entailment_release_blocker_count") > 0, F.col("gate_reason"))
    return made.select("version", "runs", "reviewable_claim_count", "citation_gate_issue_count", "claim_entailment_release_blocker_count", "human_review_rate", "citation_issue_rate", blocked.alias("gate_reason"))


@query(f"SELECT reviewable_legal_claim = 'yes' AS reviewable, entailment_label, count(*) AS count FROM {CLAIMS} GROUP BY 1, 2")
def failure_taxonomy(spark, sf_dir):
    return reports.label_counts(_rel(spark, sf_dir, dt.CLAIMS))


@query(f"""
WITH r AS (SELECT run_id, sample_id, model_alias, version, row_number() OVER (PARTITION BY model_alias, version ORDER BY run_id) AS cell FROM {SCORES})
SELECT run_id, sample_id, model_alias, version FROM r ORDER BY CASE WHEN sample_id IN (1, 2, 3) THEN 0 WHEN cell = 1 THEN 1 ELSE 2 END, run_id LIMIT 60
""")
def redacted_samples(spark, sf_dir):
    rows = _rel(spark, sf_dir, dt.SCORES).select("run_id", "sample_id", "model_alias", "version")
    return reports.redacted_samples(rows, [1, 2, 3], 60)


@query(f"""
SELECT count(*) AS claim_entailment_rows, count_if(entailment_label = 'supported') AS supported_claim_count, count_if(entailment_label = 'contradicted') AS contradicted_claim_count,
  count_if(entailment_label = 'no_citation') AS no_citation_claim_count FROM {CLAIMS}
""")
def claim_totals(spark, sf_dir):
    return reports.claim_totals(_rel(spark, sf_dir, dt.CLAIMS)).select("claim_entailment_rows", "supported_claim_count", "contradicted_claim_count", "no_citation_claim_count")


@query("""
SELECT conv_id AS run_id, string_agg(concat('[', CAST(turn AS VARCHAR), '] ', trim(text)), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id
""")
def context_blocks(spark, sf_dir):
    """All turns of every conversation, the first with rank 1, as one text in turn order."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("rank"), F.col("turn").cast("string").alias("source_id"), "text")
    return execution.context_block(turns)


@query(f"""
WITH p AS ({{PLAN}}), s AS (SELECT p.run_id, p.sample_id, p.model_alias, p.version, trim(n_name) AS q, CASE WHEN version IN ('V1', 'V3') THEN concat('[', r_name, '] ', n_name) ELSE '' END AS c,
  concat(['a', 'b', 'c', 'd'][('0x' || right(sha256(p.run_id), 1))::INT % 4 + 1], ' ') AS style FROM p JOIN nation ON n_nationkey = p.sample_id JOIN region ON n_regionkey = r_regionkey),
l0 AS (SELECT *, concat(style, substr(concat('|', c, '|', q), 1, 40)) AS a FROM s WHERE version IN ('V0', 'V1')),
l1 AS (SELECT s.*, concat(s.style, substr(concat(regexp_replace(concat(z.a, chr(10), chr(10), o.a), '\\s+$', ''), '|', s.c, '|', s.q), 1, 40)) AS a FROM s JOIN l0 z USING (sample_id, model_alias) JOIN l0 o USING (sample_id, model_alias) WHERE s.version = 'V2' AND z.version = 'V0' AND o.version = 'V1'),
l2 AS (SELECT s.*, concat(s.style, substr(concat(regexp_replace(coalesce(l1.a, ''), '\\s+$', ''), '|', s.c, '|', s.q), 1, 40)) AS a FROM s LEFT JOIN l1 USING (sample_id, model_alias) WHERE s.version = 'V3')
SELECT run_id, version, 'ok' AS run_status, a AS output_text FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
""".replace("{PLAN}", ORACLE_SQL["run_plan"]))
def mock_runs(spark, sf_dir):
    """Three levels of versions: V2 sees V0 and V1, V3 sees V2; V1 and V3 see what was retrieved."""
    plan = run_plan(spark, sf_dir)
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    samples = nation.select(F.col("n_nationkey").alias("sample_id"), F.col("n_name").alias("user_question"))
    found = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("sample_id"), F.lit(1).alias("rank"), F.col("r_name").alias("source_id"), F.col("n_name").alias("text"))
    call = lambda df: df.withColumns({"answer": execution.mock_answer(F.col("run_id"), F.col("prompt"), ("a", "b", "c", "d")), "error": F.lit("")})
    needs = spark.createDataFrame([("V2", "V0"), ("V2", "V1"), ("V3", "V2"), ("V3", "V9")], "version string, needs string")
    made = execution.execute_graph(plan, samples, call, "{base_answer}|{context}|{user_question}", needs, found, ("V1", "V3"))
    return made.select("run_id", "version", "run_status", "output_text")


@query(f"""
WITH t AS (SELECT *, format('2024-01-01T{{:010d}}', seq) AS created_at FROM {STATES}), c AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS revision_number, created_at FROM t WHERE to_status = 'ai_review_pending')
SELECT a.asset_id, coalesce(m.made >= s.started, false) AS stored FROM (SELECT DISTINCT asset_id FROM t) a LEFT JOIN (SELECT asset_id, max_by(created_at, revision_number) AS made FROM c GROUP BY 1) m USING (asset_id)
  LEFT JOIN (SELECT asset_id, max_by(created_at, seq) AS started FROM t WHERE to_status = 'correction_drafting' GROUP BY 1) s USING (asset_id)
""")
def stored_drafts(spark, sf_dir):
    """Assets whose last correction is not older than the last start of their drafting."""
    moves = _rel(spark, sf_dir, dt.STATES).withColumn("created_at", F.format_string("2024-01-01T%010d", "seq"))
    made = assets.numbered(moves.filter("to_status = 'ai_review_pending'"), "asset_id", "seq", "revision_number").select("asset_id", "revision_number", "created_at")
    return assets.drafts_stored(made, moves)


@query("""
WITH f AS (SELECT concat(lang, '/', source) AS folder, concat(doc_id, '.txt') AS name, concat('file:', sha256(coalesce(text, ''))) AS mark FROM documents),
l2 AS (SELECT folder AS path, sha256(string_agg(concat(name, chr(10), mark), chr(10) ORDER BY concat(name, chr(10), mark))) AS h FROM f GROUP BY 1),
l1 AS (SELECT split_part(path, '/', 1) AS path, sha256(string_agg(concat(split_part(path, '/', 2), chr(10), 'folder:', h), chr(10) ORDER BY concat(split_part(path, '/', 2), chr(10), 'folder:', h))) AS h FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS path, sha256(string_agg(concat(path, chr(10), 'folder:', h), chr(10) ORDER BY concat(path, chr(10), 'folder:', h))) AS h FROM l1)
SELECT path, h AS sha256 FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0
""")
def folder_hashes(spark, sf_dir):
    """The documents as a tree of files by language and source, hashed folder by folder."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return snapshots.folder_hashes(files)


@query(f"""
WITH c AS (SELECT run_id, count(*) AS n, count_if(o) AS open, count_if(o AND run_id % 3 = 0) AS cited, count_if(o AND entailment_label IN {routing.STRICT_LABELS}) AS strict_, count_if(o AND entailment_label IN {routing.ISSUE_LABELS}) AS issue,
  count_if(entailment_label IN {routing.BLOCKER_LABELS}) AS blocker, count_if(entailment_label = 'no_citation') AS bare, count_if(entailment_label = 'out_of_scope_source') AS outside, count_if(entailment_label = 'fabricated_citation') AS fake,
  count_if(entailment_label = 'contradicted') AS against FROM (SELECT *, reviewable_legal_claim = 'yes' AS o FROM {CLAIMS}) GROUP BY 1),
g AS (SELECT s.version, min_by(u.workflow_condition, s.run_id) AS workflow_condition, min_by(u.workflow_name, s.run_id) AS workflow_name, count(*) AS runs, {_mean('sum(s.run_id * 7 % 101)', 'count(*)', 4, 100)} AS avg_score_rate,
  {_rate("count_if(s.needs_human_review = 'True')", 'count(*)')} AS human_review_rate, {_mean('sum(u.latency_ms)', 'count(*)', 2)} AS avg_latency_ms, {', '.join(f'coalesce(sum({x}), 0)::BIGINT AS {x}' for x in ('n', 'open', 'cited', 'strict_', 'issue', 'blocker', 'bare', 'outside', 'fake', 'against'))}
  FROM {SCORES} s JOIN {RUNS} u USING (run_id) LEFT JOIN c USING (run_id) GROUP BY 1)
SELECT version, workflow_condition, workflow_name, runs, avg_score_rate, human_review_rate, avg_latency_ms, {_rate('cited', 'open')} AS citation_coverage_rate, strict_ AS reviewable_strict_citation_defect_count, issue AS reviewable_claim_needs_review_count,
  blocker AS all_claim_source_boundary_blocker_count, bare AS no_citation_claims, outside AS out_of_scope_source_claims, fake AS fabricated_claim_citations, against AS contradicted_claims, {_rate('strict_', 'open')} AS reviewable_strict_citation_defect_rate,
  {_rate('issue', 'open')} AS reviewable_claim_needs_review_rate, {_rate('blocker', 'n')} AS all_claim_source_boundary_blocker_rate FROM g
""")
def workflow_report(spark, sf_dir):
    """Every measure of the workflow report over runs, scores and claims."""
    claims_ = _rel(spark, sf_dir, dt.CLAIMS).withColumn("cited_source_ids", F.when(F.col("run_id") % 3 == 0, '["SRC-1"]').otherwise("[]"))
    runs = _rel(spark, sf_dir, dt.RUNS).select("run_id", "workflow_condition", "workflow_name", "latency_ms")
    return reports.workflow_report(_rel(spark, sf_dir, dt.SCORES).join(runs, "run_id").join(routing.claim_rates(claims_), "run_id", "left"))


@query(f"""
WITH v AS (SELECT *, run_id % 40 AS case_id, CASE WHEN human_pass_fail = 'pass' THEN 3 WHEN human_critical_failure = 'Yes' THEN 1 ELSE 2 END AS o FROM {REVIEWS}),
r AS (SELECT v.*, trim(d.text) AS answer FROM v JOIN documents d ON d.doc_id = v.run_id WHERE v.case_id IN (SELECT item_id FROM benchmark)),
w AS (SELECT case_id, min(k) AS k FROM (SELECT case_id, {{'o': o, 'c': case_id::VARCHAR, 'r': run_id::VARCHAR, 'run': run_id}} AS k FROM r) GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS no FROM w QUALIFY no < 15),
s AS (SELECT *, CASE no // 5 WHEN 0 THEN 'sft' WHEN 1 THEN 'preference' ELSE 'regression' END AS asset_type FROM n)
SELECT format('ASSET-{{}}-{{:03d}}', upper(asset_type), no % 5 + 1) AS asset_id, s.case_id::VARCHAR AS source_case_id, s.k.run AS source_run_id, asset_type, 'independent' AS evaluation_role,
  sha256(regexp_replace(lower(b.text), '\\s', '', 'g')) AS normalized_user_prompt_hash FROM s JOIN benchmark b ON b.item_id = s.case_id
""")
def asset_candidates(spark, sf_dir):
    """Candidates of three kinds out of reviewed runs, their answers and their cases."""
    failed = F.when(F.col("human_pass_fail") == "pass", "pass").when(F.col("human_critical_failure") == "Yes", "fail").otherwise("partial")
    reviewed = _rel(spark, sf_dir, dt.REVIEWS).select("run_id", (F.col("run_id") % 40).alias("sample_id"), failed.alias("human_pass_fail"))
    runs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("output_text"))
    cases_ = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("user_prompt"))
    made = assets.build_candidates(reviewed, runs, cases_)
    return made.select("asset_id", "source_case_id", "source_run_id", "asset_type", "evaluation_role", "normalized_user_prompt_hash")


_MIXED = "concat(substr(error_tags, 1, length(error_tags) - 1), CASE WHEN error_tags = '[]' THEN '' ELSE ',' END, '{\"coarse_error_tag\":\"', CASE WHEN run_id % 3 = 0 THEN '' WHEN run_id % 3 = 1 THEN 'odd' ELSE 'overclaim' END, '\"}]')"
_ITEMS = f"CAST(json({_MIXED}) AS JSON[])"
_NAME_OF = "CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.coarse_error_tag') ELSE json_extract_string(x, '$') END"


@query(f"""
WITH i AS (SELECT run_id, {_ITEMS} AS items FROM {SCORES}),
n AS (SELECT run_id, list_transform(items, lambda x: {_NAME_OF}) AS names, list_transform(list_filter(items, lambda x: json_type(x) = 'OBJECT'), lambda x: {_NAME_OF}) AS objects FROM i)
SELECT run_id, array_to_string(list_filter(names, lambda x: x <> ''), ',') AS plain, array_to_string(list_transform(names, lambda x: CASE WHEN x IN {vs.COARSE_TAGS} THEN x ELSE 'needs_human_review' END), ',') AS router,
  array_to_string(list_filter(names, lambda x: x <> ''), ',') AS gate, array_to_string(list_transform(objects, lambda x: CASE WHEN x IN {vs.COARSE_TAGS} THEN x ELSE 'needs_human_review' END), ',') AS ensemble FROM n
""")
def tag_variants(spark, sf_dir):
    """Tags of mixed lists of names and objects as the dashboard, the router, the gate and ensembles read them."""
    rows = _rel(spark, sf_dir, dt.SCORES).select("run_id", F.expr(_MIXED).alias("mixed"))
    line = lambda tags: F.array_join(tags, ",")
    c = F.col("mixed")
    return rows.select("run_id", line(vs.plain_tags(c)).alias("plain"), line(vs.tag_names(vs.error_tags(c))).alias("router"), line(vs.tag_names(vs.error_tags(c, strict=False))).alias("gate"), line(vs.tag_names(vs.error_tags(c, objects_only=True))).alias("ensemble"))


@query(f"""
WITH a AS (SELECT asset_id, asset_type, length(text) % 2 = 0 AS eligible, CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'x' END AS chosen, CASE WHEN length(text) % 5 = 0 THEN '' WHEN length(text) % 5 = 1 THEN 'x' ELSE 'y' END AS rejected FROM {ASSETS})
SELECT asset_id, 'regression assets may not train' AS message FROM a WHERE asset_type = 'regression' AND eligible
UNION ALL SELECT asset_id, 'chosen and rejected answers come together' FROM a WHERE (chosen <> '') <> (rejected <> '')
UNION ALL SELECT asset_id, 'chosen and rejected answers must differ' FROM a WHERE chosen <> '' AND chosen = rejected
""")
def asset_constraints(spark, sf_dir):
    """Records that break the constraints of their type."""
    n = F.length("text")
    rows = _rel(spark, sf_dir, dt.ASSETS).select("asset_id", "asset_type", (n % 2 == 0).alias("training_eligible"), F.when(n % 3 == 0, "").otherwise("x").alias("chosen_answer"), F.when(n % 5 == 0, "").when(n % 5 == 1, "x").otherwise("y").alias("rejected_answer"))
    return assets.asset_violations(rows)


#: Words of the driver's prose and what they stand for here.
_SUBTYPES = (("license", "missing_ip_risk"), ("straße", "platform_liability_unclear"), ("qu", "evidence_chain_unclear"), ("und", "jurisdiction_unclear"))


@query(f"""
SELECT doc_id, CASE {' '.join(f"WHEN contains(concat(text, ' ', source), '{w}') THEN '{s}'" for w, s in _SUBTYPES)} ELSE 'general_legal_risk' END AS error_subtype FROM documents
""")
def error_subtypes(spark, sf_dir):
    """Subtypes of error out of the words of two texts, the first rule first."""
    return _table(spark, sf_dir, "documents").select("doc_id", judging.gold_subtype(F.col("text"), F.col("source"), rules=_SUBTYPES).alias("error_subtype"))


def _assertions(spark, sf_dir):
    """Two revisions for even documents, one for the others, none for every seventh; outputs; and recorded results of every fifth."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("asset_id"), "doc_id", "text")
    first = docs.filter("doc_id % 7 <> 0").select(
        "asset_id", F.format_string("ASSERT-%s-%02d", "asset_id", F.lit(1)).alias("assertion_id"), F.lit(1).alias("revision_number"), F.array(F.lit("auto_answer")).alias("expected_response_policy"),
        F.array(F.lit("password")).alias("forbidden_claims"), F.array(F.lit("the"), F.lit("license")).alias("required_topics"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")).alias("required_topic_aliases"), F.lit(False).alias("citation_required"),
    )
    aliases = docs.filter("doc_id % 2 = 0").select("asset_id", F.create_map(F.lit("license"), F.array(F.lit("Licensed"), F.lit("der"))).alias("required_topic_aliases"))
    logs = docs.select("asset_id", F.concat(F.lit("RR"), F.col("doc_id").cast("string")).alias("rerun_id"), F.col("text").alias("output_text"), F.array().cast("array<string>").alias("allowed_sources"))
    earlier = docs.filter("doc_id % 5 = 0").select(
        "asset_id", F.format_string("REG-%s-%02d", "asset_id", F.lit(1)).alias("regression_id"), F.concat(F.lit("RR"), F.col("doc_id").cast("string")).alias("rerun_id"), F.lit(1).alias("seq"),
        F.array(*(F.lit(True) for _ in regression.CHECKS)).alias("checks"), F.lit("scoring-v1").alias("scoring_revision"),
    )
    return first, aliases, logs, earlier


@query("""
SELECT concat('A', doc_id) AS asset_id, concat('ASSERT-A', doc_id, '-02') AS assertion_id, 2 AS revision_number, 'Licensed,der' AS aliases, 'the,license' AS required_topics FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0
""")
def revised_assertions(spark, sf_dir):
    first, aliases, _, _ = _assertions(spark, sf_dir)
    made, _ = regression.revise_assertions(first, aliases)
    return made.select("asset_id", "assertion_id", "revision_number", F.array_join(F.col("required_topic_aliases")["license"], ",").alias("aliases"), F.array_join("required_topics", ",").alias("required_topics"))


_BARE = "regexp_replace(text, '\\s+', '', 'g')"
_LICENSE = f"CASE WHEN doc_id % 2 = 0 THEN contains({_BARE}, 'Licensed') OR contains({_BARE}, 'der') ELSE contains({_BARE}, 'license') END"


@query(f"""
WITH c AS (SELECT doc_id, NOT contains(text, 'password') AS f, contains({_BARE}, 'the') AND {_LICENSE} AS t, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS v, doc_id % 5 = 0 AS known FROM documents WHERE doc_id % 7 <> 0)
SELECT concat('A', doc_id) AS asset_id, concat('REG-A', doc_id, CASE WHEN known THEN '-02' ELSE '-01' END) AS regression_id, concat('RR', doc_id) AS rerun_id, CASE WHEN f AND t THEN 'passed' ELSE 'failed' END AS regression_status,
  concat_ws(',', CASE WHEN NOT f THEN 'forbidden_ok' END, CASE WHEN NOT t THEN 'topics_ok' END) AS failure_reason, concat('scoring-v', v) AS scoring_revision,
  CASE WHEN known THEN concat('REG-A', doc_id, '-01') ELSE '' END AS source_regression_id FROM c WHERE NOT (known AND f AND t AND v = 1)
""")
def regression_scores(spark, sf_dir):
    """Outputs scored under the latest assertion of their asset; what is recorded already gives nothing new."""
    first, aliases, logs, earlier = _assertions(spark, sf_dir)
    second, _ = regression.revise_assertions(first, aliases)
    made, _ = regression.score_runs(logs, first.unionByName(second), earlier)
    return made.select("asset_id", "regression_id", "rerun_id", "regression_status", "failure_reason", "scoring_revision", "source_regression_id")


@query(f"""
SELECT concat('A', doc_id) AS asset_id, concat('RR', doc_id) AS rerun_id, 'required_topic' AS assertion_kind, 'the' AS assertion_value, contains({_BARE}, 'the') AS matched, '["the"]' AS aliases FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT concat('A', doc_id), concat('RR', doc_id), 'required_topic', 'license', {_LICENSE}, CASE WHEN doc_id % 2 = 0 THEN '["Licensed","der"]' ELSE '["license"]' END FROM documents WHERE doc_id % 7 <> 0
""")
def assertion_audit(spark, sf_dir):
    first, aliases, logs, _ = _assertions(spark, sf_dir)
    second, _ = regression.revise_assertions(first, aliases)
    return regression.assertion_audit(logs, first.unionByName(second))


@query(f"""
WITH k AS (SELECT c_custkey AS sample_id, c_mktsegment AS gold FROM customer), b AS (SELECT sample_id, run_id FROM {RUNS} WHERE version = 'V0' AND run_status = 'ok'),
n AS (SELECT sample_id, min(run_id) AS run_id, count(*) AS n FROM b GROUP BY 1), r AS (SELECT run_id, response_policy FROM {_ROUTED})
SELECT k.sample_id, n.run_id, gold, response_policy FROM k JOIN n ON k.sample_id = n.sample_id AND n.n = 1 JOIN nation ON n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = k.sample_id) LEFT JOIN r USING (run_id)
""")
def baseline_runs(spark, sf_dir):
    """Cases with their gold row, metadata and exactly one baseline run, and the run's policy."""
    customers = _table(spark, sf_dir, "customer")
    gold = customers.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("gold"))
    metadata = customers.join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("sample_id"), "n_name")
    runs = _rel(spark, sf_dir, dt.RUNS).select("run_id", "sample_id", "version", "run_status")
    made, _ = regression.baselines(gold.select("sample_id"), gold, metadata, runs, _routed(spark, sf_dir).select("run_id", "response_policy"), F.expr("version = 'V0' and run_status = 'ok'"))
    return made.select("sample_id", "run_id", "gold", "response_policy")


@query(f"""
WITH r AS (SELECT r.*, d.text AS output_text FROM {REVIEWS} r JOIN documents d ON d.doc_id = r.run_id)
SELECT unnest(['priority_review_row_count', 'rows_with_nonempty_answer', 'rows_with_empty_answer', 'completed_final_review_rows', 'reviewer_level_a_b_label_rows']) AS metric,
  unnest([count(*), count_if(trim(output_text) <> ''), count_if(trim(output_text) = ''), count_if(human_pass_fail <> '' OR human_critical_failure <> ''), count_if(reviewer_a_triage_label <> '' AND reviewer_b_triage_label <> '')]) AS value FROM r
""")
def review_evidence(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("output_text"))
    return regression.review_evidence(_rel(spark, sf_dir, dt.REVIEWS).join(docs, "run_id"), ("human_pass_fail", "human_critical_failure"))


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'preference' ELSE 'regression' END"
_EVENTS = f"(SELECT *, sha256(answer) AS corrected_answer_hash, CAST(substr(asset_id, 2) AS BIGINT) AS doc_id FROM {dt.text(dt.REVIEW_EVENTS)})"


def _release(spark, sf_dir):
    """Assets made of documents, their corrections (a second one for every fourth) and their reviews."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").selectExpr("concat('A', doc_id) AS asset_id", "doc_id", "text", "concat('S', doc_id) AS source_snapshot_id", f"{_KIND} AS asset_type")
    revisions = lambda n, answer: docs.select("asset_id", F.format_string("COR-%s-%02d", "asset_id", F.lit(n)).alias("correction_id"), F.lit(n).alias("revision_number"), answer.alias("corrected_answer"), "doc_id")
    corrections = revisions(1, F.col("text")).unionByName(revisions(2, F.concat("text", F.lit(" "))).filter("doc_id % 4 = 0")).drop("doc_id")
    events = _rel(spark, sf_dir, dt.REVIEW_EVENTS).withColumn("corrected_answer_hash", F.sha2("answer", 256))
    return docs, corrections, events


@query(f"""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, CASE WHEN doc_id % 3 = 2 THEN 'test' ELSE 'train' END AS split, doc_id % 3 = 2 AND doc_id % 4 = 0 AS stale FROM documents)
SELECT concat('MEM-r1-', asset_id, '-', CASE WHEN stale THEN 'train' ELSE split END) AS dataset_membership_id, asset_id, 'r1' AS dataset_release_id, CASE WHEN stale THEN 'train' ELSE split END AS split, CASE WHEN stale THEN 'deprecated' ELSE 'included' END AS status FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT concat('MEM-r0-', asset_id, '-train'), asset_id, 'r0', 'train', 'included' FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT concat('MEM-r1-', asset_id, '-', split), asset_id, 'r1', split, 'included' FROM d WHERE doc_id % 2 = 1 OR stale
""")
def release_memberships(spark, sf_dir):
    """A log in which even documents are members, some of the wrong split, and older members of another release."""
    docs, _, _ = _release(spark, sf_dir)
    split = docs.withColumn("split", F.expr("CASE WHEN doc_id % 3 = 2 THEN 'test' ELSE 'train' END"))
    known = assets.memberships(split.filter("doc_id % 2 = 0").withColumn("split", F.expr("CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE split END")), "r1")
    log = known.unionByName(assets.memberships(docs.filter("doc_id % 5 = 0").withColumn("split", F.lit("train")), "r0"))
    made, _ = releases.update_memberships(log, split, "r1")
    return made


_CONFLICTS = f"""
SELECT doc_id, asset_id, a.decision AS decision, concat_ws(',', CASE WHEN a.decision <> b.decision THEN 'decision' END, CASE WHEN a.response_policy <> b.response_policy THEN 'response_policy' END,
  CASE WHEN a.legal_conclusion_supported <> b.legal_conclusion_supported THEN 'legal_conclusion_supported' END) AS conflicts, a.should_human_review <> b.should_human_review AS other, a.review_protocol_version = 'blind-v2' AS blind,
  a.correction_id, a.corrected_answer_hash FROM (SELECT * FROM {_EVENTS} WHERE seq = 1) a JOIN (SELECT asset_id, decision, response_policy, legal_conclusion_supported, should_human_review FROM {_EVENTS} WHERE seq = 2) b USING (asset_id)
"""


@query(f"""
SELECT concat('ADJ-', asset_id, CASE WHEN doc_id % 6 = 0 THEN '-02' ELSE '-01' END) AS adjudication_id, asset_id, conflicts, CASE WHEN conflicts = '' THEN 'not_required' ELSE 'adjudication_pending' END AS status,
  CASE WHEN conflicts = '' THEN decision END AS proposed_decision, correction_id, corrected_answer_hash FROM ({_CONFLICTS})
""")
def adjudications(spark, sf_dir):
    docs, corrections, events = _release(spark, sf_dir)
    made, _ = releases.adjudicate(events, releases.current_corrections(corrections, docs), docs.filter("doc_id % 6 = 0"))
    return made.select("adjudication_id", "asset_id", F.array_join("conflicts", ",").alias("conflicts"), "status", "proposed_decision", "correction_id", "corrected_answer_hash")


@query("""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS n, text FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 5 <> 0 AND doc_id * 3 % 7 <> 3)
SELECT concat('EAB-', asset_id, '-0', n) AS binding_id, asset_id, concat('COR-', asset_id, '-0', n) AS correction_id, n AS correction_revision, sha256(CASE WHEN n = 2 THEN concat(text, ' ') ELSE text END) AS corrected_answer_hash,
  concat('REV-', asset_id, '-final_expert-01') AS original_review_event_id FROM d
""")
def approval_bindings(spark, sf_dir):
    """Every ninth document has no accepted submission, every fifth one gives a reason that no expert wrote."""
    docs, corrections, events = _release(spark, sf_dir)
    sent = docs.select(
        "asset_id", F.lit(1).alias("seq"), F.expr("CASE WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'accepted' END").alias("expert_decision"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("corrected_answer"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'fine' END").alias("expert_override_reason"), F.lit("sheet.csv").alias("submission_file"), F.lit("0").alias("submission_file_sha256"),
    )
    bound, _ = releases.bind_approvals(sent, corrections, events.withColumn("findings", F.array(F.lit("fine"))), docs.withColumn("asset_status", F.lit("accepted")))
    return bound.select("binding_id", "asset_id", "correction_id", "correction_revision", "corrected_answer_hash", "original_review_event_id")


@query(f"""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, {_KIND} AS asset_type FROM documents), c AS ({_CONFLICTS}),
w AS (SELECT DISTINCT concat('A', asset_id) AS asset_id FROM {STATES} WHERE to_status = 'rework_required'),
g AS (SELECT count(*) AS n, count_if(asset_type = 'sft') AS accepted_sft, count_if(asset_type = 'preference') AS accepted_preference, count_if(asset_type = 'regression') AS accepted_regression,
  count_if(blind AND conflicts = '' AND NOT other) AS agreed, count_if(conflicts <> '') AS conflicting, count_if(doc_id % 10 = 0) AS overridden, count_if(doc_id % 8 = 0) AS diverged,
  count(*) - count_if(asset_id IN (SELECT asset_id FROM w)) AS first_pass, count_if(doc_id % 11 = 0) AS qa_failure_count, median(doc_id % 601)::DOUBLE AS seconds FROM d JOIN c USING (doc_id, asset_id))
SELECT accepted_sft, accepted_preference, accepted_regression, {_rate('agreed', 'n')} AS ai_exact_agreement_rate, {_rate('conflicting', 'n')} AS ai_conflict_rate, {_rate('overridden', 'n')} AS recorded_expert_override_rate_legacy,
  {_rate('diverged', 'n')} AS expert_vs_blind_v2_divergence_rate, {_rate('first_pass', 'n')} AS first_pass_acceptance_rate, qa_failure_count, seconds AS median_self_reported_review_entry_seconds FROM g
""")
def release_figures(spark, sf_dir):
    docs, corrections, events = _release(spark, sf_dir)
    ruled, _ = releases.adjudicate(events, releases.current_corrections(corrections, docs), docs.limit(0))
    ruled = ruled.withColumns({"seq": F.lit(1), "review_protocol_version": F.lit("blind-v2"), "proposed_decision": F.expr("CASE WHEN CAST(substr(asset_id, 2) AS BIGINT) % 8 = 0 THEN 'rework' ELSE 'approve' END")})
    states = _rel(spark, sf_dir, dt.STATES).withColumn("asset_id", F.concat(F.lit("A"), "asset_id"))
    return releases.release_figures(docs, events, ruled, states, docs.select("asset_id", F.expr("doc_id % 11 <> 0").alias("passed")))


@query("""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rework_required' ELSE 'rejected' END AS to_status, doc_id % 2 = 0 AS expert_override FROM documents)
SELECT concat('REV-', asset_id, '-final_expert-02') AS event_id, asset_id, to_status, CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'rework' ELSE 'reject' END AS decision, sha256(concat_ws('|', asset_id, to_status, 'read', 'legal_phd')) AS input_hash,
  expert_override, CASE WHEN expert_override THEN 'read' ELSE '' END AS expert_override_reason, concat('COR-', asset_id, CASE WHEN doc_id % 4 = 0 THEN '-02' ELSE '-01' END) AS correction_id FROM d
""")
def expert_decisions(spark, sf_dir):
    """A valid bundle over all documents: second expert events and the states they lead to."""
    docs, corrections, events = _release(spark, sf_dir)
    rows = docs.select(
        "asset_id", F.expr("CASE doc_id % 3 WHEN 0 THEN ' accepted ' WHEN 1 THEN 'rework_required' ELSE 'rejected' END").alias("expert_decision"), F.lit(" read").alias("expert_override_reason"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'no' END").alias("expert_override"), F.lit("30").alias("review_elapsed_seconds"), F.lit("legal_phd").alias("reviewer_role"),
    )
    made = releases.expert_events(rows, releases.current_corrections(corrections, docs), events)
    return made.select("event_id", "asset_id", "to_status", "decision", "input_hash", "expert_override", "expert_override_reason", "correction_id")


@query(f"""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, text, doc_id % 41 <> 0 AS blind, doc_id % 37 <> 0 AS bound, doc_id % 3 = 2 AS regression FROM documents)
SELECT asset_id, message FROM (SELECT asset_id, unnest([
  CASE WHEN doc_id % 29 = 0 THEN 'asset not accepted' END, CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN 'missing corrected answer' END, CASE WHEN NOT blind THEN 'missing blind review roles' END,
  CASE WHEN doc_id * 3 % 7 = 3 THEN 'missing final expert approval' END, CASE WHEN doc_id % 11 = 0 THEN 'final quality check not passed' END, CASE WHEN doc_id % 19 = 0 THEN 'final quality check lineage mismatch' END,
  CASE WHEN doc_id % 23 = 0 THEN 'missing adjudication evidence' END, CASE WHEN NOT bound THEN 'missing expert approval binding' END, CASE WHEN bound AND doc_id % 43 = 0 THEN 'missing expert submission evidence' END,
  CASE WHEN doc_id % 47 = 0 THEN 'missing source snapshot version' END, CASE WHEN doc_id % 31 = 0 THEN 'asset not marked included' END, CASE WHEN doc_id % 53 = 0 THEN 'asset missing included membership' END,
  CASE WHEN regression AND (doc_id % 53 = 0 OR doc_id % 59 = 0) THEN 'invalid regression split' END, CASE WHEN regression AND doc_id % 61 = 0 THEN 'missing regression assertion' END,
  CASE WHEN blind AND doc_id % 17 = 0 THEN 'blind review corrected_answer_hash mismatch: reviewer_b' END, CASE WHEN blind AND doc_id % 67 = 0 THEN 'blind review has no raw output: reviewer_a' END]) AS message FROM d) WHERE message IS NOT NULL
""")
def release_record_errors(spark, sf_dir):
    """A release over all documents with one fault of each kind planted at another spacing."""
    docs, corrections, events = _release(spark, sf_dir)
    expert = events.filter("seq = 3").withColumn("doc_id", F.expr("CAST(substr(asset_id, 2) AS BIGINT)"))  # one row an asset with its lineage
    accepted = docs.withColumns({"asset_status": F.expr("CASE WHEN doc_id % 29 = 0 THEN 'rework_required' ELSE 'accepted' END"), "dataset_membership_status": F.expr("CASE WHEN doc_id % 31 = 0 THEN 'proposed' ELSE 'included' END")})
    checks = expert.withColumns({c: F.lit("passed") for c in (*releases.QUALITY_CHECKS, "contamination_check")}).withColumns({
        "pii_check": F.expr("CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'passed' END"), "correction_revision": F.expr("CASE WHEN doc_id % 19 = 0 THEN 9 ELSE correction_revision END"),
    })
    rulings = expert.filter("doc_id % 23 <> 0").withColumns({"status": F.lit("not_required"), "review_protocol_version": F.lit("blind-v2")})
    bindings = expert.filter("doc_id % 37 <> 0").withColumn("submission_file_sha256", F.lit("0"))
    members = docs.filter("doc_id % 53 <> 0").select("asset_id", F.expr("CASE WHEN doc_id % 3 = 2 AND doc_id % 59 <> 0 THEN 'test' ELSE 'train' END").alias("split"), F.lit("included").alias("status"))
    hashed = events.withColumns({"output_hash": F.lit("0"), "doc_id": F.expr("CAST(substr(asset_id, 2) AS BIGINT)")})
    evidence = hashed.filter("NOT (seq = 1 AND doc_id % 67 = 0) AND NOT (seq = 3 AND doc_id % 43 = 0)").select("asset_id", "review_role", "output_hash")
    return releases.release_record_errors(accepted, corrections, hashed, checks, rulings, bindings, members, docs.filter("doc_id % 47 <> 0"), docs.filter("doc_id % 61 <> 0"), evidence)


@query("""
SELECT conv_id AS trace_id, turn AS turn_index, CASE WHEN turn % 5 = 4 THEN 'failed' ELSE 'completed' END AS api_call_status, CASE WHEN turn % 5 = 4 THEN 'not_available' WHEN trim(m) <> '' THEN 'nonempty' ELSE 'empty' END AS content_status,
  CASE WHEN turn % 5 = 4 THEN 'failed' WHEN trim(m) <> '' THEN 'ok' ELSE 'empty_output' END AS status, trim(m) <> '' AS has_nonempty_output, length(m) AS agent_message_length, substr(sha256(m), 1, 12) AS agent_message_sha256_12
FROM (SELECT *, CASE WHEN turn % 7 = 3 THEN '  ' ELSE text END AS m FROM conversations)
""")
def turn_records(spark, sf_dir):
    """All turns as model answers; some calls failed, some answers are blank."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("turn_index"), F.expr("CASE WHEN turn % 7 = 3 THEN '  ' ELSE text END").alias("agent_message"), F.expr("CASE WHEN turn % 5 = 4 THEN 'timeout' ELSE '' END").alias("error"))
    return traces.turn_status(turns).select("trace_id", "turn_index", "api_call_status", "content_status", "status", "has_nonempty_output", "agent_message_length", "agent_message_sha256_12")


_SLICES = "['normal_practice', 'citation_grounding', 'adversarial_trap', 'hard_legal_reasoning']"


@query(f"""
WITH c AS (SELECT concat('C', doc_id) AS sample_id, lang, source, {_SLICES}[(doc_id % 4 + 1)::INT] AS slice, ['grounded_qa', 'document_drafting', 'other'][(doc_id % 3 + 1)::INT] AS kind, doc_id % 5 = 0 AS review, doc_id % 2 = 0 AS asks, text FROM documents)
SELECT c.sample_id, CASE kind WHEN 'grounded_qa' THEN 'case_analysis' WHEN 'document_drafting' THEN kind ELSE 'consultation' END AS task_category, CASE WHEN asks THEN concat('应追问：', lang, '；', source) ELSE '{cases.NOTHING_TO_ASK}' END AS expected_clarification_questions,
  concat('answer；关键事实：', source) AS expected_answer_points, concat('禁止主张：never；关键失败：；expected_human_review=', CASE WHEN review THEN 'True' ELSE 'False' END) AS risk_points, concat('slice=', slice, '；expected_data_asset_routes=eval') AS human_review_note,
  CASE slice WHEN 'normal_practice' THEN 'normal' WHEN 'citation_grounding' THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN review THEN 'high' WHEN slice IN ('citation_grounding', 'hard_legal_reasoning') THEN 'medium' ELSE 'low' END AS risk_level,
  concat(c.sample_id, '-R02') AS rubric_id, 2 AS max_score, 'high' AS criticality, concat('{cases.CONTEXT_ONLY}', chr(10), '[', lang, '] context') AS known_facts FROM c
""")
def imported_cases(spark, sf_dir):
    """Documents as a case bank: gold, metadata, input and the second rubric item of every case."""
    docs = _table(spark, sf_dir, "documents").withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    bank = docs.select(
        F.format_string("C%d", "doc_id").alias("case_id"), F.col("text").alias("user_prompt"), F.expr(f"element_at(array{_SLICES.replace('[', '(').replace(']', ')')}, CAST(doc_id % 4 + 1 AS INT))").alias("slice"),
        F.expr("element_at(array('grounded_qa', 'document_drafting', 'other'), CAST(doc_id % 3 + 1 AS INT))").alias("task_type"), F.expr("doc_id % 5 = 0").alias("expected_human_review"), F.lit(" answer").alias("expected_behavior"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN array(lang, ' ', source) END").alias("missing_facts"), F.array("source").alias("critical_facts"), F.array(F.lit("never")).alias("forbidden_claims"), F.array(F.lit("eval")).alias("expected_data_asset_routes"),
        F.expr("array(named_struct('source_id', lang, 'text', 'context'))").alias("provided_context"), F.expr("array(named_struct('criterion', 'x', 'dimension', 'style', 'weight', 0), named_struct('criterion', 'y', 'dimension', 'risk_calibration', 'weight', 2))").alias("rubric"),
    )
    made = cases.import_cases(bank)
    item = made["rubric_items"].filter("rubric_id LIKE '%-R02'").select("sample_id", "rubric_id", "max_score", "criticality")
    rows = made["gold_labels"].join(made["sample_metadata"].select("sample_id", "difficulty", "risk_level"), "sample_id").join(made["eval_input"].select("sample_id", "known_facts"), "sample_id").join(item, "sample_id")
    return rows.select("sample_id", "task_category", "expected_clarification_questions", "expected_answer_points", "risk_points", "human_review_note", "difficulty", "risk_level", "rubric_id", "max_score", "criticality", "known_facts")


@query("""
WITH d AS (SELECT doc_id, concat('A', doc_id) AS asset_id, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 2 END AS n, sha256(regexp_replace(concat('new ', text), '^\\s+|\\s+$', '', 'g')) AS h, doc_id % 3 = 1 AND doc_id % 5 <> 0 AS pair FROM documents WHERE doc_id % 13 <> 0)
SELECT concat('COR-', asset_id, '-0', n) AS correction_id, asset_id, n AS revision_number, h AS answer_hash, CASE WHEN pair THEN h ELSE sha256('') END AS chosen_hash, CASE WHEN pair THEN 'old' ELSE '' END AS rejected_answer FROM d
""")
def correction_drafts(spark, sf_dir):
    """Another revision for every document whose model answer is not blank."""
    docs, corrections, _ = _release(spark, sf_dir)
    candidates = docs.select("asset_id", "asset_type", F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'old' END").alias("source_output"))
    answers = docs.select("asset_id", F.expr("CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE concat('\\n new ', text) END").alias("answer"))
    made, _ = releases.draft_corrections(candidates, corrections, answers)
    return made.select("correction_id", "asset_id", "revision_number", F.sha2("corrected_answer", 256).alias("answer_hash"), F.sha2("chosen_answer", 256).alias("chosen_hash"), "rejected_answer")
