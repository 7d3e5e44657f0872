"""The data model's relations over the driver's tables, as SQL that Spark and DuckDB both run.

Braces name tables; :func:`relation` binds them to DataFrames, :func:`text` to view names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RUNS = """
SELECT o_orderkey AS run_id, o_custkey AS sample_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'extended' ELSE 'core' END AS source_dataset,
       CASE o_custkey % 3 WHEN 0 THEN 'consultation' WHEN 1 THEN 'case_analysis' ELSE 'document_drafting' END AS task_category,
       concat('model', CAST(c_nationkey % 5 AS STRING)) AS model_alias, concat('vendor', CAST(c_nationkey % 5 % 2 AS STRING)) AS model_vendor,
       concat('family', CAST(c_nationkey % 5 AS STRING)) AS model_family,
       concat('V', CAST(o_orderkey % 4 AS STRING)) AS version, concat('V', CAST(o_orderkey % 4 AS STRING)) AS workflow_condition,
       concat('workflow ', CAST(o_orderkey % 4 AS STRING)) AS workflow_name,
       CASE WHEN o_orderkey % 9 = 0 THEN '   ' ELSE concat('answer ', o_orderpriority) END AS output_text,
       CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'ok' END AS run_status, CASE WHEN o_orderkey % 46 = 0 THEN 'timeout' ELSE '' END AS error_message,
       CAST(o_orderkey % 5000 AS INT) AS latency_ms, CAST(o_custkey % 700 AS INT) AS input_tokens, CAST(o_orderkey % 900 AS INT) AS output_tokens,
       CAST(o_orderkey % 97 AS DOUBLE) / 1000 AS estimated_cost
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

SCORES = """
SELECT o_orderkey AS run_id, o_custkey AS sample_id,
       CASE o_custkey % 3 WHEN 0 THEN 'consultation' WHEN 1 THEN 'case_analysis' ELSE 'document_drafting' END AS task_category,
       concat('model', CAST(c_nationkey % 5 AS STRING)) AS model_alias, concat('V', CAST(o_orderkey % 4 AS STRING)) AS version,
       CAST(o_orderkey * 7 % 101 AS DOUBLE) / 100 AS score_rate,
       CASE o_orderkey % 13
         WHEN 0 THEN '["fabricated_citation","overclaim"]' WHEN 1 THEN '["overclaim"]' WHEN 2 THEN '["missing_facts"]'
         WHEN 3 THEN '[{"coarse_error_tag":"missing_evidence_warning","error_subtype":"late"}]' WHEN 4 THEN '["weak_fact_rule_application","missing_facts"]'
         WHEN 5 THEN '[{"coarse_error_tag":"novel_tag"}]' WHEN 6 THEN '["jurisdiction_risk"]' WHEN 7 THEN '["unsafe_action_suggestion"]' ELSE '[]' END AS error_tags,
       CASE WHEN o_orderkey % 11 = 0 THEN 'high' WHEN o_orderkey % 3 = 0 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN o_orderkey % 17 = 0 THEN 'low' ELSE 'high' END AS judge_confidence,
       CASE WHEN o_orderkey % 19 = 0 THEN 'True' ELSE 'False' END AS needs_human_review,
       CASE WHEN o_orderkey % 89 = 0 THEN 'no' ELSE 'yes' END AS parsed_ok,
       CASE WHEN o_orderkey % 29 = 0 THEN 'failed' ELSE 'ok' END AS run_status,
       CASE WHEN o_orderkey % 2 = 0 THEN 'hit' ELSE '' END AS retrieval_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

CLAIMS = """
SELECT l_orderkey AS run_id,
       CASE CAST(l_quantity AS INT) % 16
         WHEN 0 THEN 'unsupported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'no_citation' WHEN 3 THEN 'not_reviewable'
         WHEN 4 THEN CASE WHEN l_partkey % 40 = 0 THEN 'contradicted' ELSE 'supported' END
         WHEN 5 THEN CASE WHEN l_partkey % 40 = 0 THEN 'fabricated_citation' ELSE 'supported' END
         WHEN 6 THEN CASE WHEN l_partkey % 40 = 0 THEN 'out_of_scope_source' ELSE 'supported' END
         ELSE 'supported' END AS entailment_label,
       CASE WHEN l_returnflag = 'A' THEN 'no' ELSE 'yes' END AS reviewable_legal_claim
FROM {lineitem}
"""

REVIEWS = """
SELECT d.doc_id AS run_id,
       CASE WHEN length(d.text) > 1500 THEN 'auto_answer' WHEN length(d.text) > 600 THEN 'clarify' ELSE 'human_review' END AS auto_triage_label,
       CASE WHEN l.quality = 1 THEN 'auto_answer' WHEN l.toxic = 1 THEN 'human_review' ELSE 'clarify' END AS adjudicated_triage_label,
       CASE WHEN l.quality = 1 THEN 'pass' ELSE '' END AS human_pass_fail,
       CASE WHEN l.toxic = 1 THEN 'Yes' ELSE '' END AS human_critical_failure,
       CASE WHEN d.doc_id % 3 = 0 THEN 'agree' WHEN d.doc_id % 3 = 1 THEN 'disagree' ELSE '' END AS judge_human_agreement,
       CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN l.quality = 1 THEN 'auto_answer' ELSE 'block' END AS reviewer_a_triage_label,
       CASE WHEN d.doc_id % 11 = 0 THEN '' WHEN length(d.text) > 400 THEN 'auto_answer' ELSE 'block' END AS reviewer_b_triage_label,
       CASE WHEN d.doc_id % 5 = 0 THEN 'none' WHEN d.doc_id % 5 = 1 THEN 'block' ELSE '' END AS human_route_override
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

STATES = """
SELECT CAST(user_id AS STRING) AS asset_id, event_id AS seq,
       CASE event_id * 31 % 9 WHEN 0 THEN 'proposed' WHEN 1 THEN 'correction_drafting' WHEN 2 THEN 'ai_review_pending' WHEN 3 THEN 'adjudication_pending'
         WHEN 4 THEN 'qa_pending' WHEN 5 THEN 'expert_review_pending' WHEN 6 THEN 'rework_required' WHEN 7 THEN 'accepted' ELSE 'rejected' END AS to_status
FROM {events}
"""

ASSETS = """
SELECT concat('A', CAST(doc_id AS STRING)) AS asset_id, concat('case', CAST(doc_id % 400 AS STRING)) AS source_case_id,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE substr(text, 1, 60) END AS source_snapshot_id , text,
       CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
       CASE doc_id % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'preference' ELSE 'regression' END AS asset_type
FROM {documents}
"""

REVIEW_EVENTS = """
SELECT concat('A', CAST(doc_id AS STRING)) AS asset_id, n AS seq, role AS review_role, CASE WHEN n = 3 THEN 'legal_expert' ELSE 'ai' END AS review_actor_type,
       concat('REV-A', CAST(doc_id AS STRING), '-', role, '-01') AS event_id, CASE WHEN n = 3 OR doc_id % 41 = 0 THEN '' ELSE 'blind-v2' END AS review_protocol_version,
       CASE WHEN doc_id * n % 7 = 3 THEN 'rework' ELSE 'approve' END AS decision, CASE WHEN (doc_id + n) % 5 = 0 THEN 'clarify' ELSE 'auto_answer' END AS response_policy,
       doc_id % (n + 10) <> 0 AS legal_conclusion_supported, true AS critical_facts_covered, false AS dangerous_action_advice, 'full' AS citation_support, false AS should_clarify,
       doc_id % 13 = 0 AND n = 2 AS should_human_review, doc_id % 10 = 0 AS expert_override, CAST(doc_id % 601 AS DOUBLE) AS review_elapsed_seconds, concat('S', CAST(doc_id AS STRING)) AS source_snapshot_id,
       concat('COR-A', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '-02' ELSE '-01' END) AS correction_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS correction_revision,
       CASE WHEN doc_id % 17 = 0 AND n = 2 THEN 'stale' WHEN doc_id % 4 = 0 THEN concat(text, ' ') ELSE text END AS answer
FROM {documents} CROSS JOIN (VALUES ('reviewer_a', 1), ('reviewer_b', 2), ('final_expert', 3)) AS roles(role, n)
"""


def relation(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """The relation over the Parquet tables of ``sf_dir``."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    bound = re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))  # other braces are JSON
    return spark.sql(bound, **{n: more.get(n) if n in more else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def text(sql: str) -> str:
    """The relation as a sub-query over registered views."""
    return f"({re.sub(r'[{](\w+)[}]', r'\1', sql)})"
