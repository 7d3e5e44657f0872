"""Retrieval report, evidence metrics and redacted samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean
from ..functions.values import number, parse_bool, rate
from .claims import report_gate
from .dashboard import mean
from .retrieval import retrieval_quality
from .routing import claim_summary, with_defaults


def new_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that takes only the columns the left side lacks."""
    return left.join(right.select(key, *(c for c in right.columns if c not in left.columns)), key, "left")


def run_table(runs: DataFrame, cases: DataFrame, *frames: DataFrame) -> DataFrame:
    made = new_columns(runs, cases, "sample_id")
    for f in frames:
        made = new_columns(made, f, "run_id")
    return made


def keep_runs(frames: Sequence[DataFrame], runs: DataFrame) -> list[DataFrame]:
    """Dependent tables cut to the given runs."""
    ids = runs.select("run_id").distinct()
    return [f.join(ids, "run_id", "left_semi") for f in frames]


def workflow_comparison(table: DataFrame, *keys: str) -> DataFrame:
    """Score, review and claim measures per workflow; rates are ratios of sums."""
    keys = keys or ("version",)
    review = parse_bool(F.col("needs_human_review").cast("string"))
    counts = ("claim_entailment_rows", "reviewable_claim_count", "reviewable_strict_citation_defect_count", "citation_gate_issue_count", "claim_entailment_release_blocker_count")
    made = table.groupBy(*keys).agg(
        F.count("*").alias("runs"), mean(number(F.col("score_rate")), 4).alias("avg_score_rate"), rate(F.count_if(review), F.count("*")).alias("human_review_rate"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts),
    )
    part = lambda c: rate(F.col(c), F.col("reviewable_claim_count"))
    made = made.withColumns({"citation_issue_rate": part("citation_gate_issue_count"), "strict_defect_rate": part("reviewable_strict_citation_defect_count")})
    decision, reason = report_gate(F.col("claim_entailment_release_blocker_count"), F.col("citation_issue_rate"), F.col("human_review_rate"), F.col("avg_score_rate"))
    return made.withColumns({"gate_decision": decision, "gate_reason": reason})


#: Columns of the report and the claim counts they sum.
REPORT_COUNTS = {
    "reviewable_strict_citation_defect_count": "reviewable_strict_citation_defect_count", "reviewable_claim_needs_review_count": "reviewable_claim_needs_review_count",
    "all_claim_source_boundary_blocker_count": "all_claim_source_boundary_blocker_count", "no_citation_claims": "no_citation_claim_count", "out_of_scope_source_claims": "out_of_scope_source_count",
    "fabricated_claim_citations": "fabricated_claim_citation_count", "contradicted_claims": "contradicted_claim_count",
}


def workflow_report(table: DataFrame) -> DataFrame:
    """All measures of the workflow report, one row a version: runs with their scores and claim counts.

    Rates are ratios of sums over reviewable claims, that of source boundary blockers over all claims; missing
    counts are 0. The workflow is that of the version's smallest run id.
    """
    counts = ("claim_entailment_rows", "reviewable_claim_count", "cited_reviewable_claim_count", *REPORT_COUNTS.values())
    table = with_defaults(table, workflow_condition="", workflow_name="", latency_ms=0, needs_human_review=None, **dict.fromkeys(counts, 0))
    review = parse_bool(F.col("needs_human_review").cast("string"))
    made = table.filter("version is not null").groupBy("version").agg(
        *(F.coalesce(F.min_by(clean(c), "run_id"), F.lit("")).alias(c) for c in ("workflow_condition", "workflow_name")), F.count("*").alias("runs"), mean(number(F.col("score_rate")), 4).alias("avg_score_rate"),
        rate(F.count_if(review), F.count("*")).alias("human_review_rate"), mean(number(F.col("latency_ms")), 2).alias("avg_latency_ms"),
        *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(f"_{c}") for c in counts),
    )
    part = lambda c, whole="reviewable_claim_count": rate(F.col(f"_{c}"), F.col(f"_{whole}"))
    return made.select(
        "version", "workflow_condition", "workflow_name", "runs", "avg_score_rate", "human_review_rate", "avg_latency_ms", part("cited_reviewable_claim_count").alias("citation_coverage_rate"),
        *(F.col(f"_{c}").alias(n) for n, c in REPORT_COUNTS.items()), part("reviewable_strict_citation_defect_count").alias("reviewable_strict_citation_defect_rate"),
        part("reviewable_claim_needs_review_count").alias("reviewable_claim_needs_review_rate"), part("all_claim_source_boundary_blocker_count", "claim_entailment_rows").alias("all_claim_source_boundary_blocker_rate"),
    )


def label_counts(claims: DataFrame) -> DataFrame:
    """Claims per reviewability and label."""
    return claims.groupBy(parse_bool(F.col("reviewable_legal_claim").cast("string")).alias("reviewable"), "entailment_label").count()


def claim_totals(claims: DataFrame) -> DataFrame:
    """One row of counts over all claims, zeros for none."""
    made = claim_summary(claims.withColumn("_all", F.lit(1)), "_all")
    one = claims.sparkSession.range(1).select(F.lit(1).alias("_all"))
    return one.join(made, "_all", "left").drop("_all").na.fill(0)


def source_boundary(retrieved: DataFrame) -> DataFrame:
    """Precision and recall of every run's sources against what it was allowed and expected to use."""
    allowed, expected = (retrieval_quality(F.col("retrieved_source_ids"), F.col(c)) for c in ("allowed_source_ids", "expected_source_ids"))
    return retrieved.select(
        "run_id", allowed["context_precision"].alias("allowed_precision"), allowed["context_recall"].alias("allowed_recall"),
        expected["context_precision"].alias("context_precision"), expected["context_recall"].alias("context_recall"), expected["hit_count"].alias("expected_source_hit_count"),
    )


def long_metrics(one_row: DataFrame) -> DataFrame:
    """Metric and value, as text, of a one-row table."""
    return one_row.select(*(F.col(c).cast("string").alias(c) for c in one_row.columns)).unpivot([], one_row.columns, "metric", "value")


def redacted_samples(rows: DataFrame, flagship: Sequence[str], limit: int, order: Column | str = "run_id") -> DataFrame:
    """Flagship cases first, then the first row of every model and version, then the rest in order."""
    cell = F.row_number().over(Window.partitionBy("model_alias", "version").orderBy(order))
    level = F.when(F.col("sample_id").isin(*flagship), 0).when(F.col("_cell") == 1, 1).otherwise(2)
    return rows.withColumn("_cell", cell).withColumn("_level", level).orderBy("_level", order).limit(limit).drop("_cell", "_level")


def focus_cases(spark, ids: Sequence[str], cases: DataFrame) -> DataFrame:
    """One row per wanted case, blanks where the case is unknown."""
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "sample_id string, place int")
    return wanted.join(cases, "sample_id", "left").na.fill("").orderBy("place").drop("place")


def worst_samples(runs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` runs with most blockers, then most open issues, those for review first, the lowest score first, then by id."""
    return runs.orderBy(F.desc("all_claim_source_boundary_blocker_count"), F.desc("reviewable_claim_needs_review_count"), F.desc("needs_human_review"), "score_rate", "run_id").limit(n)


def created_range(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """First and last non-empty time stamp, as text."""
    return rows.filter(F.coalesce(F.col(column), F.lit("")) != "").agg(F.min(column).alias("first_created_at"), F.max(column).alias("last_created_at"))


def utc_now() -> Column:
    """The time of the query in UTC, ISO form with seconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
