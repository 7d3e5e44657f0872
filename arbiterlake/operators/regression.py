"""Regression runs: assertion revisions, scoring and rescoring, audits, baselines and release figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, filled, topic_hit
from ..functions.values import rate
from .assets import evaluate_assertions, latest

#: The assertion checks in the order in which failures are named.
CHECKS = ("expected_policy_ok", "forbidden_ok", "topics_ok", "citation_ok")


def _numbered_id(prefix: str, key: Column, number: Column) -> Column:
    return F.format_string(f"{prefix}-%s-%02d", key, number)


def revise_assertions(registry: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New revisions that change the aliases of the latest assertion of an asset and nothing else, and assets without an assertion.

    ``registry``: ``asset_id``, ``assertion_id``, ``revision_number``, ``required_topic_aliases`` and more columns,
    which are carried over. ``aliases``: ``asset_id``, ``required_topic_aliases``, one row an asset.
    """
    last = latest(registry, "asset_id", "revision_number")
    changed = last.drop("required_topic_aliases", "assertion_id").join(aliases, "asset_id").withColumn("revision_number", F.col("revision_number") + 1)
    made = changed.withColumn("assertion_id", _numbered_id("ASSERT", F.col("asset_id"), F.col("revision_number"))).select(*registry.columns)
    return made, aliases.select("asset_id").join(last, "asset_id", "left_anti")


def score_runs(logs: DataFrame, registry: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New regression results of logged outputs under the latest assertions, and the logs that have no assertion.

    ``logs``: ``asset_id``, ``rerun_id``, ``output_text``, ``allowed_sources``. ``earlier``: recorded results with
    ``asset_id``, ``regression_id``, ``rerun_id``, ``seq``, ``checks`` (array of boolean in the order of ``CHECKS``) and
    ``scoring_revision``. A log whose outcome is recorded under the same revision gives nothing new; others are
    numbered on from the asset's recorded results and name the last of their rerun as source.
    """
    last = latest(registry, "asset_id", "revision_number")
    scored = evaluate_assertions(logs.join(last, "asset_id")).withColumns({
        "checks": F.array(*CHECKS), "scoring_revision": F.concat(F.lit("scoring-v"), F.col("revision_number").cast("string")),
    })
    known = ["asset_id", "rerun_id", "checks", "scoring_revision"]
    fresh = scored.join(earlier.select(*known).distinct(), known, "left_anti")
    counts = earlier.groupBy("asset_id").agg(F.count("*").alias("_before"))
    source = earlier.groupBy("asset_id", "rerun_id").agg(F.max_by("regression_id", "seq").alias("source_regression_id"))
    order = Window.partitionBy("asset_id").orderBy("rerun_id")
    made = fresh.withColumn("_no", F.row_number().over(order)).join(counts, "asset_id", "left").join(source, ["asset_id", "rerun_id"], "left")
    failed = F.concat_ws(",", *(F.when(~F.col(c), F.lit(c)) for c in CHECKS))
    return made.select(
        "asset_id", _numbered_id("REG", F.col("asset_id"), F.col("_no") + F.coalesce("_before", F.lit(0))).alias("regression_id"), "rerun_id", "checks",
        F.when(F.col("passed"), "passed").otherwise("failed").alias("regression_status"), failed.alias("failure_reason"), "scoring_revision",
        F.coalesce("source_regression_id", F.lit("")).alias("source_regression_id"), F.sha2(F.coalesce("output_text", F.lit("")), 256).alias("output_text_hash"),
    ), logs.join(last, "asset_id", "left_anti").select("asset_id", "rerun_id")


def assertion_audit(logs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per log and required topic of the latest assertion: the topic, whether it was matched, and by which aliases."""
    last = latest(registry, "asset_id", "revision_number").select("asset_id", "required_topics", "required_topic_aliases")
    rows = logs.join(last, "asset_id").select("asset_id", "rerun_id", F.coalesce("output_text", F.lit("")).alias("_text"), "required_topic_aliases", F.explode("required_topics").alias("assertion_value"))
    alias = F.coalesce(F.try_element_at("required_topic_aliases", F.col("assertion_value")), F.array("assertion_value"))
    matched = F.exists(alias, lambda a: topic_hit(F.col("_text"), a))
    return rows.select("asset_id", "rerun_id", F.lit("required_topic").alias("assertion_kind"), "assertion_value", matched.alias("matched"), F.to_json(alias).alias("aliases"))


def attempt_events(files: DataFrame) -> DataFrame:
    """One ledger event per attempt with the hashes of its files; ``files``: ``attempt``, ``name``, ``sha256``."""
    listed = files.groupBy("attempt").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("file_sha256"))
    return listed.select(F.format_string("REG-ATTEMPT-%02d-RECORDED", F.col("attempt")).alias("event_id"), F.lit("attempt_recorded").alias("event_type"), "attempt", "file_sha256")


def refresh_metrics(metrics: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A release's metrics (``metric``, ``value`` as text) with the pass rate of the official results, and the scoring revisions if there is more than one."""
    share = results.agg(rate(F.count_if(F.col("regression_status") == "passed"), F.count("*")).alias("_rate"))  # one row
    fresh = metrics.crossJoin(share).withColumn("value", F.when(F.col("metric") == "regression_pass_rate", F.col("_rate").cast("string")).otherwise(F.col("value"))).drop("_rate")
    revisions = results.select("scoring_revision").distinct()
    several = revisions.agg(F.count("*").alias("_n")).filter("_n > 1")
    return fresh, revisions.crossJoin(several).select("scoring_revision")


def baselines(cases: DataFrame, gold: DataFrame, metadata: DataFrame, runs: DataFrame, routing: DataFrame, of_baseline: Column) -> tuple[DataFrame, DataFrame]:
    """Asked cases (``sample_id``) with gold, metadata, their one baseline run and its route, and messages for those that lack a part.

    ``of_baseline`` is a condition over ``runs``; a case must have exactly one such run. A run may have no route.
    """
    found = runs.filter(of_baseline)
    counts = cases.select("sample_id").join(found.groupBy("sample_id").agg(F.count("*").alias("_n")), "sample_id", "left").select("sample_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    wrong = counts.filter("_n <> 1").select("sample_id", F.format_string("expected one baseline run, found %d", "_n").alias("message"))
    for name, part in (("gold", gold), ("metadata", metadata)):
        wrong = wrong.unionByName(cases.select("sample_id").join(part, "sample_id", "left_anti").select("sample_id", F.lit(f"missing {name}").alias("message")))
    one = found.join(counts.filter("_n = 1").select("sample_id"), "sample_id", "left_semi")
    made = cases.join(gold, "sample_id").join(metadata, "sample_id").join(one, "sample_id")
    return with_signals(made, routing, [c for c in routing.columns if c not in made.columns]), wrong


def with_signals(rows: DataFrame, signals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with columns of another table by ``run_id``, of which repeated rows count once (the least by those columns); unmatched rows stay."""
    once = signals.groupBy("run_id").agg(F.min(F.struct(*columns)).alias("_s")) if columns else signals.select("run_id").distinct()
    joined = rows.join(once, "run_id", "left")
    return joined.select(*rows.columns, *(F.col("_s")[c].alias(c) for c in columns))


def review_evidence(reviews: DataFrame, final: Sequence[str]) -> DataFrame:
    """Counts of a review set in long form: rows, answers, completed reviews and pairs of independent labels."""
    done = F.lit(False)
    for c in final:
        done = done | filled(c)
    pair = filled("reviewer_a_triage_label") & filled("reviewer_b_triage_label")
    one = reviews.agg(
        F.count("*").alias("priority_review_row_count"), F.count_if(filled("output_text")).alias("rows_with_nonempty_answer"), F.count_if(clean("output_text") == "").alias("rows_with_empty_answer"),
        F.count_if(done).alias("completed_final_review_rows"), F.count_if(pair).alias("reviewer_level_a_b_label_rows"),
    )
    return one.unpivot([], one.columns, "metric", "value")
