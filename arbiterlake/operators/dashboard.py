"""Dashboard aggregates: coverage, versions, tasks, cost, policies, routes, tag ranks and badcase cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import error_tags, number, parse_bool, rate, tag_names
from ..sources.scratch import materialize
from .routing import canonical_routing, with_defaults

#: Fixed texts: recommended action of each tag.
ACTIONS = {
    "missing_facts": "intake checklist SFT",
    "overclaim": "preference pairs for overclaim control",
    "missing_evidence_warning": "evidence-risk SFT",
    "unverified_basis": "grounding regression",
    "fabricated_citation": "citation badcase regression",
    "weak_fact_rule_application": "case-analysis eval",
    "needs_human_review": "human review calibration",
}

#: Fixed texts of the policy hint: little risk, much risk, between.
HINTS = (
    "candidate for auto-answer only if critical checks pass",
    "route to human review or stronger workflow before release",
    "limited release with monitoring and targeted data production",
)


def mean(c: Column, places: int) -> Column:
    """Mean of decimals, so that it does not depend on the order of rows."""
    return F.round(F.avg(c.cast("decimal(18,6)")).cast("double"), places)


def score_delta(scores: DataFrame, first: str = "V0", second: str = "V3") -> DataFrame:
    """Mean score per sample and model of two versions and their difference; null where one is missing."""
    table = scores.groupBy("sample_id", "model_alias").pivot("version", [first, second]).agg(F.avg(number(F.col("score_rate"), float("nan")).cast("double")))
    return table.select("sample_id", "model_alias", F.col(first).alias("first_score"), F.col(second).alias("second_score"), (F.col(second) - F.col(first)).alias("delta"))


def exploded_tags(scores: DataFrame, *keys: str, order: str = "run_id") -> DataFrame:
    """One row per tag with its place in encounter order (row order, then place in the list)."""
    names = tag_names(error_tags(F.col("error_tags").cast("string"), strict=False))
    return scores.select(*keys, F.col(order).alias("_row"), F.posexplode(names).alias("_pos", "tag"))


def top_tags(scores: DataFrame, *keys: str, n: int = 3, order: str = "run_id") -> DataFrame:
    """The ``n`` most frequent tags per key; ties go to the tag met first."""
    counts = exploded_tags(scores, *keys, order=order).groupBy(*keys, "tag").agg(F.count("*").alias("tag_count"), F.min(F.struct("_row", "_pos")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("tag_count"), "_first"))  # one row per key and tag
    return counts.withColumn("tag_rank", rank).filter(F.col("tag_rank") <= n).select(*keys, "tag", "tag_count", "tag_rank")


def tag_line(ranked: DataFrame, *keys: str) -> DataFrame:
    """Top tags joined by rank, and their recommended actions."""
    listed = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_rank", "tag"))), lambda t: t["tag"]).alias("_tags"))
    action = F.create_map(*(x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))))
    return listed.select(*keys, F.array_join("_tags", ", ").alias("top_error_tags"), F.array_join(F.array_compact(F.transform("_tags", lambda t: F.try_element_at(action, t))), "; ").alias("data_action"))


def coverage(runs: DataFrame) -> DataFrame:
    """Distinct samples and runs per data set and task."""
    runs = with_defaults(runs, source_dataset="unknown", task_category="unknown").filter("source_dataset is not null and task_category is not null")
    return runs.groupBy("source_dataset", "task_category").agg(F.countDistinct("sample_id").alias("samples"), F.count("run_id").alias("runs"))


def version_summary(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Measures of every version, with the workflows that ``runs`` name for it: one row each."""
    review = parse_bool(F.col("needs_human_review").cast("string"))
    made = scores.filter("version is not null").groupBy("version").agg(
        mean(number(F.col("score_rate")), 3).alias("avg_score_rate"), rate(F.count_if(F.col("risk_level") == "high"), F.count("*"), 3).alias("high_risk_rate"),
        rate(F.count_if(review), F.count("*"), 3).alias("human_review_rate"),
    )
    if runs is None or "workflow_condition" not in runs.columns:
        return made
    return made.join(with_defaults(runs, workflow_name="").select("version", "workflow_condition", "workflow_name").distinct(), "version", "left")


def task_summary(scores: DataFrame, routing: DataFrame) -> DataFrame:
    """Measures, top tags and policy mix of every task."""
    review = parse_bool(F.col("needs_human_review").cast("string"))
    base = scores.filter("task_category is not null").groupBy("task_category").agg(
        F.countDistinct("sample_id").alias("samples"), F.count("*").alias("runs"), mean(number(F.col("score_rate")), 3).alias("avg_score_rate"),
        rate(F.count_if(F.col("risk_level") == "high"), F.count("*"), 3).alias("high_risk_rate"), rate(F.count_if(review), F.count("*"), 3).alias("human_review_rate"),
    )
    mix = canonical_routing(routing).groupBy("task_category", "response_policy").count().groupBy("task_category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("response_policy", "count"))), lambda p: F.concat_ws(":", p["response_policy"], p["count"].cast("string"))), "; ").alias("response_policy_mix")
    )
    return base.join(tag_line(top_tags(scores, "task_category"), "task_category"), "task_category", "left").join(mix, "task_category", "left").na.fill("")


def cost_latency(runs: DataFrame) -> DataFrame:
    keys = [c for c in ("task_category", "model_alias", "version", "workflow_condition", "workflow_name") if c in runs.columns]
    runs = with_defaults(runs, latency_ms=0, input_tokens=0, output_tokens=0, estimated_cost=0).na.drop(subset=keys)
    return runs.groupBy(*keys).agg(
        F.count("run_id").alias("runs"), *(mean(number(F.col(c)), 4).alias(f"avg_{c}") for c in ("latency_ms", "input_tokens", "output_tokens")),
        F.round(F.sum(number(F.col("estimated_cost")).cast("decimal(18,6)")).cast("double"), 4).alias("total_estimated_cost"),
    )


def deployment_policy(scores: DataFrame, routing: DataFrame, runs: DataFrame) -> DataFrame:
    """Measures per task and workflow with a three-way hint."""
    if "workflow_condition" not in runs.columns:
        runs = runs.withColumns({"workflow_condition": F.col("version"), "workflow_name": F.col("version")})
    base = scores.select("run_id", "task_category", "score_rate", "risk_level").join(canonical_routing(routing).select("run_id", "response_policy"), "run_id", "left").join(
        with_defaults(runs, latency_ms=0, estimated_cost=0).select("run_id", "workflow_condition", "workflow_name", "latency_ms", "estimated_cost"), "run_id", "left"
    ).na.drop(subset=["task_category", "workflow_condition", "workflow_name"])
    n = F.count("run_id")
    made = base.groupBy("task_category", "workflow_condition", "workflow_name").agg(
        n.alias("runs"), mean(number(F.col("score_rate")), 4).alias("avg_score_rate"), rate(F.count_if(F.col("risk_level") == "high"), n).alias("high_risk_rate"),
        rate(F.count_if(F.col("response_policy") == "human_review"), n).alias("human_review_rate"), rate(F.count_if(F.col("response_policy") == "block"), n).alias("blocked_response_rate"),
        mean(number(F.col("latency_ms")), 4).alias("avg_latency_ms"), F.round(F.sum(number(F.col("estimated_cost")).cast("decimal(18,6)")).cast("double"), 4).alias("total_estimated_cost"),
    )
    hint = (
        F.when((F.col("high_risk_rate") <= 0.05) & (F.col("human_review_rate") <= 0.15), HINTS[0])
        .when(F.col("high_risk_rate") >= 0.2, HINTS[1]).otherwise(HINTS[2])
    )
    return made.withColumn("policy_hint", hint)


def route_summary(routing: DataFrame) -> DataFrame:
    """Counts per primary route and task with the first five distinct sample ids."""
    counts = routing.groupBy("data_route", "task_category").agg(F.count("run_id").alias("count"))
    ids = routing.select("data_route", "task_category", F.col("sample_id").cast("string").alias("_id")).distinct()
    first = ids.withColumn("_no", F.row_number().over(Window.partitionBy("data_route", "task_category").orderBy("_id"))).filter("_no <= 5")
    listed = first.groupBy("data_route", "task_category").agg(F.array_join(F.array_sort(F.collect_list("_id")), ", ").alias("example_sample_ids"))
    return counts.join(listed, ["data_route", "task_category"], "left")


def policy_summary(routing: DataFrame) -> DataFrame:
    return canonical_routing(routing).groupBy("workflow_status", "response_policy").agg(F.count("run_id").alias("count"))


def asset_route_summary(routing: DataFrame) -> DataFrame:
    return routing.select("run_id", "task_category", F.explode("data_asset_routes").alias("data_asset_route")).groupBy("data_asset_route", "task_category").agg(F.count("run_id").alias("count"))


def model_patterns(scores: DataFrame) -> DataFrame:
    review = parse_bool(F.col("needs_human_review").cast("string"))
    base = scores.filter("model_alias is not null").groupBy("model_alias").agg(rate(F.count_if(review), F.count("*"), 3).alias("human_review_rate"))
    tags = tag_line(top_tags(scores, "model_alias"), "model_alias").select("model_alias", F.col("top_error_tags").alias("dominant_error_patterns"))
    return base.join(tags, "model_alias", "left").na.fill("")


#: Fixed text: what the dashboard is for.
BOUNDARY = "Data production decision panel; diagnostic comparison only; not a model leaderboard."


def kpis(runs: DataFrame, scores: DataFrame, routing: DataFrame) -> DataFrame:
    """One row of dashboard figures.

    The score difference is the mean over samples and models that have both versions, 0 if none has.
    """
    runs, scores = with_defaults(runs, latency_ms=0, estimated_cost=0, output_text=""), with_defaults(scores, source_dataset="unknown", task_category="unknown")
    score = number(F.col("score_rate"))
    of_version = lambda v: mean(F.when(F.col("version") == v, score), 3)
    a = scores.agg(
        F.countDistinct("sample_id").alias("total_samples"), F.countDistinct("task_category").alias("total_task_categories"), F.countDistinct("source_dataset").alias("total_source_datasets"),
        of_version("V0").alias("avg_v0_score"), of_version("V3").alias("avg_v3_score"), rate(F.count_if(F.col("risk_level") == "high"), F.count("*"), 3).alias("high_risk_rate"),
    )
    full = parse_bool(F.col("has_nonempty_output").cast("string")) if "has_nonempty_output" in runs.columns else F.trim(F.coalesce("output_text", F.lit(""))) != ""
    b = runs.agg(
        F.count("*").alias("total_runs"), F.count("*").alias("total_api_run_rows"), F.count_if(full).alias("nonempty_answer_count"), F.count_if(~full).alias("empty_answer_count"), mean(number(F.col("latency_ms")), 1).alias("avg_latency_ms"),
        F.sum(number(F.col("estimated_cost")).cast("decimal(18,6)")).cast("double").alias("total_estimated_cost"),
    )
    c = canonical_routing(routing).agg(F.count_if(F.col("response_policy") == "human_review").alias("human_review_queue_size"), F.count_if(F.col("response_policy") == "block").alias("blocked_response_count"))
    d = score_delta(scores).agg(F.coalesce(F.round(F.avg(F.col("delta").cast("decimal(18,9)")).cast("double"), 3), F.lit(0.0)).alias("avg_score_delta"))
    every = scores.withColumn("_all", F.lit(1))
    e = tag_line(top_tags(every, "_all"), "_all").agg(F.coalesce(F.max("top_error_tags"), F.lit("")).alias("top_3_error_tags"), F.coalesce(F.max("data_action"), F.lit("")).alias("recommended_data_actions"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e).withColumn("dashboard_boundary", F.lit(BOUNDARY))  # one row each


#: Fixed orders of the cards.
CARD_POLICIES = ("block", "human_review", "clarify", "grounded_answer", "auto_answer")
CARD_TASKS = ("consultation", "case_analysis", "document_drafting")
_CARD = ("policy_rank", "task_category", "priority_rank", "score", "sample_id", "version", "model_alias", "run_id")


def badcase_cards(routing: DataFrame, scores: DataFrame, limit: int = 80) -> DataFrame:
    """Diverse badcases: the first of each policy and task, then of each policy and error, then by rank.

    Rows are ranked by policy, task, priority, score, sample, version, model and id. The first three phases take
    rows whose sample, version and policy are not taken yet; cells of the second choose in the order of their
    first rows. The third fills up to ``limit`` by rank, the fourth with whatever runs are left. ``card_no`` is
    the order of choice. Blank and null texts are the same; scores that are not numbers count as 1.

    What is chosen from is bounded: a cell passes over no more keys than there are cells and cards, so each cell
    keeps that many best keys (found map-side), and the choice runs over those few thousand rows alone.
    """
    level = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.coalesce(c, F.lit(""))), F.lit(0)), F.lit(len(order) + 1)).cast("int")
    of_scores = scores.groupBy("run_id").agg(F.min(F.coalesce(number(F.col("score_rate"), 1.0), F.lit(1.0))).alias("score"))
    joined = with_defaults(canonical_routing(routing), model_alias="", main_error_type="", priority="", task_category="").join(of_scores, "run_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = materialize(joined.select(
        level(F.col("response_policy"), CARD_POLICIES).alias("policy_rank"), text("task_category"), level(F.col("priority"), ("P0", "P1", "P2")).alias("priority_rank"), F.coalesce("score", F.lit(1.0)).alias("score"),
        "sample_id", text("version"), text("model_alias"), "run_id", text("response_policy"), text("main_error_type"), text("priority"),
    ))
    row = F.struct(*_CARD, "response_policy", "main_error_type", "priority").alias("row")
    keys = ["response_policy", "sample_id", "version"]
    cells = materialize(base.groupBy(*keys, "task_category", "main_error_type").agg(F.min(row).alias("row")))
    n_cells = cells.select("response_policy", "main_error_type").distinct().count() + len(CARD_POLICIES) * len(CARD_TASKS)
    depth = limit + n_cells
    best = lambda *cell: cells.groupBy(*keys, *cell).agg(F.min("row").alias("row")).withColumn("_no", F.row_number().over(Window.partitionBy("response_policy", *cell).orderBy("row"))).filter(F.col("_no") <= depth).select("row")
    by_task = best("task_category").filter(F.col("row.response_policy").isin(*CARD_POLICIES) & F.col("row.task_category").isin(*CARD_TASKS))
    by_error = best("main_error_type")
    free = cells.groupBy(*keys).agg(F.min("row").alias("row")).select("row").orderBy("row").limit(depth)
    rest = base.select(row).orderBy("row").limit(depth)
    found = by_task.withColumn("step", F.lit(1)).unionByName(by_error.withColumn("step", F.lit(2))).unionByName(free.withColumn("step", F.lit(3))).unionByName(rest.withColumn("step", F.lit(4)))
    rows = sorted(((r["step"], r["row"]) for r in found.collect()), key=lambda x: tuple(x[1]))  # at most cells times depth
    chosen = [(*(card[c] for c in ("run_id", "sample_id", "version", "task_category", "response_policy", "main_error_type", "priority", "score")), phase, no) for no, (card, phase) in enumerate(_choose(rows, limit), 1)]
    types = dict(base.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("run_id", "sample_id", "version", "task_category", "response_policy", "main_error_type", "priority", "score")) + ", phase int, card_no int"
    return base.sparkSession.createDataFrame(chosen, schema)


def _choose(rows: list, limit: int) -> list:
    """The cards and their phases, out of ranked (step, row)."""
    taken: dict = {}
    key_of = lambda r: (r["sample_id"], r["version"], r["response_policy"])
    keys: set = set()

    def take(cards, phase: int, most: int) -> None:
        for r in cards:
            if most <= 0:
                return
            if r["run_id"] not in taken and (phase == 4 or key_of(r) not in keys):
                taken[r["run_id"]] = (r, phase)
                keys.add(key_of(r))
                most -= 1

    cells: dict = {}
    for step, r in rows:
        cells.setdefault((step, r["response_policy"], r["task_category"] if step == 1 else r["main_error_type"] if step == 2 else "") if step < 3 else step, []).append(r)
    for policy in CARD_POLICIES:
        for task in CARD_TASKS:
            take(cells.get((1, policy, task), ()), 1, 1)
    for cell in [c for c in cells if c not in (3, 4) and c[0] == 2]:  # in the order of their first rows
        take(cells[cell], 2, 1)
    take(cells.get(3, ()), 3, limit - len(taken))
    take(cells.get(4, ()), 4, limit - len(taken))
    return list(taken.values())
