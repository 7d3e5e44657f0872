"""Judge payload normalisation, mock judging, ensembles and disagreement."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import first_object
from ..functions.text import alias_key, clean
from ..functions.values import ASSET_ROUTES, POLICIES, canonical, error_tags, hash_bits, number, parse_bool, tag_names
from .routing import route

#: Fixed vocabularies of the score sheet.
DIMENSIONS = (
    "missing_facts_awareness", "clarification_quality", "legal_grounding", "fact_rule_application", "conditional_reasoning",
    "risk_coverage", "overclaim_control", "hallucination_control", "data_tag_usability",
)
CRITICAL = ("fabricated_citation", "unsafe_action_suggestion", "needs_human_review", "unverified_basis")
RISKS = ("low", "medium", "high")


def risk_of_score(score: Column) -> Column:
    return F.when(score < 0.45, "high").when(score < 0.72, "medium").otherwise("low")


def normalize_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """Add clipped scores, recomputed totals, known tags and levels from a JSON judge payload."""
    get = lambda path: F.get_json_object(column, f"$.{path}")
    whole = lambda c, default: F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(high if isinstance(high, Column) else F.lit(high), c))
    dims = F.create_map(*(x for d in DIMENSIONS for x in (F.lit(d), clip(whole(get(f"dimension_scores.{d}"), 0), 0, 2))))
    items = F.coalesce(F.from_json(get("atomic_scores"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))

    def atomic(x: Column) -> Column:
        top = clip(whole(F.try_element_at(x, F.lit("max_score")), 2), 1, 2)
        text = lambda k: clean(F.try_element_at(x, F.lit(k)))
        return F.struct(
            text("rubric_id").alias("rubric_id"), text("atomic_rubric_item").alias("atomic_rubric_item"),
            clip(whole(F.try_element_at(x, F.lit("score")), 0), 0, top).alias("score"), top.alias("max_score"), text("rationale").alias("rationale"),
        )

    made = df.withColumns({"dimension_scores": dims, "atomic_scores": F.transform(F.filter(items, lambda x: x.isNotNull()), atomic)})
    add = lambda a, x: a + x
    total = F.aggregate(F.map_values("dimension_scores"), F.lit(0), add) + F.aggregate(F.transform("atomic_scores", lambda s: s["score"]), F.lit(0), add)
    most = F.lit(2 * len(DIMENSIONS)) + F.aggregate(F.transform("atomic_scores", lambda s: s["max_score"]), F.lit(0), add)
    made = made.withColumns({"total_score": total, "max_score": most}).withColumn("score_rate", F.round(F.col("total_score") / F.col("max_score"), 3))
    level = lambda k: F.lower(clean(get(k)))
    return made.withColumns({
        "error_tags": error_tags(get("error_tags")),
        "risk_level": F.when(level("risk_level").isin(*RISKS), level("risk_level")).otherwise(risk_of_score(F.col("score_rate"))),
        "judge_confidence": F.when(level("judge_confidence").isin(*RISKS), level("judge_confidence")).otherwise("medium"),
        "judge_reason": clean(get("judge_reason")), "needs_human_review": parse_bool(get("needs_human_review")),
    })


def mock_dimension_scores(key: Column) -> Column:
    """A score of one or two per dimension from the low bits of the key's SHA-256."""
    bits = hash_bits(key, len(DIMENSIONS))
    return F.create_map(*(x for i, d in enumerate(DIMENSIONS) for x in (F.lit(d), F.get(bits, F.lit(i)) + 1)))


def exclude_self(pairs: DataFrame) -> DataFrame:
    """Drop judges that share an alias, vendor, family or model name with the answer's model; a run with none left keeps its first judge.

    ``pairs``: one row per run and judge with ``run_id``, ``judge_order``, ``model_*`` of the answer and ``judge_*`` of the judge.
    """
    names = lambda prefix: F.filter(F.array(*(alias_key(F.col(f"{prefix}_{k}")) for k in ("alias", "vendor", "family", "name"))), lambda x: x != "")
    marked = pairs.withColumn("_self", F.arrays_overlap(names("model"), names("judge")))
    run = Window.partitionBy("run_id")
    first = F.row_number().over(run.orderBy("judge_order"))
    return marked.withColumns({"_free": F.min(F.col("_self").cast("int")).over(run), "_no": first}).filter(~F.col("_self") | ((F.col("_free") == 1) & (F.col("_no") == 1))).drop("_self", "_free", "_no")


#: Primary routes that the router gives.
DATA_ROUTES = ("human_review", "badcase", "preference", "sft", "eval")


def _most_common(column: str, words: tuple[str, ...]) -> Column:
    """The most common of the words, ties going to the judge that comes first by ``judge_order``."""
    one = lambda w: F.struct(F.count_if(F.col(column) == w).alias("n"), -F.min(F.when(F.col(column) == w, F.col("judge_order"))).alias("o"), F.lit(w).alias("w"))
    return F.greatest(*map(one, words))["w"]


def _by_role(scores: DataFrame) -> DataFrame:
    """One row per run and judge role: routed where the rows are, then dealt by run once for all aggregates to come."""
    rows = scores.filter(F.col("judge_role").isin("primary", "arbiter")).withColumns({"_score": number(F.col("score_rate")), "_risk": clean("risk_level")})
    routed = route(rows, ("judge_role", "judge_order", "_score", "_risk"))
    held = lambda words, present: functools.reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.array_contains(present, w), 1 << i).otherwise(0) for i, w in enumerate(words)))
    # tags, routes and choices travel and meet as small numbers; the tags are those that the router has parsed already
    routed = routed.select(
        "run_id", "judge_role", "judge_order", "_score", "_risk", "response_policy", "data_route",
        held(CRITICAL, tag_names(F.col("error_tags"))).alias("_critical"), held(ASSET_ROUTES, F.col("data_asset_routes")).alias("_routes"),
    ).repartition("run_id")
    level = F.when(F.col("_risk").isin(*RISKS), F.array_position(F.array(*map(F.lit, RISKS)), F.col("_risk")) - 1).otherwise(1)
    return routed.groupBy("run_id", "judge_role").agg(
        F.count("*").alias("n"), F.round(F.max("_score") - F.min("_score"), 3).alias("gap"), (F.min("_critical") != F.max("_critical")).alias("tags_differ"),
        (F.min("response_policy") != F.max("response_policy")).alias("policies_differ"), F.round(F.avg(F.col("_score").cast("decimal(18,6)")).cast("double"), 3).alias("score"),
        F.max_by("_risk", F.struct(level, -F.col("judge_order"))).alias("risk"), F.max((F.col("response_policy") == "block").cast("int")).alias("block"),
        F.filter(F.array(*(F.when(F.bit_or("_routes").bitwiseAND(F.lit(1 << i)) != 0, F.lit(r)) for i, r in enumerate(ASSET_ROUTES))), lambda r: r.isNotNull()).alias("routes"), _most_common("response_policy", POLICIES).alias("policy"), _most_common("data_route", DATA_ROUTES).alias("route"),
    )


def _reasons(n: Column, gap: Column, tags: Column, policies: Column, threshold: float) -> Column:
    return F.concat_ws("|", *(F.when(c, F.lit(t)) for c, t in (
        (n < 2, "single_primary_after_self_eval_exclusion"), (gap >= threshold, "score_gap"), (tags, "critical_failure_mismatch"), (policies, "response_policy_mismatch"),
    )))


def disagreement(scores: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per run: gap of the primary judges' scores, differing critical tags or policies, and whether to arbitrate."""
    rows = _by_role(scores.filter(F.col("judge_role") == "primary"))
    made = rows.select("run_id", F.col("n").alias("primary_judge_count"), F.col("gap").alias("score_gap"), _reasons(F.col("n"), F.col("gap"), F.col("tags_differ"), F.col("policies_differ"), threshold).alias("disagreement_reasons"))
    return made.withColumn("requires_arbitration", F.col("disagreement_reasons") != "")


def ensemble_summary(scores: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Final score, risk, policy, status and routes of every run; an arbiter's row replaces the primary ones.

    The most common policy wins, ties going to the judge that comes first by ``judge_order``.
    """
    rows = _by_role(scores)
    whole = F.struct(*(c for c in rows.columns if c not in ("run_id", "judge_role")))
    of = lambda role: F.any_value(F.when(F.col("judge_role") == role, whole), True)
    made = rows.groupBy("run_id").agg(of("primary").alias("_p"), of("arbiter").alias("_a")).withColumn("_c", F.coalesce("_a", "_p"))
    p, c, arbited = F.col("_p"), F.col("_c"), F.col("_a").isNotNull()
    reasons = F.coalesce(F.when(p.isNotNull(), _reasons(p["n"], p["gap"], p["tags_differ"], p["policies_differ"], threshold)), F.lit(""))
    made = made.withColumn("disagreement_reasons", reasons).withColumn("requires_arbitration", F.col("disagreement_reasons") != "")
    open_ = F.col("requires_arbitration") & ~arbited
    made = made.withColumn("final_response_policy", F.when(c["block"] == 1, "block").when(open_, "human_review").otherwise(c["policy"]))
    held = F.col("final_response_policy").isin("human_review", "block")
    return made.select(
        "run_id", F.when(arbited, "arbitrated").when(F.col("requires_arbitration"), "needs_human_calibration").otherwise("stable").alias("ensemble_status"),
        c["score"].alias("final_score_rate"), c["risk"].alias("final_risk_level"),
        F.when(F.col("final_response_policy") == "block", "blocked").when(F.col("final_response_policy") == "human_review", "pending_review").otherwise("released").alias("final_workflow_status"),
        "final_response_policy", canonical(ASSET_ROUTES, c["routes"]).alias("final_data_asset_routes"),
        F.when(held, "human_review").otherwise(c["route"]).alias("final_data_route"), "requires_arbitration", (held | open_).alias("requires_human_calibration"), "disagreement_reasons",
    )


#: Fixed results of runs that no judge can score: subtype of the tag, reason.
UNSCORED = {
    "empty_output": ("empty_model_output", "API call completed but returned empty answer content"),
    "failed": ("model_run_failed", "model run failed before judging"),
    "unparsed": ("judge_parse_failed", "judge output parse failed"),
}


#: Fixed words of the gold texts and the subtypes of error that they name, in order.
SUBTYPES = (
    ("因果", "missing_causation"), ("平台", "platform_liability_unclear"), ("贷款", "unsafe_repayment_advice"), ("定金", "deposit_term_confusion"),
    ("素材", "missing_ip_risk"), ("劳动", "employment_status_unclear"), ("证据", "evidence_chain_unclear"), ("管辖", "jurisdiction_unclear"),
)


def gold_subtype(*texts: Column, rules: Sequence[tuple[str, str]] = SUBTYPES, otherwise: str = "general_legal_risk") -> Column:
    """Subtype of error that the first rule's word in the gold texts names; null texts are empty."""
    whole = F.concat_ws(" ", *(clean(t) for t in texts))
    return F.coalesce(*(F.when(F.contains(whole, F.lit(w)), F.lit(s)) for w, s in rules), F.lit(otherwise))


def judge_pass(runs: DataFrame, raw: str = "raw_judge_output", status: str = "run_status") -> DataFrame:
    """Score rows of runs and their judge's raw output.

    The first JSON object of the output is normalised. A run that is not ``ok``, and an output without such an
    object, scores zero with high risk, low confidence and a tag that sends it to review; only the latter
    counts as not parsed.
    """

    ok = clean(status) == "ok"
    made = runs.withColumn("_found", F.when(ok, first_object(F.col(raw))))
    case = F.when(clean(status) == "empty_output", "empty_output").when(~ok, "failed").when(F.col("_found").isNull(), "unparsed")

    def substitute(kind: str) -> Column:
        subtype, reason = UNSCORED[kind]
        return F.lit(json.dumps({"error_tags": [{"coarse_error_tag": "needs_human_review", "error_subtype": subtype}], "risk_level": "high", "judge_confidence": "low", "judge_reason": reason, "needs_human_review": True}))

    payload = F.col("_found")
    for kind in UNSCORED:
        payload = F.when(F.col("_case") == kind, substitute(kind)).otherwise(payload)
    made = made.withColumn("_case", F.coalesce(case, F.lit(""))).withColumn("payload", payload)
    return normalize_payload(made).withColumn("parsed_ok", F.col("_case") != "unparsed").drop("_found", "_case", "payload")
