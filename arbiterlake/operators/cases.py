"""Case banks: import to evaluation tables, validation, taxonomy migration, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, filled, points, shorten
from ..functions.values import ASSET_ROUTES

#: Words of a row that must not leave the house.
PRIVATE = r"(?i)(password|secret|api[_-]?key|1[3-9][0-9]{9}|[0-9]{17}[0-9x])"


#: Fixed texts and names of imported cases.
CONTEXT_ONLY = "仅可使用以下提供材料作答："
NO_CONTEXT = "未提供额外背景材料；用户问题中包含模型可见事实。"
NOTHING_TO_ASK = "如事实不足，应明确说明无需补充或列出待核验事项。"
TOTAL = "总分"
CASE_DIMENSIONS = ((("结论",), "Case Conclusion"), (("案情", "事实"), "Legal Facts"), (("分析", "推理"), "Legal Reasoning"), (("法条", "依据"), "Statute Basis"))
CRITICAL_DIMENSIONS = ("citation_fidelity", "risk_calibration", "human_review_routing")


def keyword_case(c: Column, rules: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """The value of the first rule of which some word is in the lower-cased text."""
    text, made = F.lower(clean(c)), F.lit(otherwise)
    for words, value in reversed(rules):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        made = F.when(found, value).otherwise(made)
    return made


def import_cases(cases: DataFrame, source: str = "case_bank", jurisdiction: str = "", snapshot: str = "", boundary: str = "", rules: tuple[str, str, str] = ("", "", ""), negative: str = "") -> dict[str, DataFrame]:
    """Evaluation input, gold, rubric and metadata of a case bank with ``case_id``, ``user_prompt``, ``rubric`` and lists.

    Columns that the bank lacks count as empty. ``provided_context`` is an array of ``source_id``, ``text``. A rubric
    weight that is missing or zero counts as one; ``rules`` are the scoring rules for two, one and no points.
    """
    text = lambda c: clean(c) if c in cases.columns else F.lit("")
    listed = lambda c: F.array_join(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), clean), lambda x: x != ""), "；") if c in cases.columns else F.lit("")
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "；")
    labelled = lambda label, c: F.when(listed(c) != "", F.concat(F.lit(label), listed(c))).otherwise("")
    review = F.coalesce(F.col("expected_human_review").cast("boolean"), F.lit(False)) if "expected_human_review" in cases.columns else F.lit(False)
    part = slice_columns(text("task_type"), text("slice"), review)
    yes = lambda c: F.when(c, "yes").otherwise("no")
    context = F.lit("")
    if "provided_context" in cases.columns:
        line = lambda x: F.when(clean(x["source_id"]) != "", F.concat(F.lit("["), clean(x["source_id"]), F.lit("] "), clean(x["text"]))).otherwise(clean(x["text"]))
        context = F.array_join(F.filter(F.transform(F.coalesce("provided_context", F.array().cast(cases.schema["provided_context"].dataType)), line), lambda x: x != ""), "\n")
    common = (clean("case_id").alias("sample_id"), F.lit(source).alias("source_dataset"), part["task_category"].alias("task_category"))
    pair = lambda c: F.when(text(c) != "", F.concat(F.lit(f"{c}="), text(c))).otherwise("")
    weight = F.col("r.weight").cast("int")
    rubric = cases.select(*common, F.posexplode("rubric").alias("_pos", "r")).select(
        "sample_id", "source_dataset", "task_category", F.format_string("%s-R%02d", "sample_id", F.col("_pos") + 1).alias("rubric_id"), clean("r.dimension").alias("rubric_dimension"), clean("r.criterion").alias("atomic_rubric_item"),
        F.when(weight.isNull() | (weight == 0), 1).otherwise(weight).alias("max_score"), *(F.lit(rule).alias(f"scoring_rule_{2 - i}") for i, rule in enumerate(rules)),
        F.when(clean("r.dimension").isin(*CRITICAL_DIMENSIONS), "high").otherwise("medium").alias("criticality"), F.lit(negative).alias("negative_rule"),
    )
    return {
        "eval_input": cases.select(
            *common, text("user_prompt").alias("user_question"), F.when(context != "", F.concat(F.lit(CONTEXT_ONLY + "\n"), context)).otherwise(NO_CONTEXT).alias("known_facts"),
            F.concat(F.lit("task_type="), text("task_type"), F.lit("；product_boundary_eval_visible_context_only")).alias("legal_concepts"),
            *(F.when(text(c) != "", text(c)).otherwise(d).alias(c) for c, d in (("jurisdiction", jurisdiction), ("law_snapshot_date", snapshot))), text("task_type").alias("task_type"), F.lit(boundary).alias("legal_advice_boundary"),
        ),
        "gold_labels": cases.select(
            *common, listed("missing_facts").alias("key_missing_facts"), F.when(listed("missing_facts") != "", F.concat(F.lit("应追问："), listed("missing_facts"))).otherwise(NOTHING_TO_ASK).alias("expected_clarification_questions"),
            joined(text("expected_behavior"), labelled("关键事实：", "critical_facts"), labelled("允许来源：", "allowed_sources")).alias("expected_answer_points"),
            F.concat(F.lit("禁止主张："), listed("forbidden_claims"), F.lit("；关键失败："), listed("critical_failure_triggers"), F.lit("；expected_human_review="), F.initcap(review.cast("string"))).alias("risk_points"), text("expected_behavior").alias("expected_behavior"),
            joined(F.concat(F.lit("slice="), text("slice")), F.concat(F.lit("expected_data_asset_routes="), listed("expected_data_asset_routes")), pair("pair_id"), pair("pair_variant")).alias("human_review_note"),
        ),
        "rubric_items": rubric,
        "sample_metadata": cases.select(
            *common, text("slice").alias("legal_domain"), part["difficulty"].alias("difficulty"), part["risk_level"].alias("risk_level"), F.lit("Eval_Input visible to agent; gold/rubric visible only to judge and human review.").alias("visibility_policy"),
            yes(text("slice") == "normal_practice").alias("core_sample_flag"), yes(text("slice").isin("risk_calibration", "adversarial_trap")).alias("deep_badcase_flag"), yes(review).alias("human_review_required"),
        ),
    }


def case_errors(cases: DataFrame, required: Sequence[str], enums: Mapping[str, Sequence[str]], private: str = PRIVATE) -> DataFrame:
    """``case_id`` and ``message`` of every broken rule: fields, values, weights, duplicates, pairs, private data."""
    columns = set(cases.columns)
    checks = [(~filled(c), f"missing {c}") for c in required if c in columns]
    checks += [(filled(c) & ~clean(c).isin(*v), f"invalid {c}") for c, v in enums.items() if c in columns]
    if "rubric" in columns:
        checks.append((F.exists("rubric", lambda r: r["weight"] <= 0) | (F.coalesce(F.size("rubric"), F.lit(0)) == 0), "rubric needs positive weights"))
    if "expected_data_asset_routes" in columns:
        checks.append((F.size(F.array_except("expected_data_asset_routes", F.array(*map(F.lit, ASSET_ROUTES)))) > 0, "invalid asset route"))
    checks.append((F.to_json(F.struct(*cases.columns)).rlike(private), "private data"))
    made = cases.select("case_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("message"))
    made = made.unionByName(cases.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("duplicate case_id").alias("message")))
    absent = [c for c in required if c not in columns]
    if absent:
        made = made.unionByName(cases.select("case_id", F.explode(F.array(*(F.lit(f"missing {c}") for c in absent))).alias("message")))
    if {"pair_id", "pair_variant"} <= columns:
        pairs = cases.filter(filled("pair_id")).groupBy("pair_id").agg(F.array_sort(F.collect_set("pair_variant")).alias("v"), F.min("case_id").alias("case_id"))
        made = made.unionByName(pairs.filter(~F.col("v").eqNullSafe(F.array(F.lit("A"), F.lit("B")))).select("case_id", F.lit("incomplete pair").alias("message")))
    return made


def migrate_routes(cases: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    """Old route names by new ones, in canonical order, without repeats."""
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))))
    renamed = F.transform(column, lambda r: F.coalesce(F.try_element_at(table, r), r))
    return cases.withColumn(column, F.filter(F.array(*map(F.lit, ASSET_ROUTES)), lambda r: F.array_contains(renamed, r)))


def with_provenance(corpus: DataFrame, official: Sequence[str]) -> DataFrame:
    """Provenance status by source type, and the content hash."""
    status = F.when(F.col("source_type").isin(*official), "official_reference").otherwise("synthetic_or_summary")
    return corpus.withColumns({"provenance_status": status, "content_sha256": F.sha2(F.coalesce("text", F.lit("")), 256), "publishable_as_authoritative_source": F.col("source_type").isin(*official)})


def rubric_items(c: Column, dimension: str, most: int = 12) -> Column:
    """Items (``dimension``, ``points``, ``item``) of a rubric whose numbered points start lines; the whole text if there is none.

    Totals, and short lines that name no points, are no items. ``most`` is the importer's own limit.
    """
    text = F.replace(clean(c), F.lit("\r\n"), F.lit("\n"))
    item = lambda t: F.struct(F.lit(dimension).alias("dimension"), points(t, 2).alias("points"), shorten(t, 900).alias("item"))
    parts = F.transform(F.split(text, r"\n(?=\s*[0-9]+[.、．])"), clean)
    found = F.filter(parts, lambda t: (t != "") & ~F.startswith(t, F.lit(TOTAL)) & (F.contains(t, F.lit("分")) | (F.length(t) >= 12)))
    return F.when(F.size(found) > 0, F.transform(F.slice(found, 1, most), item)).otherwise(F.array(item(text)))


def section_items(c: Column, dimension: str = "Document Rubric", most: int = 12) -> Column:
    """Items of a rubric in sections 一、二、三: the heading without its points is the dimension; numbered items if there is no section."""
    text = F.replace(clean(c), F.lit("\r\n"), F.lit("\n"))
    parts = F.transform(F.split(F.concat(F.lit("\n"), text), r"\n(?=[一二三四五六七八九十]+[、.．])"), clean)
    found = F.filter(parts, lambda t: (t != "") & ~F.startswith(t, F.lit(TOTAL)))

    def item(t: Column) -> Column:
        heading = F.regexp_replace(F.regexp_replace(clean(F.split(t, "\n")[0]), r"（.*?分.*?）|\(.*?分.*?\)", ""), r"^[ 、.．]+|[ 、.．]+$", "")
        return F.struct(F.when(heading != "", heading).otherwise(dimension).alias("dimension"), points(t, 10).alias("points"), shorten(t, 1000).alias("item"))

    return F.when(F.size(found) > 0, F.transform(F.slice(found, 1, most), item)).otherwise(rubric_items(c, dimension, most))


def benchmark_rubrics(rows: DataFrame, kind: str, source: str, rules: tuple[str, str, str] = ("", "", ""), negative: str = "") -> DataFrame:
    """Rubric rows of an imported benchmark: ``sample_id``, and ``rubrics`` as text (*consultation*, *document_drafting*) or as an array of ``criterion``, ``tags``, ``points`` (*case_analysis*)."""
    if kind == "case_analysis":
        def named(r: Column) -> Column:
            worth = F.when(clean(r["points"]) != "", clean(r["points"]).try_cast("double").cast("int")).otherwise(points(r["criterion"], 5))
            return F.struct(keyword_case(r["tags"], CASE_DIMENSIONS, "Case Analysis").alias("dimension"), worth.alias("points"), shorten(r["criterion"], 1000).alias("item"))

        made = F.transform("rubrics", named)
    else:
        made = rubric_items(F.col("rubrics"), "Clarification Coverage") if kind == "consultation" else section_items(F.col("rubrics"))
    high = 3 if kind == "consultation" else 2
    return rows.select("sample_id", F.posexplode(made).alias("_pos", "r")).select(
        "sample_id", F.lit(source).alias("source_dataset"), F.lit(kind).alias("task_category"), F.format_string("%s-R%02d", "sample_id", F.col("_pos") + 1).alias("rubric_id"), F.col("r.dimension").alias("rubric_dimension"),
        F.col("r.item").alias("atomic_rubric_item"), F.col("r.points").alias("max_score"), *(F.lit(rule).alias(f"scoring_rule_{2 - i}") for i, rule in enumerate(rules)), F.when(F.col("_pos") < high, "high").otherwise("medium").alias("criticality"), F.lit(negative).alias("negative_rule"),
    )


def import_benchmark(items: DataFrame, kind: str, prefix: str, source: str, order: str, limit: int, fixed: Mapping[str, str] | None = None, **rubric) -> dict[str, DataFrame]:
    """The four tables of the first ``limit`` items of a benchmark by ``order``.

    *case_analysis* asks ``question`` about ``context`` under ``label``; *consultation* and *document_drafting* work on a
    ``conversation``, the latter under ``tag``. ``fixed`` gives the texts of other columns. Only the limited items are numbered.
    """
    text = lambda c, default="": F.when(filled(c), clean(c)).otherwise(default) if c in items.columns else F.lit(default)
    say = dict(fixed or {})
    given = lambda c: F.lit(say.get(c, ""))
    first = items.orderBy(order).limit(limit).withColumn("_no", F.row_number().over(Window.orderBy(order)))  # a stated, small number of items
    rows = first.withColumn("sample_id", F.format_string(f"{prefix}-%03d", F.col("_no")))
    case, document = kind == "case_analysis", kind == "document_drafting"
    domain = text("label", say.get("label", "")) if case else text("tag", say.get("task_type", "")) if document else given("legal_concepts")
    common = ("sample_id", F.lit(source).alias("source_dataset"), F.lit(kind).alias("task_category"))
    asked = {
        "user_question": text("question") if case else text("conversation") if document else given("user_question"), "known_facts": text("context") if case else given("known_facts") if document else text("conversation"), "legal_concepts": domain,
    }
    rubrics = text("rubrics") if not case else F.array_join(F.transform("rubrics", lambda r: shorten(r["criterion"], 180)), "；")
    facts = rubrics if kind == "consultation" else None
    level = "medium" if case else "high"
    flag = "no" if case else "yes"
    return {
        "eval_input": rows.select(*common, *(c.alias(n) for n, c in asked.items()), *(given(c).alias(c) for c in ("jurisdiction", "law_snapshot_date", "task_type", "legal_advice_boundary"))),
        "gold_labels": rows.select(
            *common, *((facts if facts is not None else given(c)).alias(c) for c in ("key_missing_facts", "expected_clarification_questions")), (given("expected_answer_points") if facts is not None else rubrics).alias("expected_answer_points"),
            *(given(c).alias(c) for c in ("risk_points", "expected_behavior", "human_review_note")),
        ),
        "rubric_items": benchmark_rubrics(rows, kind, source, **rubric),
        "sample_metadata": rows.select(
            *common, domain.alias("legal_domain"), F.lit("medium" if case else "hard").alias("difficulty"), F.lit(level).alias("risk_level"), given("visibility_policy").alias("visibility_policy"), F.lit("no").alias("core_sample_flag"),
            *(F.lit(flag).alias(c) for c in ("deep_badcase_flag", "human_review_required")),
        ),
    }


def numbered_items(c: Column) -> Column:
    """Items of a numbered list: what follows 1. 2) （3） and the like."""
    parts = F.split(clean(c), r"(?=(?:^|\n)\s*[（(]?[0-9]{1,2}[.)、）])")
    return F.filter(F.transform(parts, lambda p: clean(F.regexp_replace(p, r"^\s*[（(]?[0-9]{1,2}[.)、）]", ""))), lambda p: p != "")


#: Fixed values of the slices.
HARD_SLICES = ("hard_legal_reasoning", "risk_calibration", "adversarial_trap", "counterfactual_pair")
MEDIUM_RISK_SLICES = ("hard_legal_reasoning", "citation_grounding", "counterfactual_pair")


def slice_columns(task_type: Column, slice_name: Column, expects_review: Column) -> dict[str, Column]:
    """Task category, difficulty and risk level of an imported case."""
    kind, part = clean(task_type), clean(slice_name)
    return {
        "task_category": F.when(kind == "document_drafting", kind).when(kind.isin("case_analysis", "grounded_qa"), "case_analysis").otherwise("consultation"),
        "difficulty": F.when(part.isin(*HARD_SLICES), "hard").when(part == "citation_grounding", "medium").otherwise("normal"),
        "risk_level": F.when(expects_review, "high").when(part.isin(*MEDIUM_RISK_SLICES), "medium").otherwise("low"),
    }
