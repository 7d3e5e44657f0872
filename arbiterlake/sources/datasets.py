"""Evaluation datasets: folders of sheets, manifests, configuration, templates, public packages and evidence files.

A workbook is an .xlsx file or a folder with one CSV table per sheet. Manifests and configuration are JSON, or YAML where the library is installed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.jsontext import whole
from ..functions.text import clean, filled
from ..operators.cases import keyword_case
from . import tables, workbook

#: Fixed columns of the dataset's tables.
VISIBLE = ("sample_id", "source_dataset", "task_category", "user_question", "known_facts", "legal_concepts", "jurisdiction", "law_snapshot_date", "task_type", "legal_advice_boundary")
GOLD = ("sample_id", "source_dataset", "task_category", "key_missing_facts", "expected_clarification_questions", "expected_answer_points", "risk_points", "expected_behavior", "rubric_items", "human_review_note")
SHARED = ("sample_id", "source_dataset", "task_category")
RUBRIC = ("rubric_id", "rubric_dimension", "atomic_rubric_item", "max_score", "scoring_rule_2", "scoring_rule_1", "scoring_rule_0", "criticality", "negative_rule")
METADATA = ("sample_id", "source_dataset", "task_category", "legal_domain", "difficulty", "risk_level", "visibility_policy", "core_sample_flag", "deep_badcase_flag", "human_review_required")
NORMAL_SHEETS, OLD_SHEETS = ("Eval_Input", "Gold_Labels", "Rubric_Items"), ("Task_Set", "Sample_Index", "Rubric_Items")
CATEGORY_WORDS = ((("draft", "rewrite", "文书", "起诉状", "函"), "document_drafting"), (("analysis", "claim verification", "case", "案例"), "case_analysis"))
FLAGS = {"core_sample_flag": "yes", "deep_badcase_flag": "no", "human_review_required": "no"}


def read_text(spark: SparkSession, path: str) -> str:
    """One small file as text; hidden and empty files too, which table readers skip."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    source = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in the store that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_env(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and values of a file of ``NAME=value`` lines; comments and other lines are skipped, quotes around values go; no file, no names."""
    if not tables.exists(spark, path):
        return {}
    pairs = (line.strip().removeprefix("export ").partition("=") for line in read_text(spark, path).splitlines() if not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in pairs if eq and k.strip()}


def read_config(spark: SparkSession, path: str, env: Mapping[str, str] | None = None) -> dict:
    """A configuration with ``${NAME}`` filled in; an empty file is an empty configuration."""
    text = read_text(spark, path).strip()
    try:
        found = json.loads(text or "{}")
    except ValueError:
        import yaml  # only needed for files that are not JSON

        found = yaml.safe_load(text) or {}
    return tables.expand_env(found, env)


def read_templates(spark: SparkSession, folder: str, suffix: str = ".md") -> dict[str, str]:
    """Prompt templates of a folder by file name without suffix; a handful of small files."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return {r["name"].removesuffix(suffix): r["value"] for r in files.collect()}


def read_sheet(spark: SparkSession, folder: str, sheet: str) -> DataFrame:
    """A sheet without empty columns and rows, with trimmed text; ``folder`` may be a workbook."""
    if _is_workbook(folder):
        return _trimmed(workbook.read_sheet(spark, folder, sheet))
    return _trimmed(tables.drop_empty(tables.read_csv(spark, f"{folder}/{sheet}.csv", fill=False)))


def _is_workbook(folder: str) -> bool:
    return folder.lower().endswith(".xlsx")


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*(clean(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def sheet_kind(spark: SparkSession, folder: str) -> str:
    """*normal* if the folder holds the evaluation, gold and rubric sheets, else *old* if it holds the task sheets; others raise."""
    held = workbook.sheet_names(spark, folder) if _is_workbook(folder) else None
    for kind, names in (("normal", NORMAL_SHEETS), ("old", OLD_SHEETS)):
        if all(n in held if held is not None else tables.exists(spark, f"{folder}/{n}.csv") for n in names):
            return kind
    raise FileNotFoundError(f"neither {NORMAL_SHEETS} nor {OLD_SHEETS} in {folder}")


def _or(df: DataFrame, name: str, default: str = ""):
    """The trimmed column, or the default where it is empty or absent."""
    return F.when(filled(name), clean(name)).otherwise(default) if name in df.columns else F.lit(default)


def category(df: DataFrame):
    """Task category from the words of type and domain."""
    return keyword_case(F.concat(_or(df, "task_type"), F.lit(" "), _or(df, "legal_domain")), CATEGORY_WORDS, "consultation")


def _gold(df: DataFrame, source: str, note) -> DataFrame:
    return df.select("sample_id", F.lit(source).alias("source_dataset"), "task_category", *(_or(df, c).alias(c) for c in GOLD[3:8]), note.alias("human_review_note"))


def _rubric(rubric: DataFrame, source: str) -> DataFrame:
    score = F.coalesce(_or(rubric, "max_score", "2").try_cast("double").cast("int"), F.lit(2))
    return rubric.select("sample_id", F.lit(source).alias("source_dataset"), _or(rubric, "task_category").alias("task_category"), *((score if c == "max_score" else _or(rubric, c)).alias(c) for c in RUBRIC))


def from_normal_sheets(evaluation: DataFrame, gold: DataFrame, rubric: DataFrame, source: str, jurisdiction: str = "", snapshot: str = "", boundary: str = "") -> dict[str, DataFrame]:
    """The four tables of a dataset; raises if an evaluation row has no gold row."""
    kind = F.when(_or(evaluation, "task_category") != "", _or(evaluation, "task_category")).otherwise(category(evaluation))
    rows = evaluation.withColumn("task_category", kind)
    defaults = {"source_dataset": F.lit(source), "task_category": F.col("task_category"), "jurisdiction": _or(rows, "jurisdiction", jurisdiction), "law_snapshot_date": _or(rows, "law_snapshot_date", snapshot), "legal_advice_boundary": _or(rows, "legal_advice_boundary", boundary)}
    defaults["task_type"] = F.when(_or(rows, "task_type") != "", _or(rows, "task_type")).otherwise(F.col("task_category"))
    matched = tables.matched(rows.select("sample_id", "task_category"), gold.drop("task_category"), "sample_id")
    return {
        "eval_input": rows.select(*((defaults[c] if c in defaults else _or(rows, c)).alias(c) for c in VISIBLE)),
        "gold_labels": _gold(matched, source, _or(matched, "human_review_note")),
        "rubric_items": _rubric(rubric, source),
        "sample_metadata": rows.select(*((defaults[c] if c in ("source_dataset", "task_category") else _or(rows, c, FLAGS.get(c, ""))).alias(c) for c in METADATA)),
    }


def from_old_sheets(tasks: DataFrame, index: DataFrame, rubric: DataFrame, routing: DataFrame | None, source: str, jurisdiction: str = "", snapshot: str = "", boundary: str = "") -> dict[str, DataFrame]:
    """The tables of a dataset kept as tasks with an index of types: tasks without an index row stay, raises if a task column is missing."""
    missing = [c for c in ("sample_id", "user_question", "known_facts", "legal_concepts", *GOLD[3:8]) if c not in tasks.columns]
    if missing:
        raise ValueError(f"tasks lack {missing}")
    rows = tasks.drop("task_type", "legal_domain").join(index.select("sample_id", *(c for c in ("task_type", "legal_domain") if c in index.columns)), "sample_id", "left")
    if routing is not None and "route_reason" in routing.columns:
        rows = rows.join(routing.select("sample_id", clean("route_reason").alias("_note")).groupBy("sample_id").agg(F.max("_note").alias("_note")), "sample_id", "left")
    rows = rows.withColumn("task_category", category(rows))
    given = {"source_dataset": F.lit(source), "task_category": F.col("task_category"), "jurisdiction": F.lit(jurisdiction), "law_snapshot_date": F.lit(snapshot), "legal_advice_boundary": F.lit(boundary)}
    of_tasks = rubric.drop("task_category").join(rows.select("sample_id", "task_category"), "sample_id")
    return {"eval_input": rows.select(*((given[c] if c in given else _or(rows, c)).alias(c) for c in VISIBLE)), "gold_labels": _gold(rows, source, _or(rows, "_note")), "rubric_items": _rubric(of_tasks, source)}


def build_dataset(spark: SparkSession, folder: str, source: str, extended: Mapping[str, DataFrame] | None = None, **defaults: str) -> dict[str, DataFrame]:
    """A dataset from a folder of sheets of either kind, with the rows of ``extended`` tables of the same names behind it."""
    sheet = lambda n: read_sheet(spark, folder, n)
    if sheet_kind(spark, folder) == "normal":
        made = from_normal_sheets(*map(sheet, NORMAL_SHEETS), source, **defaults)
    else:
        name = "Error_Tags_Data_Routing"
        held = name in workbook.sheet_names(spark, folder) if _is_workbook(folder) else tables.exists(spark, f"{folder}/{name}.csv")
        routing = sheet(name) if held else None
        made = from_old_sheets(*map(sheet, OLD_SHEETS), routing, source, **defaults)
    return {name: df.unionByName(extended[name]) if extended and name in extended else df for name, df in made.items()}


def bundle(evaluation: DataFrame, gold: DataFrame, rubric: DataFrame) -> dict[str, DataFrame]:
    """What a run needs: visible input, gold with its rubric as JSON, rubric and an index; raises if gold columns are in the input or visible ones are not."""
    evaluation, gold, rubric = map(_trimmed, (evaluation, gold, rubric))
    leaked, missing = sorted((set(GOLD) - set(SHARED)) & set(evaluation.columns)), [c for c in VISIBLE if c not in evaluation.columns]
    if leaked or missing:
        raise ValueError(f"evaluation input shows {leaked}, lacks {missing}")
    if "rubric_items" not in gold.columns:
        items = rubric.select("sample_id", *((F.coalesce(_or(rubric, c, "2").try_cast("double").cast("int"), F.lit(2)) if c == "max_score" else _or(rubric, c)).alias(c) for c in RUBRIC))
        gold = tables.nest_rubrics(gold, items).withColumn("rubric_items", F.to_json("rubric_items"))
    else:
        gold = gold.withColumn("rubric_items", F.when(whole(F.col("rubric_items")) & filled("rubric_items"), F.col("rubric_items")).otherwise("[]"))
    seen = evaluation.select(*VISIBLE)
    return {"eval_input": seen, "gold_labels": gold.select(*(_or(gold, c).alias(c) for c in GOLD)), "rubric_items": rubric, "sample_index": seen.select("sample_id", "source_dataset", "task_category", "task_type", "jurisdiction")}


def load_dataset(spark: SparkSession, manifest: str) -> dict[str, DataFrame]:
    """The dataset of a manifest, whose ``files`` name tables beside it; all missing ones are reported together."""
    files = read_config(spark, manifest).get("files") or {}
    root = manifest.rsplit("/", 1)[0]
    paths = [f"{root}/{files.get(n, f'{n}.csv')}" for n in ("eval_input", "gold_labels", "rubric_items")]
    if missing := [p for p in paths if not tables.exists(spark, p)]:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    return bundle(*(tables.read_csv(spark, p) for p in paths))


def write_dataset(made: Mapping[str, DataFrame], folder: str, name: str, version: str, role: str = "") -> dict:
    """Write the tables and a manifest that ``load_dataset`` reads; returns the manifest."""
    from .sinks import write_csv

    spark = made["eval_input"].sparkSession
    for table, df in made.items():
        write_csv(df, f"{folder}/{table}.csv")
    counts = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/eval_input.csv").groupBy("source_dataset").count().collect()  # one row a source
    said = {
        "project": {"name": name, "version": version}, "files": {t: f"{t}.csv" for t in made}, "sources": [{"source_dataset": r[0], "expected_samples": r[1], "role": role} for r in counts],
        "visibility_policy": {"agent_visible": ["eval_input"], "judge_visible": ["eval_input", "gold_labels", "rubric_items"], "never_prompt_visible": ["sample_metadata"]},
    }
    write_text(spark, f"{folder}/dataset_manifest.json", json.dumps(said, ensure_ascii=False, indent=1))
    return said


def copy_files(spark: SparkSession, files: Sequence[str], folder: str) -> None:
    """Copy evidence files; if any is missing none is copied and all missing ones are named."""
    if missing := [f for f in files if not tables.exists(spark, f)]:
        raise FileNotFoundError(f"missing evidence: {', '.join(missing)}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        a, b = jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.hadoop.fs.Path(f"{folder}/{f.rsplit('/', 1)[-1]}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def public_package(made: Mapping[str, DataFrame], allowed: Mapping[str, Sequence[str]], folder: str, private: str) -> dict[str, int]:
    """Write the allowed columns of every table; raises before writing if a row matches ``private``. Returns rows a table."""
    from .sinks import write_csv

    shown = {n: df.select(*(c for c in allowed[n] if c in df.columns)) for n, df in made.items()}
    if found := [n for n, df in shown.items() if not df.filter(F.to_json(F.struct("*")).rlike(private)).isEmpty()]:
        raise ValueError(f"private data in {found}")
    for n, df in shown.items():
        write_csv(df, f"{folder}/{n}")
    return {n: df.count() for n, df in shown.items()}


def file_errors(spark: SparkSession, folder: str, expected: Mapping[str, str]) -> DataFrame:
    """Messages for files of a package that are missing or whose SHA-256 is not the manifest's."""
    from .sinks import file_hashes

    wanted = spark.createDataFrame(list(expected.items()), "subject string, wanted string")
    found = file_hashes(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("subject"), "sha256")
    rows = wanted.join(found, "subject", "left")
    return rows.filter("sha256 is null or sha256 <> wanted").select("subject", F.when(F.col("sha256").isNull(), "missing file").otherwise("hash mismatch").alias("message"))


def table_errors(df: DataFrame, name: str, required: Sequence[str] = (), forbidden: Sequence[str] = (), least: int = 0, most: int | None = None, private: str | None = None) -> DataFrame:
    """Messages for a published table: columns that lack or leak, a row count out of bounds, rows that match ``private``."""
    spark = df.sparkSession
    said = [f"missing column {c}" for c in required if c not in df.columns] + [f"restricted column {c}" for c in forbidden if c in df.columns]
    made = spark.createDataFrame([(name, m) for m in said], "subject string, message string")
    out = F.col("n") < least if most is None else (F.col("n") < least) | (F.col("n") > most)
    made = made.unionByName(df.agg(F.count("*").alias("n")).filter(out).select(F.lit(name).alias("subject"), F.format_string("unexpected number of rows: %d", "n").alias("message")))
    if private and df.columns:
        found = df.agg(F.count_if(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).rlike(private)).alias("n")).filter("n > 0")
        made = made.unionByName(found.select(F.lit(name).alias("subject"), F.format_string("private data in %d rows", "n").alias("message")))
    return made


def width_errors(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``n_rows`` of CSV files with rows of more or fewer fields than their header; quoted fields may hold line breaks."""
    files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path").collect()]  # one row a file of a package
    made = spark.createDataFrame([], "file string, n_rows long")
    for f in files:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("columnPruning", False)
        schema = ", ".join(f"`_c{i}` string" for i in range(len(reader.csv(f).columns))) + ", _bad string"
        rows = reader.option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).schema(schema).csv(f)
        full = rows.agg(F.count("_bad").alias("n_rows"), F.count_if(F.col("_c0").isNotNull() | F.col("_bad").isNotNull()).alias("_n"))  # Spark does not read the bad rows' column alone
        made = made.unionByName(full.filter("n_rows > 0 and _n >= n_rows").select(F.lit(f).alias("file"), "n_rows"))
    return made
