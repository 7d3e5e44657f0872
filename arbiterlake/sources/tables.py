"""Sources: delimited, JSON-lines and JSON-array tables, corpora, configuration, literal lookups."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.jsontext import whole
from ..functions.text import clean, filled


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, fill: bool = True) -> DataFrame:
    """A table with header; quoted fields may hold line breaks and doubled quotes. ``fill``: null text becomes empty."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]) if fill else df


def read_optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Like :func:`read_csv`; a missing path gives an empty table of the schema."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Named tables of a folder; all missing ones are reported together."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}.csv")]
    if missing:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    return {n: read_csv(spark, f"{folder}/{n}.csv") for n in names}


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Parsed objects, and ``file``, ``line`` (from 1) and ``value`` of the lines that are not objects of the schema.

    A line's number is its place in its split plus the lines of the splits before it in the file: one small
    table of line counts, so that no line leaves its task for being numbered.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", place.alias("_split"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_split.file").orderBy("_split.start").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    full = lines.filter(F.trim("value") != "")
    good = whole(F.col("value")) & F.ltrim("value").startswith("{")
    parsed = full.filter(good).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_row")).select("_row.*")
    bad = full.filter(~good).join(counts, "_split")
    return parsed, bad.select(F.col("_split.file").alias("file"), (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns and rows that are all null, text trimmed."""
    some = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    kept = df.select(*(c for c in df.columns if some[c])).na.drop(how="all")
    return kept.select(*(clean(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in kept.schema.fields))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").select(key)


def load_corpus(df: DataFrame, required: Sequence[str] = ("source_id", "title", "source_type", "jurisdiction", "text")) -> DataFrame:
    """A retrieval corpus with trimmed ids and texts; raises on missing columns or repeated ids."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"corpus lacks columns {missing}")
    made = df.withColumns({"source_id": clean("source_id"), "text": clean("text")})
    again = [r[0] for r in duplicates(made, "source_id").limit(10).collect()]
    if again:
        raise ValueError(f"corpus repeats ids {again}")
    return made


def lookup(keys: DataFrame, table: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row by ``order`` of every asked key, and the keys that the table lacks."""
    first = Window.partitionBy(key).orderBy(order)
    wanted = keys.select(key).distinct()
    found = table.join(wanted, key, "left_semi").withColumn("_no", F.row_number().over(first)).filter("_no = 1").drop("_no")
    return found, wanted.join(table, key, "left_anti")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left key must have a match; raises and names the first that lack one."""
    missing = [r[0] for r in left.select(key).distinct().join(right, key, "left_anti").limit(10).collect()]
    if missing:
        raise ValueError(f"no match for {missing}")
    return left.join(right, key)


def listed(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have one of the comma-separated values; an empty list keeps all, an unknown value raises."""
    for column, text in wanted.items():
        values = [v.strip() for v in (text or "").split(",") if v.strip()]
        if not values:
            continue
        known = {r[0] for r in df.filter(F.col(column).isin(*values)).select(column).distinct().collect()}  # at most the values asked for
        if unknown := sorted(set(values) - {str(k) for k in known}):
            raise ValueError(f"unknown {column}: {unknown}")
        df = df.filter(F.col(column).isin(*values))
    return df


def nest_rubrics(gold: DataFrame, rubrics: DataFrame, key: str = "sample_id") -> DataFrame:
    """Gold rows with their rubric rows as an array, empty if there are none."""
    rest = [c for c in rubrics.columns if c != key]
    nested = rubrics.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rubric_items"))
    kind = nested.schema["rubric_items"].dataType
    return gold.drop("rubric_items").join(nested, key, "left").withColumn("rubric_items", F.coalesce("rubric_items", F.array().cast(kind)))


def visible_only(df: DataFrame, visible: Sequence[str], hidden: Sequence[str], categories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The visible columns, and rows without a valid category; raises if a hidden column came along."""
    leaked = sorted(set(hidden) & set(df.columns))
    if leaked:
        raise ValueError(f"gold columns in the input: {leaked}")
    bad = df.filter(~filled("task_category") | ~F.col("task_category").isin(*categories))
    return df.select(*visible), bad


def expand_env(value, env: Mapping[str, str] | None = None):
    """Replace ``${NAME}`` in all text of a configuration; unknown names become empty."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value
