"""Sinks: delimited output with nested columns as JSON, idempotent logs, immutable attempts, merged shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators.assets import append_once


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def write_csv(df: DataFrame, path: str, single: bool = False, mark: bool = True) -> None:
    """UTF-8, with a byte-order mark before the header if ``mark``. ``single``: one file, for small reports only."""
    out = flat(df)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}")
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dashboard(sheets: dict[str, DataFrame], folder: str, wide: Sequence[str] = ("score_delta", "runs", "scores", "routing")) -> None:
    """One table per sheet; summaries as one file, the ``wide`` ones, which grow with the runs, as many.

    A ``folder`` that ends in .xlsx is a workbook: it holds the summaries alone.
    """
    if folder.lower().endswith(".xlsx"):
        from .workbook import write_workbook

        return write_workbook({name: df for name, df in sheets.items() if name not in wide}, folder)
    for name, df in sheets.items():
        write_csv(df, f"{folder}/{name}", single=name not in wide)


def replace_all(df: DataFrame, key: str, path: str) -> None:
    """Write ``df`` in place of what is at ``path``; raises if a key repeats."""
    again = [r[0] for r in df.groupBy(key).count().filter("count > 1").limit(10).collect()]
    if again:
        raise ValueError(f"repeated keys {again}")
    df.write.mode("overwrite").parquet(path)


def next_attempt(ledger: DataFrame, key: str = "asset_id") -> DataFrame:
    """Next attempt number of every key."""
    return ledger.groupBy(key).agg((F.max("attempt") + 1).alias("attempt"))


def official_attempts(ledger: DataFrame, key: str = "asset_id") -> DataFrame:
    """The last completed attempt of every key; keys without one have none."""
    last = Window.partitionBy(key).orderBy(F.desc("attempt"))
    return ledger.filter(F.col("status") == "completed").withColumn("_no", F.row_number().over(last)).filter("_no = 1").drop("_no")


def append_log(log: DataFrame, new: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key is new; raises if a key comes with another payload."""
    rows, conflicts = append_once(log, new, key)
    bad = [r[0] for r in conflicts.limit(10).collect()]
    if bad:
        raise ValueError(f"other payload for known keys {bad}")
    count = rows.count()
    rows.write.mode("append").parquet(path)
    return count


def write_attempt(df: DataFrame, folder: str, attempt: int) -> None:
    """An attempt is written once; writing it again fails."""
    df.write.mode("errorifexists").parquet(f"{folder}/attempt={attempt:02d}")


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of shards with whatever columns they have; the first shard's row of a key stays."""
    made = None
    for i, s in enumerate(shards):
        s = s.withColumn("_shard", F.lit(i))
        made = s if made is None else made.unionByName(s, allowMissingColumns=True)
    rest = [c for c in made.columns if c != "_shard"]
    first = Window.partitionBy(*keys).orderBy("_shard", F.xxhash64(*rest))
    return made.withColumn("_no", F.row_number().over(first)).filter("_no = 1").select(*rest)


def public_columns(df: DataFrame, allowed: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Whitelisted columns; of free texts only length and hash prefix."""
    made = [F.col(c) for c in allowed if c in df.columns]
    for c in texts:
        made += [F.length(F.coalesce(c, F.lit(""))).alias(f"{c}_length"), F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(12)).alias(f"{c}_sha12")]
    return df.select(*made)


def file_hashes(spark, path: str) -> DataFrame:
    """Path and SHA-256 of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(inputs: dict[str, DataFrame], definitions: dict[str, str] | None = None) -> dict:
    """Row count and content hash of every input, for a report's record. The hash does not depend on row order."""
    made = {}
    for name, df in inputs.items():
        row = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
        made[name] = {"rows": row["n"], "columns": sorted(df.columns), "content": str(row["h"] or 0)}
    return {"inputs": made, "definitions": definitions or {}}


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small table as Markdown; ``limit`` bounds what reaches the driver."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(limit).collect()]) + "\n"
