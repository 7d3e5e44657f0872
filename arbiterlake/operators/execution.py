"""Prompts, model calls and the run executor."""

from __future__ import annotations

import string
import time
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..functions.values import hash_modulo
from ..sources.scratch import materialize
from ..sources.tables import exists

#: Fixed shape of a call's result.
CALL = "answer string, error string, input_tokens long, output_tokens long"


def placeholders(template: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(template) if name]


def render(template: str, columns: Sequence[str], hidden: Sequence[str] = (), limits: dict[str, int] | None = None) -> Column:
    """The template with its fields filled from columns; raises if it names a hidden or unknown field."""
    wanted = set(placeholders(template))
    if leaked := sorted(wanted & set(hidden)):
        raise ValueError(f"template shows hidden fields {leaked}")
    if unknown := sorted(wanted - set(columns)):
        raise ValueError(f"template names unknown fields {unknown}")
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            value = clean(name)
            parts.append(F.left(value, F.lit(limits[name])) if limits and name in limits else value)
    return F.concat(*parts)


def turn_prompt(template: str, history: Column, latest: Column) -> Column:
    """A multi-turn prompt: the turns so far as ``role: content`` lines, and the latest message, in a template with ``{history}`` and ``{message}``."""
    lines = F.array_join(F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda t: F.concat(clean(t["role"]), F.lit(": "), clean(t["content"]))), "\n")
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            parts.append({"history": lines, "message": clean(latest)}[name])
    return F.concat(*parts)


def context_block(contexts: DataFrame, key: str = "run_id") -> DataFrame:
    """Retrieved sources of every run as one text, in rank order."""
    rows = contexts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", clean("text").alias("text")))).alias("_rows"))
    return rows.select(key, F.array_join(F.transform("_rows", lambda r: F.concat(F.lit("["), r["source_id"], F.lit("] "), r["text"])), "\n").alias("context"))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 3).cast("int"))


def estimated_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 6)


def mock_answer(key: Column, prompt: Column, styles: Sequence[str]) -> Column:
    """A fixed answer of one of the styles, chosen by the key's SHA-256."""
    return F.concat(F.get(F.array(*map(F.lit, styles)), hash_modulo(key, len(styles)).cast("int")), F.lit(" "), F.left(prompt, F.lit(40)))


def call_model(prompts: DataFrame, client: Callable[[], Callable[[str], tuple[str, dict]]], attempts: int = 3, pause: float = 1.0, longest: float = 8.0) -> DataFrame:
    """``prompts`` with answer, error and token counts of an external model.

    ``client`` builds the connection once a task. A failed call is tried again after ``pause`` seconds, twice as
    long each time up to ``longest``; one that keeps failing becomes a row with its error.
    """
    names = prompts.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields] + [CALL])

    def run(batches: Iterable[pd.DataFrame]):
        ask = client()
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                for left in range(attempts - 1, -1, -1):
                    try:
                        answer, usage = ask(prompt)
                        rows.append((answer, "", usage.get("input_tokens"), usage.get("output_tokens")))
                        break
                    except Exception as error:  # the failure is the row's result
                        if not left:
                            rows.append(("", str(error), None, None))
                        else:
                            time.sleep(min(longest, pause * 2 ** (attempts - 1 - left)))
            made = pd.DataFrame(rows, columns=["answer", "error", "input_tokens", "output_tokens"], index=batch.index)
            for c in ("input_tokens", "output_tokens"):
                made[c] = made[c].astype("Int64")
            yield pd.concat([batch[names], made], axis=1)

    return prompts.mapInPandas(run, schema)


def in_levels(versions: DataFrame, needs: DataFrame) -> list[DataFrame]:
    """``versions`` (``version``) in levels: none needs one of its own level or of a later one. A circle raises.

    ``needs`` has ``version`` and ``needs``; what is not among the versions is not waited for. A level is what no
    open version is needed by, found by anti-join; there are as many as the longest chain.
    """
    left, levels = materialize(versions.select("version").distinct()), []
    while not left.isEmpty():
        waits = needs.join(left.select(F.col("version").alias("needs")), "needs").select("version").distinct()
        ready = materialize(left.join(waits, "version", "left_anti"))
        if ready.isEmpty():
            raise ValueError(f"versions need each other in a circle: {sorted(r[0] for r in left.limit(20).collect())}")
        levels.append(ready)
        left = materialize(left.join(ready, "version", "left_anti"))
    return levels


def execute_graph(
    plan: DataFrame, samples: DataFrame, call: Callable[[DataFrame], DataFrame], template: str, needs: DataFrame, contexts: DataFrame | None = None, retrieval_versions: Sequence[str] | None = None, log: str | None = None
) -> DataFrame:
    """Answers of a run plan whose versions see the answers of the versions they need as ``base_answer``.

    ``needs`` (``version``, ``needs``) is a graph without circles; several answers stand in the order of their
    versions, a blank line between them, and one that failed or that the plan lacks counts as empty. Versions go
    level by level, each level written before the next reads it, so no prompt is sent twice. ``contexts`` has
    ``rank``, ``source_id`` and ``text`` by ``run_id`` or by ``sample_id``; with ``retrieval_versions`` only runs of
    those see any. ``log`` is a folder to which each level's answers are appended: a plan that was cut off goes
    on there, and runs that it holds without an error are not asked again.
    """
    rows = plan.join(samples, "sample_id")
    if contexts is not None:
        at = plan if retrieval_versions is None else plan.filter(F.col("version").isin(*retrieval_versions))
        key = "run_id" if "run_id" in contexts.columns else "sample_id"
        of_runs = contexts.join(at.select("run_id", "sample_id").select(*dict.fromkeys(("run_id", key))), key)
        rows = rows.join(context_block(of_runs.drop("sample_id") if key == "sample_id" else of_runs), "run_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    else:
        rows = rows.withColumn("context", F.lit(""))
    keys, spark = ("sample_id", "model_alias", "version"), plan.sparkSession
    known = None  # answers so far
    recorded = spark.read.parquet(log).filter("error = ''").dropDuplicates(["run_id"]) if log and exists(spark, log) else None
    done = None
    for level in in_levels(plan, needs):
        now = rows.join(level, "version", "left_semi")
        if known is None:
            now = now.withColumn("base_answer", F.lit(""))
        else:
            asked = now.select("run_id", "sample_id", "model_alias", "version").join(needs, "version")
            base = asked.join(known.select("sample_id", "model_alias", F.col("version").alias("needs"), "answer"), ["sample_id", "model_alias", "needs"])
            base = base.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("needs", F.coalesce("answer", F.lit("")).alias("answer")))), lambda x: x["answer"]), "\n\n").alias("base_answer"))
            now = now.join(base, "run_id", "left").withColumn("base_answer", F.coalesce("base_answer", F.lit("")))
        fresh = now if recorded is None else now.join(recorded.select("run_id"), "run_id", "left_anti")
        made = call(fresh.withColumn("prompt", render(template, fresh.columns))).drop("prompt")
        if log:
            made.write.mode("append").parquet(log)
            written = spark.read.schema(made.schema).parquet(log).filter("error = ''").dropDuplicates(["run_id"])
            failed = spark.read.schema(made.schema).parquet(log).filter("error <> ''").dropDuplicates(["run_id"]).join(written.select("run_id"), "run_id", "left_anti")
            part = materialize(written.unionByName(failed).join(level, "version", "left_semi").join(plan.select("run_id"), "run_id", "left_semi"))
        else:
            part = materialize(made)
        known = part.select(*keys, "answer") if known is None else known.unionByName(part.select(*keys, "answer"))
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = call(rows.withColumns({"base_answer": F.lit(""), "prompt": F.lit("")}).limit(0)).drop("prompt")
    return done.withColumns({"run_status": F.when(F.col("error") != "", "failed").otherwise("ok"), "output_text": F.col("answer"), "error_message": F.col("error")}).drop("answer", "error")


def execute_plan(plan: DataFrame, samples: DataFrame, call: Callable[[DataFrame], DataFrame], template: str, contexts: DataFrame | None = None, base: str = "V0", builds_on: str = "V2") -> DataFrame:
    """Answers of a run plan in which one later version sees the answer of the base version."""
    needs = plan.sparkSession.createDataFrame([(builds_on, base)], "version string, needs string")
    return execute_graph(plan, samples, call, template, needs, contexts)
