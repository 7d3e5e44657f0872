"""Training-corpus pipeline: quality rules, line removal, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All stages but the last
return the columns of ``documents``; ``run`` writes each stage's rows to the shared folder and reads them
again. Null and empty texts leave at the first stage; nulls in other columns, repeated ids, very long texts and
further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiterlake.llm import jaccard, linededup, packing, pii, quality
from arbiterlake.llm.common import materialize
from arbiterlake.llm.queries import tokenizer_contents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule passes and the label model calls good (operator 3)."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, short ones too, that stand on five or more sites, their first occurrence apart (operator 8).

    A document of which no word is left was made of such lines only, and goes. Columns of the input named like
    the operator's counts come through as they were; repeated ids, very long texts and an empty table as there.
    """
    counts = {c: f"_docs_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    cleaned = linededup.remove_site_boilerplate(docs.withColumnsRenamed(counts))
    left = cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_lines", "n_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")).withColumnsRenamed({h: c for c, h in counts.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of five-word Jaccard links of 0.8 or more (operator 5)."""
    return jaccard.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind (operator 9)."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their place in sequences of 4096 tokens (operator 10)."""
    return packing.pack_documents(docs, tokenizer_contents("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("redact", redact),
    ("pack", pack),
]

#: The label model, the span classifier and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
