"""Contiguous, byte-balanced shards from global prefix sums (DataFrame functions only).

Rows are put in one total order (id, then a hash of the row) by range partitions. Each partition sums its
bytes; the prefix sum over those few totals gives every partition its global offset, a window inside the
partition adds the local prefix, and cutting the global prefix at equal byte targets gives the shards.
Only one row per partition and one row per shard ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions


def text_size(text_col: str):
    """UTF-8 bytes of the text plus one; a null text has none."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(1)


def shard_by_bytes(
    df: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Assign every row of ``df`` to one of ``n_shards`` contiguous shards of nearly equal bytes.

    Returns ``id_col``, the columns named in ``carry``, and ``size``, ``text_crc32``, ``shard``, ``slot``
    (place in the shard, gapless from 0). A row belongs to the shard in which its middle byte falls, so a
    shard differs from the target by at most one row at either end. Only the named columns are shuffled:
    leave the text out of ``carry`` to move a few dozen bytes a row.

    Null ids sort first; a null text counts as empty (size 1, crc 0); repeated rows each get a slot of
    their own; an empty table gives an empty result. Other columns of ``df`` are ignored, and a carried
    column named like an output is replaced by the output.
    """
    spark = df.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    kept = [c for c in carry if c not in (id_col, "size", "text_crc32", "shard", "slot")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col), *kept, text_size(text_col).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_place")
    )
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie"), F.col("_place")]  # the last one spreads equal rows, which are interchangeable
    # Written out once: range bounds come from a sample, so a recomputed partition must not see other bounds.
    placed = materialize(rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))

    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    local = Window.partitionBy("_part").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        placed.withColumn("_run", F.sum("size").over(local))
        .withColumn("_no", F.row_number().over(Window.partitionBy("_part").orderBy(*order, "size")))
        .join(F.broadcast(offsets), "_part")  # bounded by the number of partitions
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_run") - F.col("size")) + F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"int(_middle * {int(n_shards)} div (2 * _total))")))
        .withColumn("_index", F.col("_rows_before") + F.col("_no") - 1)
    )
    firsts = ranked.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row per shard
    return ranked.join(F.broadcast(firsts), "shard").select(
        id_col, *kept, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_index") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``df`` with its texts under ``path``, one folder per shard, rows of a shard sorted by slot inside each file.

    All columns are written, but for those named like an output of ``shard_by_bytes``, which give way to it;
    nulls, empty and very long texts and repeated rows as there; an empty table writes no row.
    """
    carry = tuple(c for c in df.columns if c != id_col)
    placed = shard_by_bytes(df, n_shards, id_col, text_col, carry=carry)
    parts = max(n_shards, shuffle_partitions(df.sparkSession))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
