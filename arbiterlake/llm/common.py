"""Shared pieces of the training-data operators: scratch tables, Arrow mapping, column guards."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, fresh_folder, materialize, shared_dir

__all__ = ["arrow_batches", "forget", "fresh_folder", "give_back", "hold", "id_bucket", "map_arrow", "marked", "marks", "materialize", "shared_dir", "shuffle_partitions", "words_of"]

#: ASCII white space, the separators of every word definition used here.
SPACES = b" \t\n\x0b\x0c\r"


#: Rows, and so texts, that a Python worker holds at once.
BATCH_ROWS = 2000


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run inside pass at most ``rows`` rows at once to a Python worker, so that it holds few texts; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory of this process to the system (a no-op where the C library cannot)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_holder: list = [None, None]


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """A worker process keeps the look-up tables of one operator; when another one runs there, they are released."""
    if _holder[0] != owner:
        if _holder[1]:
            _holder[1]()
        if _holder[0]:
            give_back()
        _holder[:] = [owner, release]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterable[dict]], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it returns one dict of column lists, or yields several."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, whole.num_rows, BATCH_ROWS)):
            made = fn(batch)
            for cols in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, type=f.type) for f, c in zip(target, (cols[f.name] for f in target))],
                    schema=target,
                )

    return df.mapInArrow(run, struct)


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a key's hash in a table of so many words."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), h.bitwiseAND(F.lit(63)).cast("int")


def marks(keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """The hashes of a one-column table as bits: at most ``words`` (a power of two) rows of 64, however many keys; written."""
    word, bit = _place(F.col(keys.columns[0]), words)
    placed = keys.select(word.alias("_word"), bit.alias("_bit")).withColumn("_bits", F.expr("shiftleft(1L, _bit)"))
    return materialize(placed.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))


def marked(df: DataFrame, column: str, table: DataFrame, words: int = 1 << 18) -> DataFrame:
    """``df`` with ``_marked``: true for every row whose key is in the table of ``marks``, and for a few others by chance.

    The table is of bounded size and broadcast, so no row of ``df`` is shuffled.
    """
    word, bit = _place(F.col(column), words)
    placed = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(table), "_word", "left")
    return placed.withColumn("_marked", F.coalesce(F.expr("getbit(_bits, _bit)"), F.lit(0)) == 1).drop("_word", "_bit", "_bits")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8 (``bytes.split`` cuts at exactly these six bytes)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
