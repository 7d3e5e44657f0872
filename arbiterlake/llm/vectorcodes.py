"""Compression of vectors to a code a part, with codebooks trained by delta-maintained Lloyd rounds.

Every round is one pass over a written table that holds each vector's integers and its codes of the round
before. A task assigns its vectors anew and adds up, for the parts whose code changed, what the entry that
lost them loses and what the entry that got them gains; that table of at most parts times entries rows a
task is all that is shuffled. The driver keeps the sums and counts of all entries (integers, so the result
depends on no order) and applies the changes. Parts that keep their code cost no addition and no shuffle,
and a round in which none changes ends the training: the codebooks stay as they are from then on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_batches, forget, materialize

#: Scaled components from here on count as not finite (less for parts wider than 16): squared distances stay whole numbers of 64 bits.
LIMIT = 1 << 28
OUTPUTS = ("code", "error", "label_error")


class Codebooks:
    """Entries of every part (parts, entries, width), with the sums and counts of the parts assigned to them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.sums, self.counts = np.zeros(entries.shape, dtype=object), np.zeros(entries.shape[:2], dtype=object)

    def apply(self, changes: list[tuple[int, int, int, list[int]]]) -> None:
        """Add (part, entry, count, sums) changes and move every used entry to the floor of its mean."""
        for part, entry, count, sums in changes:
            self.counts[part, entry] += count
            self.sums[part, entry] += np.array(sums, dtype=object)
        used = self.counts > 0
        self.entries = self.entries.copy()
        self.entries[used] = (self.sums[used] // self.counts[used][:, None]).astype(np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors (n, parts, width): the nearest entry of every part, ties to the lower index, and its squared distance."""
    n, parts, _ = x.shape
    code, distance = np.empty((n, parts), dtype=np.uint8), np.empty((n, parts), dtype=np.int64)
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 * x.shape[2] * 4 < 1 << 53
    for p in range(parts):
        own, of = (x[:, p].astype(float), entries[p].astype(float)) if small else (x[:, p], entries[p])  # exact either way
        far = (own * own).sum(axis=1)[:, None] - 2 * (own @ of.T) + (of * of).sum(axis=1)[None, :]
        code[:, p] = far.argmin(axis=1)
        distance[:, p] = far[np.arange(n), code[:, p]]
    return code, distance


def _unpacked(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").astype(np.int64).reshape(-1, parts, width)


#: A vector's integers and code; or, with neither, one change of a codebook.
STATE = "x binary, code binary, part int, entry int, count long, sums array<long>"


def _assigned(state: DataFrame, entries: np.ndarray) -> DataFrame:
    """Rows of ``state`` with new codes, and each task's changes as rows whose ``x`` is null."""
    schema = state.schema
    parts, n_entries, width = entries.shape

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        rows = lambda n, made: pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in target], schema=target)
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(entries.shape[:2], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("x"), parts, width)
            code = nearest(x, entries)[0]
            before = [c or b"" for c in batch.column("code").to_pylist()]
            fresh = np.array([not c for c in before])
            old = np.frombuffer(b"".join(c or bytes(parts) for c in before), dtype=np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = np.flatnonzero(fresh | (old[:, p] != code[:, p]))
                left = moved[~fresh[moved]]
                np.add.at(sums[p], code[moved, p], x[moved, p])
                np.add.at(counts[p], code[moved, p], 1)
                np.subtract.at(sums[p], old[left, p], x[left, p])
                np.subtract.at(counts[p], old[left, p], 1)
            yield rows(len(x), {"code": pa.array([c.tobytes() for c in code], pa.binary()), **{c: batch.column(c) for c in ("id", "label", "x")}})
        touched = [(p, e) for p in range(parts) for e in range(n_entries) if counts[p, e] or sums[p, e].any()]
        if touched:
            at = tuple(zip(*touched))
            yield rows(len(touched), {"part": pa.array(at[0]), "entry": pa.array(at[1]), "count": pa.array(counts[at]), "sums": pa.array(sums[at].tolist())})

    return state.mapInArrow(run, schema)


def _changes(state: DataFrame) -> list[tuple[int, int, int, list[int]]]:
    """What the round changed, summed over tasks: at most one row an entry of a part."""
    each = state.filter("x is null").select("part", "entry", "count", F.posexplode("sums").alias("at", "value"))
    total = each.groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("count").alias("count"))
    rows = total.groupBy("part", "entry").agg(F.first("count").alias("count"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("sums")).collect()
    return [(r["part"], r["entry"], r["count"], [int(v["value"]) for v in r["sums"]]) for r in rows]


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> tuple[DataFrame, Codebooks]:
    """Code every vector as ``parts`` entries of trained codebooks: the coded rows, and the codebooks.

    Components count as floor(scale * x). A part's codebook starts as that part of the vectors with the
    ``entries`` smallest ids (fewer vectors: fewer entries; at most 256); in every round each part goes to its
    nearest entry (squared Euclidean distance, ties to the lower index), then every used entry becomes the
    componentwise floor of its parts' mean. At the end all parts are assigned once more. Returns ``id_col``,
    ``label_col``, ``code`` (binary, a byte a part), ``error`` (squared distances summed over parts) and
    ``label_error`` (summed over equal labels, nulls together).

    Null vectors, vectors that hold null or non-finite components or such as leave 29 bits after scaling, and
    vectors of another length than that of the smallest kept id (or of one that ``parts`` doesn't divide) are
    left out. Null ids sort last, equal ids by their vectors; repeated rows correspond one to one. Very long
    vectors are coded whole. Other columns are not read. An id or label column named like an output comes
    back with ``_id`` or ``_label`` added to its name. An empty table gives an empty result and no entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    name = f"{id_col}_id" if id_col in OUTPUTS else id_col
    label = f"{label_col}_label" if label_col in OUTPUTS or label_col == name else label_col
    whole = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("d"), whole.alias("v"))
    limit = F.least(F.lit(float(LIMIT)), F.lit(4.0 * LIMIT) / F.sqrt(F.size("d") / F.lit(parts)))
    fine = F.forall("d", lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < limit, F.lit(False)))  # NaN is above all numbers here
    kept = plain.filter(F.col("d").isNotNull() & (F.size("d") > 0) & fine & (F.size("d") % parts == 0)).select("id", "label", "v")
    seeds = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()]
    length = len(seeds[0]) if seeds else parts
    kept = kept.filter(F.size("v") == length)
    first = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = Codebooks(np.array(first, dtype=np.int64).reshape(len(first), parts, -1 if first else 1).transpose(1, 0, 2))
    schema = StructType([kept.schema["id"], kept.schema["label"], *StructType.fromDDL(STATE).fields])

    def packed(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            x = np.asarray(batch.column("v").flatten(), dtype="<i4").reshape(batch.num_rows, length)
            own = {"id": batch.column("id"), "label": batch.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(len(x), f.type) for f in target], schema=target)

    with arrow_batches(df.sparkSession):
        state = materialize(kept.mapInArrow(packed, schema))
        for _ in range(rounds if first else 0):
            after = materialize(_assigned(state.filter("x is not null"), books.entries))
            forget(state)
            state = after
            if not (changes := _changes(state)):
                break
            books.apply(changes)
        coded = materialize(_errors(state.filter("x is not null").select("id", "label", "x"), books.entries))
        forget(state)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    result = coded.join(materialize(by_label).withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return result.select(F.col("id").alias(name), F.col("label").alias(label), "code", "error", "label_error"), books


def _errors(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """Codes by the final codebooks, with the squared distances summed over parts."""
    schema = StructType([rows.schema["id"], rows.schema["label"], *StructType.fromDDL("code binary, error long").fields])
    parts, _, width = entries.shape

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            x = _unpacked(batch.column("x"), parts, width)
            code, distance = nearest(x, entries)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def decompress_vectors(df: DataFrame, books: Codebooks, id_col: str = "vec_id", code_col: str = "code", scale: float = 4096.0) -> DataFrame:
    """``id_col`` and ``vector``: the entries that the codes name, one part after the other, divided by ``scale``.

    Expressions alone: the codebooks are a literal of parts times entries short arrays. A null code gives a null vector.
    """
    table = F.array(*(F.array(*(F.array(*(F.lit(float(v / scale)) for v in e)) for e in part)) for part in books.entries.tolist()))
    digits = F.hex(F.col(f"`{code_col}`"))
    entry = lambda p: F.conv(F.substr(digits, 2 * p + F.lit(1), F.lit(2)), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.element_at(F.element_at(table, p + 1), entry(p) + 1))
    return df.select(F.col(f"`{id_col}`"), F.when(F.col(f"`{code_col}`").isNotNull(), F.flatten(parts)).alias("vector"))
