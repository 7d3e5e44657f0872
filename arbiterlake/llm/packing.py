"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so what best-fit decreasing does depends only on how many
pieces there are of each length. That histogram (at most ``capacity`` rows, whatever the data) is packed on
the driver, equal pieces and equal bins in bulk, with a segment tree over remaining capacities that finds
the tightest open bin in logarithmic time. The result is a short list of runs: pieces number i to j of
length L go to consecutive sequences at one offset. Every piece finds its own number by a distributed rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, map_arrow, materialize, shuffle_partitions
from .wordbpe import encoder


class CapacityTree:
    """Segment tree over remaining capacities: which of them have an open bin, and the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, remaining: int, present: bool) -> None:
        node = self.size + remaining
        self.any[node] = present
        while node := node >> 1:
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that has an open bin."""
        node = self.size + length
        if self.any[node]:
            return length
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, sequence of that rank, offset, pieces), sorted by length and rank.

    Equal to placing every piece, longest first, into the tightest open bin that holds it: after a piece of
    length L goes into the tightest bin, that bin stays the tightest for the next L as long as it fits.
    """
    tree, bins, runs, opened = CapacityTree(capacity), defaultdict(list), [], 0

    def open_(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            bins[remaining].append((first, count))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins[remaining].pop()
                if not bins[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            full = min(count, left // each)
            for t in range(each if full else 0):
                runs.append((length, rank, first, capacity - remaining + t * length, full))
                rank += full
            left -= full * each
            open_(remaining - each * length, first, full)
            if full < count:
                for t in range(left if left < each else 0):
                    runs.append((length, rank, first + full, capacity - remaining + t * length, 1))
                    rank += 1
                used = left if left < each else 0
                left -= used
                open_(remaining - used * length, first + full, 1 if used else 0)
                open_(remaining, first + full + (1 if used else 0), count - full - (1 if used else 0))
    return np.array(sorted(runs), dtype=np.int64).reshape(len(runs), 5)


def tokenized_pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every document's ids (text tokens, then ``end_id``): only documents longer than ``capacity`` are cut."""
    id_type = dict(df.dtypes)[id_col]

    def run(batch):
        encode = encoder(tokenizer).encode
        end, width = int(end_id).to_bytes(4, "little"), 4 * capacity
        docs, piece, start, length, crc, ids = [], [], [], [], [], []
        for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()):
            raw = encode(text) + end
            for at in range(0, len(raw), width):
                part = raw[at : at + width]
                docs.append(doc)
                piece.append(at // width)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                ids.append(part if with_ids else None)
        return {id_col: docs, "piece": piece, "start": start, "length": length, "ids_crc32": crc, **({"ids": ids} if with_ids else {})}

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(df.select(id_col, text_col), run, schema)


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as best-fit decreasing finds.

    ``tokenizer`` holds the tokenizer file's contents. Returns per piece ``id_col``, ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``with_ids``, ``ids`` (little-endian
    unsigned 32-bit).

    A null or empty text is its end id alone; very long texts are cut into pieces; null ids pass through;
    repeated rows are packed once each; other columns are not read; an empty table gives an empty result.
    """
    with arrow_batches(df.sparkSession):
        pieces = materialize(tokenized_pieces(df, tokenizer, id_col, text_col, capacity, end_id, with_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = best_fit_decreasing(histogram, capacity)

    # Rank among pieces of the same length: a common length is ranked in many buckets, each with its offset.
    buckets = max(64, shuffle_partitions(df.sparkSession), sum(histogram.values()) // 100_000)  # grows with the data
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    ranked = spread.withColumn("_no", F.row_number().over(local)).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_no") - 1)

    keep = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = dict(pieces.dtypes)
    scale = 1 << 44
    keys = runs[:, 0] * scale + runs[:, 1]

    def place(batch):
        length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
        at = np.searchsorted(keys, length * scale + rank, side="right") - 1
        return {
            **{c: batch.column(c) for c in keep},
            "sequence_id": runs[at, 2] + rank - runs[at, 1],
            "offset": runs[at, 3],
        }

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "sequence_id long", "offset long"])
    return map_arrow(ranked.select(*keep, "_rank"), place, schema)
