"""Alignment of two tokenizers over a corpus: which tokens of one overlap which of the other, and how often.

Both token rows of a text cover the same bytes, so that their ends cut the text into groups, and tokens whose
byte ranges overlap are linked. How many documents hold a pair of ids linked is counted in dense matrices:
ids of the first tokenizer are dealt over stripes, a stripe's block has a row per id of it and a column per id
of the second one. Blocks of links stay one row a (batch of documents, stripe): they are counted into the
block with ``np.add.at``, and scored against it where they meet it again, in the same partition. Row maxima
tell each id's best partners. A frequent id is one document more in its row, whatever text it comes from, and
a stripe's blocks are dealt over salts as the data grow, so that no task gets all of a frequent id's.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_batches, hold, materialize, shuffle_partitions
from .wordbpe import byte_symbols

#: Documents of one batch, and links after which a batch ends (8 bytes each while it is sorted).
BATCH_DOCS, BATCH_LINKS = 2048, 1_000_000
#: Bytes of link blocks that a (stripe, salt) should hold.
SALT_BYTES = 256 << 20
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

LINKS = "batch long, doc int, id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, pairs binary, held binary, docs binary, times binary"


def shape(first: str, second: bytes, stripes: int) -> tuple[int, int]:
    """Rows and columns of a stripe's block: ids of the first tokenizer in it, and ids of the second one."""
    import sentencepiece

    spec = json.loads(first)
    last = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return -(-(last + 1) // stripes), sentencepiece.SentencePieceProcessor(model_proto=second).vocab_size()


class Aligner:
    """Both tokenizers, a memo of the ids of the units that texts are made of, and the alignment of id rows.

    A unit starts at a blank between two other characters. Both tokenizers cut there (the first one's
    pattern begins a piece there; no entry of the second one goes on after a blank that follows another
    character), so units are encoded apart and a text's ids are those of its units, one after the other.
    If a tokenizer file doesn't promise that, the whole text is one unit.
    """

    #: Units (about 200 bytes each) before the memo starts anew, and characters of a unit that is kept.
    UNITS, KEPT = 500_000, 48
    CUT = re.compile(r"(?<=\S)(?= \S)")
    #: Fixed value: the pattern that byte-level files mean by ``use_regex``.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, first: str, second: bytes, stripes: int):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        spec = json.loads(first)
        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.stripes, (self.rows, self.columns) = stripes, shape(first, second, stripes)
        self.bytes_a = [b""] * (self.rows * stripes)
        for t, i in [*((t["content"].encode(), t["id"]) for t in spec["added_tokens"]), *ranks.items()]:
            self.bytes_a[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.columns)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([*map(len, x)]) for x in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (self.columns, ",;")) for end in ends for i in range(n)]
        level = spec["pre_tokenizer"]
        byte_level = spec["normalizer"] is None and level["type"] == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"] and all(t["special"] for t in spec["added_tokens"])
        given_back = b"".join(self.bytes_b[i] for i in self.b.encode("a  b ")) == b" a  b "
        self.cuts = byte_level and given_back and not any(re.search("[^▁]▁", p) for p in pieces)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][x + y] for x, y in pairs]
        #: The same ids from ranks, several times as fast, if the file's merges are in the order of its ids.
        self.quick = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.cuts and order == sorted(set(order)) else None
        self.units: dict[str, tuple[bytes, bytes] | None] = {}

    def cut(self, text: str) -> list[str]:
        whole = " " + text
        return self.CUT.split(whole) if self.cuts else [whole]

    def known(self, units: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of both tokenizers (32 bits each) for every unit; None if a tokenizer doesn't give its bytes back."""
        if len(self.units) > self.UNITS:
            self.units.clear()
        memo = self.units
        new = [u for u in units if u not in memo]
        found = dict(self._encoded(new)) if new else {}
        memo.update((u, x) for u, x in found.items() if len(u) <= self.KEPT)
        return memo if all(len(u) <= self.KEPT for u in new) else {**{u: memo[u] for u in units if u in memo}, **found}

    def _encoded(self, new: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes] | None]]:
        is_plain = lambda u: self.quick and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and max(u) <= "ɏ"
        plain, other = [u for u in new if is_plain(u)], [u for u in new if not is_plain(u)]
        ids_b = self.b.encode([u[1:] for u in [*plain, *other]], num_threads=1)
        ids_a, ends = np.array(self.quick.encode_ordinary("".join(plain)) if plain else [], dtype=np.int64), np.cumsum([len(u.encode()) for u in plain])
        at = np.searchsorted(np.cumsum(self.length_a[ids_a]), ends) + 1 if plain else []
        ids_a = [*np.split(ids_a, at[:-1])] if plain else []
        ids_a += [e.ids for e in self.a.encode_batch_fast(other, add_special_tokens=False)] if other else []
        for u, a, b in zip([*plain, *other], ids_a, ids_b):
            raw = u.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            yield u, (np.asarray(a, dtype=np.int32).tobytes(), np.asarray(b, dtype=np.int32).tobytes()) if same else None

    def align(self, rows: list[tuple[bytes, bytes]]) -> tuple[list[int], list[int], list[int], list[int], list[str], np.ndarray]:
        """Of every text: tokens of both, groups, links, digest; then the packed links of all, text after text."""
        n_a, n_b = (np.array([len(x[side]) // 4 for x in rows]) for side in (0, 1))
        a, b = (np.frombuffer(b"".join(x[side] for x in rows), dtype=np.int32).astype(np.int64) for side in (0, 1))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        bytes_ = int(end_a[-1]) if len(a) else 0
        cut = np.zeros(bytes_ + 1, dtype=np.int8)
        cut[end_a] += 1
        cut[end_b] += 1  # each end occurs once a side
        text_ends = np.append(0, end_a)[np.cumsum(n_a)]
        per_text = lambda places: np.bincount(np.searchsorted(text_ends, places), minlength=len(rows)).tolist()
        # Between two neighbouring cuts of either side lies the overlap of one token of each: a link.
        places = np.flatnonzero(cut)
        links = (a % self.stripes * self.rows + a // self.stripes)[np.searchsorted(end_a, places)] * self.columns + b[np.searchsorted(end_b, places)]
        groups = np.flatnonzero(cut == 2)
        group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        upto_a, upto_b = np.searchsorted(end_a, groups) + 1, np.searchsorted(end_b, groups) + 1
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + np.append(0, upto_b)[group_a]] = a + len(self.bytes_a) * (cut[end_a] == 2)
        shown[np.arange(len(b)) + upto_a[group_b]] = b + 2 * len(self.bytes_a) + self.columns * (cut[end_b] == 2)
        digests, at = [], 0
        for n in (n_a + n_b).tolist():
            text = "".join(map(self.shown.__getitem__, shown[at : at + n].tolist()))[:-1]
            digests.append(hashlib.sha256(text.encode()).hexdigest() if n else "")
            at += n
        return n_a.tolist(), n_b.tolist(), per_text(groups), per_text(places), digests, links


_aligners: dict[tuple, Aligner] = {}


def aligner(first: str, second: bytes, stripes: int) -> Aligner:
    """One aligner a process for the same files: the memo lives across tasks."""
    hold("align", _aligners.clear)
    key = (hash(first), hash(second), stripes)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(first, second, stripes)
    return _aligners[key]


def _rows(schema: StructType, columns: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target, n = to_arrow_schema(schema), len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), type=f.type) for f in target], schema=target)


def link_blocks(links: np.ndarray, lengths: list[int], block: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """One batch's links as (stripe, pairs, documents a pair, those documents, links in each), pairs ascending within the stripe."""
    keys = links * BATCH_DOCS + np.repeat(np.arange(len(lengths)), lengths)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    pair, doc = np.divmod(keys[first], BATCH_DOCS)
    stripe = pair // block
    starts = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])) if len(stripe) else np.empty(0, np.int64)
    for at, to in zip(starts, np.append(starts[1:], len(stripe))):
        own, held = np.unique(pair[at:to] - stripe[at] * block, return_counts=True)
        yield int(stripe[at]), own.astype("<i8" if block >= 1 << 32 else "<u4").tobytes(), held.astype("<u4").tobytes(), doc[at:to].astype("<u2").tobytes(), times[at:to].astype("<u4").tobytes()


def _tokenized(df: DataFrame, first: str, second: bytes, stripes: int, schema: StructType) -> DataFrame:
    """A row a document with what it has by itself, and a row a (batch of documents, stripe) with its links."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        own, seq, id_type = aligner(first, second, stripes), 0, to_arrow_type(schema["id"].dataType)
        block, part = own.rows * own.columns, TaskContext.get().partitionId() << 32
        gathered: list[tuple] = []  # (ids, tokens of A, of B, groups, links, digests, packed links) of some texts

        def flush():
            nonlocal seq
            columns = [list(chain.from_iterable(x[i] for x in gathered)) for i in range(6)]
            n, name = len(columns[0]), part + seq
            if n:
                yield _rows(schema, {"batch": [name] * n, "doc": list(range(n)), "id": pa.array(columns[0], type=id_type), **dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns[1:]))})
                blocks = list(link_blocks(np.concatenate([x[6] for x in gathered]), columns[4], block))
                for at in range(0, len(blocks), 64):
                    yield _rows(schema, {"batch": [name] * len(blocks[at : at + 64]), **dict(zip(("stripe", "pairs", "held", "docs", "times"), map(list, zip(*blocks[at : at + 64]))))})
            seq += 1
            gathered.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                names, texts = batch.column(0).slice(at, 128).to_pylist(), batch.column(1).slice(at, 128).to_pylist()
                cut = [own.cut(t) if t else [] for t in texts]
                known = own.known(set(chain.from_iterable(cut)))
                found = [[known[u] for u in units] for units in cut]
                gathered.append((names, *own.align([(b"", b"") if None in x else (b"".join(a for a, _ in x), b"".join(b for _, b in x)) for x in found])))
                if sum(len(x[0]) for x in gathered) > BATCH_DOCS - 128 or sum(len(x[6]) for x in gathered) >= BATCH_LINKS:
                    yield from flush()
        yield from flush()

    return df.mapInArrow(run, schema)


COUNTS = "stripe int, pairs binary, held binary"


def _counted(blocks: DataFrame, block: int, kind: str) -> DataFrame:
    """Blocks of one stripe, which stand together, added up in a dense matrix; its cells that aren't zero come back."""
    schema = StructType.fromDDL(COUNTS)

    def run(batches):
        dense, now, any_, seen = np.zeros(block, dtype=np.int64), None, False, np.empty(0, dtype=kind)

        def out():
            nonlocal seen
            cells, seen = seen, np.empty(0, dtype=kind)
            made = _rows(schema, {"stripe": [now], "pairs": [cells.astype(kind).tobytes()], "held": [dense[cells].astype("<i8").tobytes()]})
            dense[cells] = 0
            return made

        for batch in batches:
            for stripe, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "held"))):
                if any_ and stripe != now:
                    yield out()
                now, any_ = stripe, True
                cells = np.frombuffer(pairs, dtype=kind)
                counts = np.frombuffer(held, dtype="<i8" if len(held) == 8 * len(cells) else "<u4")
                seen = np.union1d(seen, cells[dense[cells] == 0])  # what is read of the matrix is what is held in it
                np.add.at(dense, cells, counts)
        if any_:
            yield out()

    return blocks.mapInArrow(run, schema)


SCORES = "batch long, doc int, n_best long, count_sum long"


def _scored(blocks: DataFrame, block: int, columns: int, kind: str) -> DataFrame:
    """Link blocks against the counts of their stripe, which come first: per document its links to best partners and the sum of counts."""
    schema = StructType.fromDDL(SCORES)

    def run(batches):
        dense, best, cells = np.zeros(block, dtype=np.int64), np.zeros(block // columns, dtype=np.int64), None
        for batch in batches:
            columns_ = (batch.column(c).to_pylist() for c in ("is_links", "batch", "pairs", "held", "docs", "times"))
            for is_links, name, pairs, held, docs, times in zip(*columns_):
                pairs = np.frombuffer(pairs, dtype=kind)
                if not is_links:
                    if cells is not None:
                        dense[cells] = 0
                    best[:] = 0
                    cells, counts = pairs, np.frombuffer(held, dtype="<i8")
                    dense[cells] = counts
                    np.maximum.at(best, cells // columns, counts)
                    continue
                held = np.frombuffer(held, dtype="<u4")
                count = np.repeat(dense[pairs], held)
                top = np.repeat(dense[pairs] == best[pairs // columns], held)
                doc, times = np.frombuffer(docs, dtype="<u2"), np.frombuffer(times, dtype="<u4").astype(np.int64)
                n_best, total, there = np.zeros(BATCH_DOCS, np.int64), np.zeros(BATCH_DOCS, np.int64), np.unique(doc)
                np.add.at(total, doc, count * times)
                np.add.at(n_best, doc, np.where(top, times, 0))
                yield _rows(schema, {"batch": pa.array([name] * len(there), pa.int64()), "doc": pa.array(there, pa.int32()), "n_best": pa.array(n_best[there]), "count_sum": pa.array(total[there])})

    return blocks.mapInArrow(run, schema)


def align_documents(
    df: DataFrame, first: str, second: bytes, id_col: str = "doc_id", text_col: str = "text", stripes: int = 64, salt_bytes: int = SALT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Align two tokenizers over all whole texts: (one row a document, one row a linked pair of ids).

    ``first`` holds a byte-level BPE tokenizer file (A, which encodes a blank and the text), ``second`` a
    sentencepiece model (B, which adds the blank itself). The documents have ``id_col``, ``n_a``, ``n_b``
    (tokens), ``n_groups``, ``n_links``, ``n_best`` (links to a partner that no other one of the A id
    exceeds), ``count_sum`` (documents that hold the pair linked, summed over links) and ``groups_sha256``.
    The pairs have ``a_id``, ``b_id``, ``n_docs`` and ``best``.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and an empty
    digest; very long texts are aligned whole. Rows correspond one to one and each counts as a document,
    repeated rows included; null ids pass through. All partners of a tied maximum are best. Other columns are
    not read. An id column named like an output comes back with ``_id`` added to its name. An empty table
    gives empty results.
    """
    spark = df.sparkSession
    name = f"{id_col}_id" if id_col in OUTPUTS else id_col
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType.fromDDL(LINKS.format(plain.schema["id"].dataType.simpleString()))
    rows, columns = shape(first, second, stripes)
    block = rows * columns
    kind = "<i8" if block >= 1 << 32 else "<u4"
    with arrow_batches(spark):
        made = materialize(_tokenized(plain, first, second, stripes, schema))
    links = made.filter("stripe is not null").select("batch", "stripe", "pairs", "held", "docs", "times")
    held = links.agg(F.sum(F.octet_length("pairs") + F.octet_length("docs") + F.octet_length("times"))).first()[0] or 0
    salts = max(1, -(-held // (stripes * salt_bytes)))
    n = max(shuffle_partitions(spark), stripes * salts)
    salted = links.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    with arrow_batches(spark, 64):
        counts = _counted(salted.select("stripe", "salt", "pairs", "held").repartition(n, "stripe", "salt").sortWithinPartitions("stripe"), block, kind)
        counts = materialize(counts)
        if salts > 1:
            counts = materialize(_counted(counts.repartition(max(shuffle_partitions(spark), stripes), "stripe").sortWithinPartitions("stripe"), block, kind))
        null = lambda c, t: F.lit(None).cast(t).alias(c)
        copies = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("is_links"), null("batch", "long"), "pairs", "held", null("docs", "binary"), null("times", "binary"))
        both = copies.unionByName(salted.withColumn("is_links", F.lit(True)))
        meet = both.repartition(n, "stripe", "salt").sortWithinPartitions("stripe", "salt", "is_links")
        scores = materialize(_scored(meet, block, columns, kind).groupBy("batch", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    docs = made.filter("doc is not null").select("batch", "doc", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    result = docs.join(scores, ["batch", "doc"], "left").select(F.col("id").alias(name), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return result, _pairs(counts, stripes, block, columns, kind)


def _pairs(counts: DataFrame, stripes: int, block: int, columns: int, kind: str) -> DataFrame:
    schema = StructType.fromDDL("a_id int, b_id int, n_docs long, best boolean")

    def run(batches):
        for batch in batches:
            for stripe, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "held"))):
                row, column = np.divmod(np.frombuffer(pairs, dtype=kind).astype(np.int64), columns)
                n, most = np.frombuffer(held, dtype="<i8"), np.zeros(block // columns, np.int64)
                np.maximum.at(most, row, n)
                yield _rows(schema, {"a_id": pa.array(row * stripes + stripe, pa.int32()), "b_id": pa.array(column, pa.int32()), "n_docs": pa.array(n), "best": pa.array(n == most[row])})

    return counts.mapInArrow(run, schema)
