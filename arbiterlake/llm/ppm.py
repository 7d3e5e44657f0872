"""Prediction by partial matching over bytes, pretrained on the corpus.

The model is a byte-context trie up to ``order`` bytes. One distributed count of byte (order + 1)-grams
holds all of it: shorter contexts are sums over longer ones. A byte is coded in its longest known context;
if that context has not seen it, the escape of method D is paid and the next shorter context codes it with
all symbols excluded that the longer one has seen. Excluded totals belong to trie nodes, so they are worked
out once and scoring is a few table look-ups a byte.

The trie grows with the corpus. It is cut into slices of bounded size by the last bytes of the context (every
suffix of a context that is longer than that falls into the same slice; the short ones are in all of them).
Executors build the tables of each slice; the driver passes them on one slice at a time; every worker maps
the executor's one copy into memory, so that tables take neither heap nor time to set up. A model larger than
``pass_bytes`` takes several passes over the documents, and scores are sums over passes.
"""

from __future__ import annotations

import json
import mmap
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, forget, give_back, hold, id_bucket, map_arrow, materialize

#: Ends a text and stands for what is before it; never part of UTF-8.
END = 0xFF
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Last bytes of the context that decide the slice.
SUFFIX = 3


class Table:
    """Distinct unsigned 64-bit keys in the order of their hash, with the first place of each bucket of hashes.

    ``find`` gives each key's place in that order, or -1. It is two arrays, which can lie in a mapped file.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray):
        self.hashes, self.starts = hashes, starts
        self.shift = np.uint64(64 - (len(starts) - 2).bit_length() if len(starts) > 2 else 63)

    @staticmethod
    def build(keys: np.ndarray) -> tuple["Table", np.ndarray]:
        """The table of ``keys`` and the order in which their values must stand."""
        hashes = keys * SPREAD
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(1, (len(keys) // 2).bit_length())
        starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
        return Table(hashes, starts), order

    def find(self, keys: np.ndarray) -> np.ndarray:
        hashes = keys * SPREAD
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        found = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            same = self.hashes[place] == hashes[left]
            found[left[same]] = place[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def trie_arrays(codes: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int) -> dict[str, np.ndarray]:
    """The slice of the trie given by sorted (order + 1)-gram codes and counts, oldest byte highest, as named arrays.

    ``short`` has the counts of all codes of min(``SUFFIX``, order) bytes in the whole corpus, for the contexts
    that every slice shares. Per level k: edges (context and symbol) with the logarithms of their weight and
    of their probability, nodes (contexts) with the logarithms of their escape and, for the level below, of the
    total and the escape that are left when their symbols are excluded there.
    """
    out: dict[str, np.ndarray] = {}
    suffix, upper, low = min(SUFFIX, order), None, lambda x, n: x & np.uint64((1 << 8 * n) - 1) if n < 8 else x
    for k in range(order, -1, -1):
        if k == order:
            keys, n = codes, counts
        elif k == suffix - 1:
            keys, n = short
        elif k < suffix - 1:
            keys, n = _sums(low(short[0], k + 1), short[1])
        else:
            keys, n = _sums(low(upper[0], k + 1), upper[1])
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
        kinds = np.diff(np.append(first, len(keys)))
        weight = 2 * n - 1  # method D: a symbol's first occurrence is half a symbol, half an escape
        total = np.add.reduceat(weight, first) if len(keys) else n
        edges, by_edge = Table.build(keys)
        nodes, by_node = Table.build(context[first])
        log_weight = np.log10(weight.astype(float))
        out[f"edge_hash_{k}"], out[f"edge_start_{k}"] = edges.hashes, edges.starts
        out[f"node_hash_{k}"], out[f"node_start_{k}"] = nodes.hashes, nodes.starts
        out[f"weight_{k}"] = log_weight[by_edge].astype(np.float32)
        out[f"own_{k}"] = (log_weight - np.log10(np.repeat((total + kinds).astype(float), kinds)))[by_edge].astype(np.float32)
        out[f"escape_{k}"] = np.log10(kinds / (total + kinds))[by_node].astype(np.float32) if len(keys) else np.empty(0, np.float32)
        if upper is not None:
            # what is left of this level after excluding the symbols of each longer context
            up_codes, up_first, up_kinds, up_order = upper[0], upper[2], upper[3], upper[4]
            if len(up_codes):
                at_edge = np.searchsorted(keys, low(up_codes, k + 1))
                shared = np.add.reduceat(weight[at_edge], up_first)
                node = np.searchsorted(context[first], low(up_codes[up_first] >> np.uint64(8), k)) if k else np.zeros(len(up_first), np.int64)
                left, rest = total[node] - shared, kinds[node] - up_kinds
                below = np.log10(np.maximum(left + rest, 1))
                gone = np.where(rest > 0, np.log10(np.maximum(rest, 1) / np.maximum(left + rest, 1)), 0.0)
            else:
                below = gone = np.empty(0)
            out[f"below_{k + 1}"], out[f"escape_below_{k + 1}"] = below[up_order].astype(np.float32), gone[up_order].astype(np.float32)
        upper = (keys, n, first, kinds, by_node)
    out["unseen"] = np.array([-np.log10(max(1, 256 - len(upper[0])))])
    return out


class Trie:
    """A slice of the trie over the arrays of ``trie_arrays``."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.order, levels = order, range(order + 1)
        self.edges = [Table(arrays[f"edge_hash_{k}"], arrays[f"edge_start_{k}"]) for k in levels]
        self.nodes = [Table(arrays[f"node_hash_{k}"], arrays[f"node_start_{k}"]) for k in levels]
        self.weight, self.own, self.escape = ([arrays[f"{name}_{k}"] for k in levels] for name in ("weight", "own", "escape"))
        self.below, self.escape_below = ([None, *(arrays[f"{name}_{k}"] for k in levels[1:])] for name in ("below", "escape_below"))
        self.unseen = float(arrays["unseen"][0])

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order + 1)-gram given the bytes before it."""
        out = np.zeros(len(codes))
        left, above = np.arange(len(codes)), np.full(len(codes), -1, np.int64)  # positions still to code, node of the longer context (-1: unknown)
        for k in range(self.order, -1, -1):
            if not len(left):
                return out
            key = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1) if k < 7 else codes[left]
            edge = self.edges[k].find(key)
            miss, up = edge < 0, above >= 0
            hit = ~miss & ~up
            out[left[hit]] += self.own[k][edge[hit]]
            if k < self.order:
                hit = ~miss & up
                out[left[hit]] += self.weight[k][edge[hit]] - self.below[k + 1][above[hit]]
                lost = miss & up
                out[left[lost]] += self.escape_below[k + 1][above[lost]]
            left, above, up, key = left[miss], above[miss], up[miss], key[miss]
            node = self.nodes[k].find(key >> np.uint64(8)) if len(left) else above
            first = (node >= 0) & ~up
            out[left[first]] += self.escape[k][node[first]]
            above = node
        out[left] += self.unseen
        return out


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of the whole text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def gram_codes(streams: list[bytes], order: int) -> np.ndarray:
    """(order + 1)-gram codes of every byte of the texts, each text ended by END and preceded by ``order`` of them."""
    raw = np.frombuffer(bytes([END]) * order + b"".join(s + bytes([END]) * (order + 1) for s in streams), dtype=np.uint8)
    n = len(raw) - order
    codes = np.zeros(max(n, 0), np.uint64)
    for k in range(order + 1):
        codes = (codes << np.uint64(8)) | raw[k : k + n]
    keep = np.ones(max(n, 0), bool)
    at = 0
    for s in streams:  # the padding between texts codes nothing
        at += len(s) + 1
        keep[at : at + order] = False
        at += order
    return codes[keep]


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


GRAM, WORD = 0, 1
#: Word key of the end token (any fixed value).
END_WORD = np.uint64(0xE0D)


class _Counter:
    """Distinct keys and counts of a task, merged whenever the unmerged part grows, and full beyond ``most`` keys."""

    def __init__(self, merge: int = 500_000, most: int = 1_000_000):
        self.parts, self.size, self.merge, self.most = [], 0, merge, most

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.parts.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.size += len(first)
        if self.size > self.merge and len(self.parts) > 1 and self.size > 2 * len(self.parts[0][0]):
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.size > self.most

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return _sums(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def chunks_of(texts: list, size: int = 400_000):
    """Runs of texts of about ``size`` characters (one very long text alone makes a run)."""
    run, total = [], 0
    for t in texts:
        run.append(t)
        total += len(t or "")
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def corpus_counts(df: DataFrame, text_col: str, order: int) -> DataFrame:
    """``kind``, ``key``, ``n``: byte (order + 1)-grams and word tokens of all texts; a task sends each key once, or once each time it is full."""
    from pyspark.sql.types import StructType

    target = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def sent(kind, counter):
        keys, n = counter.total()
        for a in range(0, len(keys), 100_000):
            part = keys[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], schema=target
            )

    def run(batches):
        hold("ppm", _held.clear)
        counters = {GRAM: _Counter(), WORD: _Counter()}
        for batch in batches:
            for texts in chunks_of(batch.column(text_col).to_pylist()):
                docs = [normal_words(t) for t in texts]
                counters[GRAM].add(gram_codes([b" ".join(d) for d in docs], order))
                counters[WORD].add(np.concatenate([word_keys([w for d in docs for w in d]), np.full(len(docs), END_WORD)]))
                for kind, counter in counters.items():
                    if counter.full:
                        yield from sent(kind, counter)
                        counters[kind] = _Counter()
        for kind, counter in counters.items():
            yield from sent(kind, counter)
        counters.clear()
        give_back()

    counted = df.select(text_col).mapInArrow(run, StructType.fromDDL("kind int, key long, n long"))
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_slice(codes: np.ndarray, of: int, suffix: int) -> np.ndarray:
    """Slice of each code by the last ``suffix`` bytes of its context; ``gram_slice_column`` is the same in SQL."""
    context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * suffix) - 1)
    return ((((context * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(of)).astype(np.int64)


def gram_slice_column(of: int, suffix: int):
    context = F.shiftrightunsigned(F.col("key"), 8).bitwiseAND(F.lit((1 << 8 * suffix) - 1))
    return F.shiftright((context * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % F.lit(of)


def slice_tables(counts: DataFrame, of: int, short: tuple[np.ndarray, np.ndarray], order: int, part_bytes: int = 1 << 22) -> DataFrame:
    """``slice``, ``name``, ``part``, ``data``: the arrays of every slice's trie and words, built by executors, in parts of bounded size."""
    mine = F.when(F.col("kind") == GRAM, gram_slice_column(of, min(SUFFIX, order))).otherwise(F.pmod(F.col("key"), F.lit(of)))

    def build(key, group):
        number = key[0].as_py()
        kind = np.asarray(group.column("kind"))
        keys, n = np.asarray(group.column("key")).view(np.uint64), np.asarray(group.column("n"))
        own = kind == GRAM
        arrays = trie_arrays(*_sums(keys[own], n[own]), short, order)
        words, order_ = Table.build(keys[~own])
        arrays |= {"word_hash": words.hashes, "word_start": words.starts, "word_log": np.log10(n[~own][order_] + 1.0)}
        rows = [(number, f"{name}:{a.dtype.str}", i, part) for name, a in arrays.items() for i, part in enumerate(_parts(a.tobytes(), part_bytes))]
        made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["slice", "name", "part", "data"])
        del rows, arrays, keys, n, words
        give_back()
        return made

    return counts.withColumn("slice", mine.cast("long")).groupBy("slice").applyInArrow(build, "slice long, name string, part int, data binary")


def _parts(raw: bytes, size: int) -> list[bytes]:
    return [raw[a : a + size] for a in range(0, len(raw), size)] or [b""]


MAGIC = b"ppm-slice-tables"


def packed(rows: list[tuple[str, int, bytes]]) -> bytes:
    """Named arrays in one piece: magic, length of the index, index, arrays at multiples of 64 bytes."""
    index, out, at = [], [], 0
    by_name: dict[str, list] = {}
    for name, part, data in rows:
        by_name.setdefault(name, []).append((part, data))
    for name, parts in by_name.items():
        size = 0
        for _, data in sorted(parts, key=lambda p: p[0]):
            out.append(data)
            size += len(data)
        index.append((name, at, size))
        out.append(bytes(-size % 64))
        at += size + -size % 64
    head = json.dumps(index).encode()
    start = MAGIC + len(head).to_bytes(8, "little") + head
    return start + bytes(-len(start) % 64) + b"".join(out)


def unpacked(raw, base: int = 0) -> dict[str, np.ndarray]:
    """The arrays of ``packed`` as views of ``raw`` from ``base`` on."""
    size = int.from_bytes(raw[base + len(MAGIC) : base + len(MAGIC) + 8], "little")
    head = len(MAGIC) + 8 + size
    start = base + head + -head % 64
    return {
        name.rpartition(":")[0]: np.frombuffer(raw, dtype=np.dtype(name.rpartition(":")[2]), count=n // np.dtype(name.rpartition(":")[2]).itemsize, offset=start + at)
        for name, at, n in json.loads(bytes(raw[base + len(MAGIC) + 8 : base + head]))
    }


def _mapped(sent) -> dict[str, np.ndarray]:
    """The arrays of a broadcast: from its file mapped into memory, shared by all workers of the executor, or from its value where there is no plain file."""
    path = getattr(sent, "_path", None)
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        base = mapped.find(MAGIC, 0, 4096)
        if base >= 0:
            return unpacked(mapped, base)
    return unpacked(sent.value)


_held: dict[str, tuple[Trie, Table, np.ndarray]] = {}


def _model(name: str, sent, order: int) -> tuple[Trie, Table, np.ndarray]:
    """A slice's trie, words, and logarithms of the words' counts plus one. Only views of the mapped file are kept."""
    hold("ppm", _held.clear)
    if name not in _held:
        run = name.rpartition("-")[0]
        for other in [k for k in _held if k.rpartition("-")[0] != run]:
            del _held[other]
        arrays = _mapped(sent)
        _held[name] = Trie(arrays, order), Table(arrays["word_hash"], arrays["word_start"]), arrays["word_log"]
    return _held[name]


def _partial_scores(docs: DataFrame, id_cols: list[str], text_col: str, sent: dict[int, object], of: int, order: int, run_name: str) -> DataFrame:
    """``id_cols``, ``n_tokens`` and what the slices in ``sent`` add to ``n_known``, ``base`` and ``score`` of every row."""
    types = dict(docs.dtypes)

    def run(batch):
        texts = batch.column(text_col).to_pylist()
        n_rows, row = len(texts), 0
        tokens, known, base, score = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.zeros(n_rows), np.zeros(n_rows)
        for part in chunks_of(texts):
            rows = slice(row, row := row + len(part))
            split = [normal_words(t) for t in part]
            n = np.array([len(d) for d in split])
            words, back = np.unique(np.append(word_keys([w for d in split for w in d]), END_WORD), return_inverse=True)
            streams = [b" ".join(d) for d in split]
            del split
            codes = gram_codes(streams, order)
            starts = np.cumsum([0] + [len(s) + 1 for s in streams])[:-1]
            del streams
            bits, seen, log = np.zeros(len(codes)), np.zeros(len(words), bool), np.zeros(len(words))
            mine, word_slice = gram_slice(codes, of, min(SUFFIX, order)), (words.view(np.int64) % of)
            order_ = np.argsort(mine, kind="stable") if of > 1 else None
            cut = np.searchsorted(mine[order_], np.arange(of + 1)) if of > 1 else None
            for number, one in sent.items():
                trie, table, logs = _model(f"{run_name}-{number}", one, order)
                if of == 1:
                    bits = trie.score(codes)
                else:
                    own = order_[cut[number] : cut[number + 1]]
                    bits[own] = trie.score(codes[own])
                own = np.flatnonzero(word_slice == number)
                at = table.find(words[own])
                seen[own[at >= 0]] = True
                log[own[at >= 0]] = logs[at[at >= 0]]
            score[rows] = np.add.reduceat(bits, starts)
            ends = np.cumsum(np.append(0, n))
            sums = lambda x: np.diff(np.append(0, np.cumsum(x[back][:-1]))[ends]) + x[back[-1]]  # noqa: B023, E731
            tokens[rows], known[rows], base[rows] = n + 1, sums(seen.astype(np.int64)), sums(log)
        return {**{c: batch.column(c) for c in id_cols}, "n_tokens": tokens, "n_known": known, "base": base, "score": score}

    return map_arrow(docs.select(*id_cols, text_col), run, ", ".join([*(f"`{c}` {types[c]}" for c in id_cols), "n_tokens long, n_known long, base double, score double"]))


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, folds: int = 7, held_out: int = 2,
    slice_grams: int = 500_000, slice_words: int = 1_000_000, pass_bytes: int = 4 << 30, batch_rows: int = 1000,
) -> DataFrame:
    """Score every document of ``df`` with a model of those outside the held-out fold.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigram model, log10) and ``score`` (log10 probability of the text by partial matching). The text is its
    lower-cased words with single spaces, then an end. ``slice_grams`` and ``slice_words`` bound what the
    driver or a building task holds at once, ``batch_rows`` the texts that a worker holds at once, ``pass_bytes``
    what an executor maps in one pass over the documents; a larger model is cut into more slices and passes, with the same result.

    A null or empty text is its end alone; a null id counts as the empty text in the fold's crc32; repeated
    rows are scored each; very long texts are scored whole; other columns are not read, whatever their names;
    an empty table gives an empty result, and with no training document every byte is coded by the uniform model.
    """
    import uuid

    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), (id_bucket(id_col, folds) == held_out).alias("_held"))
    with arrow_batches(spark, batch_rows):
        counts = materialize(corpus_counts(docs.filter(~F.col("_held")), "_text", order))
    sizes = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    train_tokens = int(sizes[WORD]["n"]) if WORD in sizes else 0
    distinct = int(sizes[WORD]["keys"]) if WORD in sizes else 0
    keys_of = {kind: int(sizes[kind]["keys"]) if kind in sizes else 0 for kind in (GRAM, WORD)}
    pieces = max(1, -(-keys_of[GRAM] // slice_grams), -(-keys_of[WORD] // slice_words))

    low = F.col("key").bitwiseAND(F.lit((1 << 8 * min(SUFFIX, order)) - 1))
    table = counts.filter(F.col("kind") == GRAM).groupBy(low.alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 256 to the SUFFIX rows
    short = _sums(np.asarray(table.column("key")).view(np.uint64), np.asarray(table.column("n")))
    built = materialize(slice_tables(counts, pieces, short, order))
    bytes_of = {r["slice"]: r["bytes"] for r in built.groupBy("slice").agg(F.sum(F.length("data")).alias("bytes")).collect()}

    passes, mapped = [[]], 0
    for number in range(pieces):
        if passes[-1] and mapped + bytes_of.get(number, 0) > pass_bytes:
            passes.append([])
            mapped = 0
        passes[-1].append(number)
        mapped += bytes_of.get(number, 0)

    id_cols = ["_id", "_held"]
    if len(passes) > 1:  # the passes' sums meet by a row number, which must stay the same from pass to pass
        docs, id_cols = materialize(docs.withColumn("_row", F.monotonically_increasing_id())), [*id_cols, "_row"]
    parts = []
    for numbers in passes:
        sent = {}
        for number in numbers:
            rows = built.filter(F.col("slice") == number).select("name", "part", "data").toArrow()
            columns = [rows.column(c).to_pylist() for c in ("name", "part", "data")]
            if not rows.num_rows:  # no key fell into this slice: the shared short contexts alone
                empty = trie_arrays(np.empty(0, np.uint64), np.empty(0, np.int64), short, order)
                words, _ = Table.build(np.empty(0, np.uint64))
                empty |= {"word_hash": words.hashes, "word_start": words.starts, "word_log": np.empty(0)}
                columns = [[f"{name}:{a.dtype.str}" for name, a in empty.items()], [0] * len(empty), [a.tobytes() for a in empty.values()]]
            del rows
            sent[number] = spark.sparkContext.broadcast(packed(list(zip(*columns))))
            del columns
        with arrow_batches(spark, batch_rows):
            parts.append(materialize(_partial_scores(docs, id_cols, "_text", sent, pieces, order, uuid.uuid4().hex)))
        for one in sent.values():
            one.destroy()

    forget(counts)
    forget(built)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if len(parts) > 1:
        forget(docs)
        sums = [F.any_value("_id").alias("_id"), F.any_value("_held").alias("_held"), F.any_value("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base", "score"))]
        found = found.groupBy("_row").agg(*sums)
    divisor = F.lit(float(np.log10(train_tokens + distinct + 1)))
    return found.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * divisor).alias("base_score"), "score",
    )
