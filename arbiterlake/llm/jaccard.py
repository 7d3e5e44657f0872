"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. Documents with the same shingle set form one class; copies, however many, meet only in a count.
2. Two sets that are similar enough share a shingle among the first few of each in any common order. The
   order puts frequent shingles last, the more frequent the later, so a passage that many documents share
   produces no candidates. Shingles whose lists came out long are moved back, and only sets led by them read again.
3. Classes that share such a shingle are candidates. Short lists give pairs, thinned by an upper bound of
   the overlap; long lists give a star. Connected candidates form families that no link leaves.
4. Every family is cut into blocks of bounded bytes, by size where it is large. Inside a block documents are sorted into small groups of
   similar ones, each group keeps its token union, and a document opens only those groups whose union it
   overlaps enough. What it opens is compared exactly.

Nothing is capped or sampled: the frequent-shingle filter only chooses the order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, forget, hold, map_arrow, marked, marks, materialize, shuffle_partitions
from .components import connected_components

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the table of levels, and from where a shingle counts as frequent. Both only shape the order.
CELLS, FREQUENT = 1 << 24, 8
#: Bits of a shingle's hash in a key, above them its level; times that long lists are moved back; keys moved at once.
KEY_BITS, ROUNDS, MOST = 59, 2, 1 << 20
#: Classes of the longest list that gives pairs.
LONGEST = 64
#: Words in the table of keys that several classes share; only their rows are shuffled again.
KEY_WORDS = 1 << 20
#: Tokens in one side of a block (8 MB of sets), and chunks into which a family that has fewer is cut for the sake of more tasks.
BLOCK_TOKENS, SPREAD = 1 << 20, 4
#: What tells one set from another: its size and two 64-bit fingerprints.
SET = ["n", "p1", "p2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int = 5, run: int = 1_000_000) -> list[np.ndarray]:
    """Per text the sorted distinct 62-bit hashes of its ``width``-word shingles (lower-cased A-Z).

    Fewer words: the whole sequence is the one shingle. No words or null: the empty set. Texts are taken in
    runs of about ``run`` characters, so that the words of a whole batch are never held at once.
    """
    hold("jaccard")
    out, start, size = [], 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= run or i == len(texts) - 1:
            out.extend(_shingles(texts[start : i + 1], width))
            start, size = i + 1, 0
    return out


def _shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    words = [x.encode("utf-8", "surrogatepass").lower().split() if x else [] for x in texts]
    every = [w for doc in words for w in doc]
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, every), dtype=np.uint64, count=len(every))
    n = max(0, len(every) - width + 1)
    rolled = one[:n].copy()
    for k in range(1, width):
        rolled = _mixed(rolled) + one[k : n + k]
    rolled = _mixed(rolled) >> np.uint64(2)
    out, at = [], 0
    for doc in words:
        if len(doc) >= width:
            out.append(np.unique(rolled[at : at + len(doc) - width + 1]))
        elif doc:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(doc), seed=len(doc)) >> 2], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += len(doc)
    return out


def _prints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit fingerprints of each set."""
    with np.errstate(over="ignore"):
        return tuple([int(f(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for f in (lambda s: s, _mixed))


def _first(keys: np.ndarray, percent: int) -> np.ndarray:
    """The smallest keys of which two similar sets must share one."""
    n = len(keys)
    return keys[: n - -(-percent * n // 100) + 1] if n else keys


def described(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``n`` (set size), ``p1``, ``p2`` (fingerprints: equal sets, equal class) for every row."""
    id_type = dict(df.dtypes)[id_col]

    def run(batch):
        sets = shingle_sets(batch.column(text_col).to_pylist(), width)
        one, two = _prints(sets)
        return {"id": batch.column(id_col), "n": [len(s) for s in sets], "p1": one, "p2": two}

    return map_arrow(df.select(id_col, text_col), run, f"id {id_type}, n long, p1 long, p2 long")


def _levels(counts: np.ndarray) -> np.ndarray:
    """1 for shingles of 8 to 15 sets, one more for every doubling, at most 15."""
    return np.clip(np.log2(counts).astype(np.int64) - 2, 1, 15).astype(np.uint8)


def _raised(table: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The packed table of levels (4 bits a cell) with the cells of ``keys`` at ``levels`` or above."""
    wide = np.stack([table & 15, table >> 4], axis=1).reshape(-1)
    np.maximum.at(wide, keys & (CELLS - 1), levels)
    return wide[0::2] | (wide[1::2] << 4)


def frequent_filter(df: DataFrame, text_col: str, width: int, percent: int) -> np.ndarray:
    """A packed table of levels of the shingles that stand in the leading part of more than ``FREQUENT`` sets.

    The ``MOST`` most frequent enter, so its size is fixed; false or missing entries cost time, never a link.
    """

    def run(batch):
        return {"token": np.concatenate([_first(s, percent) for s in shingle_sets(batch.column(text_col).to_pylist(), width)] + [np.empty(0, np.uint64)]).astype(np.int64)}

    counts = materialize(map_arrow(df.select(text_col), run, "token long").groupBy("token").count().filter(F.col("count") > FREQUENT))
    top = np.array([tuple(r) for r in counts.orderBy(F.desc("count"), "token").limit(MOST).collect()], dtype=np.int64).reshape(-1, 2)
    return _raised(np.zeros(CELLS // 2, dtype=np.uint8), top[:, 0] >> (62 - KEY_BITS), _levels(top[:, 1]))


def _ordered(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Keys in the common order: by level, then by hash."""
    key = tokens.astype(np.int64) >> (62 - KEY_BITS)
    at = key & (CELLS - 1)
    level = (table[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15
    return np.sort(key + (level.astype(np.int64) << KEY_BITS))


def leading(df: DataFrame, classes: DataFrame, text_col: str, width: int, percent: int, table: np.ndarray) -> DataFrame:
    """One row per class: ``cls``, ``n``, ``lead`` (its leading keys)."""

    def run(batch):
        sets = shingle_sets(batch.column(text_col).to_pylist(), width)
        one, two = _prints(sets)
        return {"n": [len(s) for s in sets], "p1": one, "p2": two, "lead": [_first(_ordered(s, table), percent) for s in sets]}

    made = map_arrow(df.select(text_col), run, "n long, p1 long, p2 long, lead array<long>").filter("n > 0")
    return made.groupBy(*SET).agg(F.any_value("lead").alias("lead")).join(classes, SET).select("cls", "n", "lead")


def led(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``leading`` in an order that long lists have shaped.

    Keys with long lists rise to the level of their count. A set that is not led by a raised cell keeps its leading keys,
    as raised ones only move back; the others are read again, each from one of its documents.
    """
    table = frequent_filter(docs, text_col, width, percent)
    leads = materialize(leading(docs, classes, text_col, width, percent, table))
    cell = F.col("key").bitwiseAND(F.lit(CELLS - 1)).alias("cell")
    for _ in range(ROUNDS):
        keys = leads.select("cls", F.explode("lead").alias("key"))
        level = F.least(F.floor(F.log2(F.col("count"))).cast("int") - 2, F.lit(15))
        raised = keys.groupBy("key").count().filter(F.col("count") > LONGEST).filter(level > F.shiftright("key", KEY_BITS))
        raised = materialize(raised.orderBy(F.desc("count"), "key").limit(MOST))
        top = np.array([tuple(r) for r in raised.select("key", "count").collect()], dtype=np.int64).reshape(-1, 2)
        if not len(top):
            break
        table = _raised(table, top[:, 0], _levels(top[:, 1]))
        cells = raised.select(cell).distinct()
        near = marked(keys.select("cls", cell), "cell", marks(cells)).filter("_marked").drop("_marked")
        again = materialize(near.join(cells, "cell", "left_semi").select("cls").distinct())
        asked = materialize(classes.join(again, "cls"))
        rows = marked(docs, id_col, marks(asked.select("rep"))).filter("_marked")
        old, leads = leads, materialize(leads.join(again, "cls", "left_anti").unionByName(leading(rows, asked, text_col, width, percent, table)))
        forget(old)
    return leads


def candidate_edges(leads: DataFrame, percent: int, longest: int = LONGEST) -> DataFrame:
    """Edges ``a``, ``b`` between classes such that every link joins two classes connected by them.

    Lists of at most ``longest`` classes give pairs; a pair stays if the shared leading keys, plus those in
    long lists, plus all that can follow the end of the shorter lead could reach the threshold. Longer
    lists join all their classes to one of them.
    """
    classes = leads.select("cls", "n", F.size("lead").cast("long").alias("p"), F.element_at("lead", -1).alias("last"))
    keys = leads.select("cls", F.explode("lead").alias("key"))
    # counted with map-side combine and written, so that the join back is plain and a hot key's list is split over tasks
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("df"), F.min("cls").alias("head")).filter("df > 1"))
    held = marked(keys, "key", marks(shared.select("key"), KEY_WORDS), KEY_WORDS).filter("_marked").drop("_marked")  # most keys stand in one class alone
    lists = materialize(held.join(shared, "key"))
    star = lists.filter(F.col("df") > longest).select(F.col("head").alias("a"), F.col("cls").alias("b")).filter("a <> b").distinct()
    crowd = lists.groupBy("cls").agg(F.count_if(F.col("df") > longest).alias("long"))
    short = lists.filter(F.col("df") <= longest).join(classes, "cls").join(crowd, "cls")
    x = short.select("key", *(F.col(c).alias(f"{c}_x") for c in ("cls", "n", "p", "last", "long")))
    y = short.select("key", *(F.col(c).alias(f"{c}_y") for c in ("cls", "n", "p", "last", "long")))
    near = (F.col("cls_x") < F.col("cls_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    rest = F.when(F.col("last_x") < F.col("last_y"), F.col("n_x") - F.col("p_x")).when(F.col("last_x") > F.col("last_y"), F.col("n_y") - F.col("p_y")).otherwise(
        F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    )
    pairs = (
        x.join(y, "key")
        .filter(near)
        .groupBy("cls_x", "cls_y")
        .agg(F.count("*").alias("shared"), F.any_value(rest + F.least("long_x", "long_y")).alias("more"), F.any_value(F.col("n_x") + F.col("n_y")).alias("sizes"))
        .filter((100 + percent) * (F.col("shared") + F.col("more")) >= percent * F.col("sizes"))
        .select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b"))
    )
    return pairs.unionByName(star)


class Block:
    """Documents of one family, compared with each other (side 0), or those of side 1 with those of side 2."""

    GROUP = 32

    def __init__(self, cls, sizes, weights, tokens, side, percent: int):
        self.percent = percent
        order = sorted(range(len(cls)), key=lambda i: (side[i], sizes[i], tokens[i][0]))
        self.cls = np.array([cls[i] for i in order], dtype=np.int64)
        self.n = np.array([sizes[i] for i in order], dtype=np.int64)
        self.weight = np.array([weights[i] for i in order], dtype=np.int64)
        self.side = np.array([side[i] for i in order])
        every = np.concatenate([tokens[i] for i in order])
        owner = np.repeat(np.arange(len(order)), self.n)
        _, local, often = np.unique(every, return_inverse=True, return_counts=True)
        kept = often[local] > 1  # a token of one document overlaps nothing
        names = np.cumsum(often > 1) - 1
        self.tokens, owner = names[local[kept]], owner[kept]
        self.width = int((often > 1).sum())
        self.start = np.searchsorted(owner, np.arange(len(order) + 1))

    def links(self):
        """Yields (i, array of j) for all linked pairs, each once."""
        m, t = len(self.cls), self.percent
        first = int(np.searchsorted(self.side, 2)) if self.side[-1] else 0  # candidates begin here
        if first == m:
            return
        edges = np.arange(first, m, self.GROUP)
        group = (np.arange(m) - first) // self.GROUP
        low = np.array([self.n[e : e + self.GROUP].min() for e in edges])
        high = np.array([self.n[e : e + self.GROUP].max() for e in edges])
        # the token-group matrix: for every token the groups whose union holds it
        at = np.arange(self.start[first], self.start[m])
        member = np.repeat(np.arange(first, m), np.diff(self.start[first:]))
        pairs = np.unique(self.tokens[at] * len(edges) + group[member]) if len(at) else np.empty(0, np.int64)
        by_token = np.searchsorted(pairs, np.arange(self.width + 1) * len(edges))
        groups = pairs % len(edges) if len(pairs) else pairs
        mark = np.zeros(self.width + 1, dtype=np.int64)
        for i in range(first if self.side[-1] else m):
            own = self.tokens[self.start[i] : self.start[i + 1]]
            if not len(own):
                continue
            begin, end = by_token[own], by_token[own + 1]
            span = end - begin
            hits = groups[np.repeat(begin - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())]
            bound = np.bincount(hits, minlength=len(edges))
            least = np.maximum(low, -(-t * self.n[i] // 100))
            fits = (100 * high >= t * self.n[i]) & (t * low <= 100 * self.n[i]) & ((100 + t) * bound >= t * (self.n[i] + least))
            if not fits.any():
                continue
            mark[own] = 1
            for g in np.flatnonzero(fits):
                a, b = max(edges[g], 0 if self.side[-1] else i + 1), min(edges[g] + self.GROUP, m)
                if a >= b:
                    continue
                total = np.concatenate([[0], np.cumsum(mark[self.tokens[self.start[a] : self.start[b]]])])
                both = total[self.start[a + 1 : b + 1] - self.start[a]] - total[self.start[a:b] - self.start[a]]
                j = a + np.flatnonzero((100 + t) * both >= t * (self.n[i] + self.n[a:b]))
                if len(j):
                    yield i, j
            mark[own] = 0

    def result(self) -> tuple[list[int], list[int], list[int]]:
        """Rows (a, b, 0) of a spanning forest and (a, a, documents linked to a)."""
        m = len(self.cls)
        degree, above = np.zeros(m, dtype=np.int64), list(range(m))
        a, b = [], []

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        for i, js in self.links():
            degree[i] += self.weight[js].sum()
            degree[js] += self.weight[i]
            for j in js.tolist():
                p, q = top(i), top(j)
                if p != q:
                    above[max(p, q)] = min(p, q)
                    a.append(int(self.cls[i]))
                    b.append(int(self.cls[j]))
        some = np.flatnonzero(degree)
        own = self.cls[some].tolist()
        return a + own, b + own, [0] * len(a) + degree[some].tolist()


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``, ``links`` from rows (``block``, ``side``, ``cls``, ``n``, ``docs``, ``tokens``) sorted by block within partitions."""
    from pyspark.sql.types import LongType, StructField, StructType

    target = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches):
        current, held, out = None, [], ([], [], [])

        def close():
            if len(held) > 1:
                cls, n, docs, tokens, side = zip(*held)
                for have, new in zip(out, Block(cls, n, docs, [np.frombuffer(t, dtype=np.int64) for t in tokens], side, percent).result()):
                    have.extend(new)

        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "cls", "n", "docs", "tokens", "side"))):
                if block != current:
                    close()
                    current, held = block, []
                held.append(row)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=target)
                out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=target)

    return rows.mapInArrow(run, StructType([StructField(c, LongType()) for c in ("a", "b", "links")]))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles``, ``component_id``, ``n_links``, ``class_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets.
    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of other rows linked
    directly, ``class_id`` the size and a 128-bit fingerprint of the shingle set.

    Texts that are null, empty or without words have the empty set, no links, and are their own component.
    Repeated rows link like any copies. Null ids take part; they come after all others as smallest id.
    Other columns are not read. An empty table gives an empty result.

    A family of more than ``block`` candidate classes is cut into bands by size, a band into chunks of about ``block``
    classes, at most ``SPREAD`` of them, or into more where a chunk would pass ``BLOCK_TOKENS`` tokens. A set is shipped
    once a chunk of its own and the neighbouring bands. So bands of up to ``SPREAD * BLOCK_TOKENS`` tokens cost bytes in
    proportion, larger ones the square of their bytes by those of a chunk.
    """
    with arrow_batches(df.sparkSession):
        return _components(df, id_col, text_col, width, percent, block)


def _components(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(id_col, text_col)
    rows = materialize(described(docs, id_col, text_col, width))
    kinds = rows.filter("n > 0").groupBy(*SET).agg(F.min("id").alias("rep"), F.count("*").alias("docs"))
    classes = materialize(kinds.withColumn("cls", F.monotonically_increasing_id()))  # numbered once, as written
    leads = led(docs, classes, id_col, text_col, width, percent)
    edges = candidate_edges(leads, percent)
    families = connected_components(edges)
    forget(leads)

    # Sets of the candidate classes only, each from one of its documents.
    related = materialize(families.join(classes, families["node"] == classes["cls"]).select("cls", *SET, "docs", "rep", "component"))
    counts = materialize(related.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("held")))  # written, so that the join back is plain
    # linked sets are of the same or of neighbouring bands (a little wider than the threshold, for rounding)
    wide = max(1.001 * math.log(100 / percent), 1e-9)
    whole = (F.col("size") <= block) & (F.col("held") <= BLOCK_TOKENS)
    members = materialize(related.join(counts, "component").withColumn("band", F.when(whole, 0).otherwise(F.floor(F.log("n") / wide))).drop("size", "held"))
    chunks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.least(F.ceil(F.count("*") / block), F.lit(SPREAD))).cast("int")
    w = Window.partitionBy("component").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(w) == F.col("band") + step, f("chunks").over(w)).otherwise(0)
    bands = materialize(members.groupBy("component", "band").agg(chunks.alias("chunks")).withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)}))
    # no text is shuffled: rows marked by chance make sets that meet no member
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    wanted = marked(named, "_id", marks(members.select("rep"))).filter("_marked").select("_text")

    def sets(batch):
        made = shingle_sets(batch.column("_text").to_pylist(), width)
        one, two = _prints(made)
        return {"n": [len(s) for s in made], "p1": one, "p2": two, "tokens": [s.astype(np.int64).tobytes() for s in made]}

    tokens = map_arrow(wanted, sets, "n long, p1 long, p2 long, tokens binary")
    once = tokens.groupBy(*SET).agg(F.any_value("tokens").alias("tokens"))
    mine, band = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"), F.col("band")
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda low, high, i, j, side: F.struct(F.xxhash64("component", low, high, i, j).alias("block"), side.alias("side"))
    places = F.concat(
        F.transform(numbers("chunks"), lambda o: place(band, band, F.least("_mine", o), F.greatest("_mine", o), F.when(F.col("_mine") == o, 0).when(F.col("_mine") < o, 1).otherwise(2))),
        F.transform(numbers("below"), lambda o: place(band - 1, band, o, F.col("_mine"), F.lit(2))),
        F.transform(numbers("above"), lambda o: place(band, band + 1, F.col("_mine"), o, F.lit(1))),
    )
    placed = members.join(bands, ["component", "band"]).withColumn("_mine", mine).select("cls", *SET, "docs", places.alias("places"))
    shipped = placed.join(once, SET).select("cls", "n", "docs", "tokens", F.explode("places").alias("_place")).select("_place.block", "_place.side", "cls", "n", "docs", "tokens")
    shipped = shipped.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block")
    found = materialize(compare_blocks(shipped, percent))
    linked = connected_components(found.filter("a <> b").select("a", "b"))
    degree = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))

    named = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialize(named)
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    of_class = named.join(least, "component").join(degree, "cls", "left").select(
        *SET, "component_id", (F.coalesce("others", F.lit(0)) + F.col("docs") - 1).alias("n_links")
    )
    return rows.join(materialize(of_class), SET, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.concat_ws("-", F.col("n").cast("string"), F.hex("p1"), F.hex("p2")).alias("class_id"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, all columns unchanged.

    Rows with the same id count as one document and stay or go together; null ids likewise. Texts without
    words link with nothing and stay; very long texts are read whole; columns of any name pass through; an
    empty table gives an empty result.
    """
    joined = jaccard_components(df, id_col, text_col, width, percent)
    first = joined.groupBy(F.col(id_col).alias("_gone")).agg(F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("_first"))
    gone = materialize(first.filter("NOT _first").select("_gone"))
    hidden = {c: f"_in_{i}" for i, c in enumerate(df.columns)}  # no input column meets a working one
    inner = df.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    seen = marked(inner, hidden[id_col], marks(gone))  # rows without a mark stay where they are; the others are looked up
    asked = seen.filter("_marked").join(gone.hint("shuffle_hash"), F.col(hidden[id_col]).eqNullSafe(F.col("_gone")), "left_anti")
    kept = seen.filter("NOT _marked").unionByName(asked)
    return kept.select(*(F.col(h).alias(c) for c, h in hidden.items()))
