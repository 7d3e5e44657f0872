"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into equal segments, few at the coarse level and more at each finer one. Over a segment of n
components with means a, b and deviations s, t the inner product is at most n (a b + s t) - the same fact
that bounds Euclidean distance from below by n ((a - b)^2 + (s - t)^2). Summed over segments this bounds the
score of a pair from above; a pair whose bound is under the query's current k-th score at some level is
dropped. What passes all levels is computed exactly, the largest bounds first, so that the k-th score rises
early and drops more of the rest. The finest level has segments of two components: it still tells apart
vectors without any structure, which coarser ones do not. Queries come in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Segments of each level as divisors of the dimension: segments of 1/1, 1/4, 1/16 of it, and of two components.
LEVELS = (1, 4, 16, None)


def quantised(vectors: list, scale: float = 1024.0) -> tuple[list[int], list[np.ndarray]]:
    """Places and floor(scale * x) of the vectors that are not null and hold neither null nor non-finite components."""
    at, made = [], []
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.floor(scale * np.asarray(v, dtype=np.float64))
        if len(x) and np.isfinite(x).all():
            at.append(i)
            made.append(x)
    return at, made


def statistics(x: np.ndarray, segments: int | None) -> np.ndarray:
    """Per vector and segment (None: of two components) sqrt(n) times mean and deviation: inner products of these rows are the bounds."""
    parts = np.array_split(x, min(segments or -(-x.shape[1] // 2), x.shape[1]), axis=1)
    return np.concatenate([np.sqrt(p.shape[1]) * f(p, axis=1, keepdims=True) for f in (np.mean, np.std) for p in parts], axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows: in floating point where all sums are exact, else in Python integers."""
    top = (np.abs(q).max(initial=0) or 1) * (np.abs(x).max(initial=0) or 1) * q.shape[1]
    if top < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in x], dtype=object).T
    return np.array([[min(max(v, -(2**63)), 2**63 - 1) for v in r] for r in whole], dtype=np.int64).reshape(len(q), len(x))


class Search:
    """Best ``k`` candidates of every query of one dimension so far; candidates come in batches.

    ``passed`` counts pairs: all, those that pass each level, and those computed exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple = LEVELS):
        self.ids, self.vectors, self.k, self.levels = ids, vectors, k, levels
        self.stats = [statistics(vectors, s) for s in levels]
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # k-th score, once there are k
        self.passed = [0] * (len(levels) + 2)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x**2).sum(axis=1))
        open_ = self.ids[:, None] != ids[None, :]
        self.passed[0] += int(open_.sum())
        rows = cols = bound = None
        for i, (stats, segments) in enumerate(zip(self.stats, self.levels)):
            rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows) or not len(cols):
                return
            slack = 1e-9 * self.norm[rows][:, None] * norm[cols][None, :] + 0.5  # rounding of the bound itself
            bound = stats[rows] @ statistics(x[cols], segments).T + slack
            open_[np.ix_(rows, cols)] &= bound >= self.least[rows][:, None]
            self.passed[i + 1] += int(open_.sum())
        for r, row in enumerate(rows):
            left = np.flatnonzero(open_[row, cols])
            left = left[np.argsort(-bound[r, left], kind="stable")]
            for part in (slice(0, 4 * self.k), slice(4 * self.k, None)):
                now = left[part]
                now = now[bound[r, now] >= self.least[row]]
                if len(now):
                    self.passed[-1] += len(now)
                    self._take(row, exact(self.vectors[row : row + 1], x[cols[now]])[0], ids[cols[now]])

    def _take(self, row: int, scores: np.ndarray, names: np.ndarray) -> None:
        new = scores >= self.least[row]
        score, name = np.concatenate([self.best[row][0], scores[new]]), np.concatenate([self.best[row][1], names[new]])
        if len(score) > 4 * self.k:
            cut = score >= np.partition(score, -self.k)[-self.k]
            score, name = score[cut], name[cut]
        order = np.lexsort((name, -score))[: self.k]
        self.best[row] = score[order], name[order]
        if len(order) == self.k:
            self.least[row] = score[order[-1]]


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, block: int = 4096) -> DataFrame:
    """For every row where ``queries`` holds: its ``k`` highest integer inner products with all other rows.

    Components count as floor(scale * x). Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; equal
    scores go to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty or hold null
    or non-finite components take no part; vectors are compared within their dimension. Rows with a null id
    take no part. Rows with the query's id are its own and no candidates; a repeated id among candidates
    appears once per row, and a repeated query id is searched with each of its vectors, which share its ``k``.
    Scores beyond the range of long are clipped to it. Other columns are not read.

    The queries are written once, then collected one block of about ``block`` vectors at a time; each block
    meets all rows in one pass, of which every task keeps ``k`` rows a query. A hundredth of the rows as queries
    makes the work queries times rows, by definition; the bounds only cut the factor.
    """
    plain = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), queries.alias("asked"))
    rows = plain.filter("id is not null and v is not null").select("id", "v")
    asked = materialize(plain.filter("asked and id is not null and v is not null").select("id", "v"))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        part = _against(rows, np.asarray(table.column("id"), dtype=np.int64), table.column("v").to_pylist(), k, scale)
        part = materialize(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(rows: DataFrame, ids: np.ndarray, vectors: list, k: int, scale: float) -> DataFrame:
    """Best ``k`` of every task for one block of queries."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    at, made = quantised(vectors, scale)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(made):
        by_size.setdefault(len(x), []).append(i)
    asked = {n: (ids[[at[i] for i in own]], np.array([made[i] for i in own])) for n, own in by_size.items()}

    def run(batches):
        search = {n: Search(i, x, k) for n, (i, x) in asked.items()}
        for batch in batches:
            name = np.asarray(batch.column("id"), dtype=np.int64)
            for a in range(0, len(name), 2048):
                places, xs = quantised(batch.column("v").slice(a, 2048).to_pylist(), scale)
                sizes = np.array([len(x) for x in xs])
                for n, one in search.items():
                    own = np.flatnonzero(sizes == n)
                    if len(own):
                        one.add(name[a + np.array(places)[own]], np.array([xs[i] for i in own]))
        for one in search.values():
            q = np.repeat(one.ids, [len(s) for s, _ in one.best])
            if len(q):
                yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": np.concatenate([n for _, n in one.best]), "score": np.concatenate([s for s, _ in one.best])})

    return rows.mapInArrow(run, StructType.fromDDL("query_id long, vec_id long, score long"))
