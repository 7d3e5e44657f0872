"""Vector codes against a plain Lloyd iteration over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterlake.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(x * scale) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) and abs(x * scale) < 1 << 28 for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])]
    out, by_label = [], {}
    for i, v, g in kept:
        at = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, g, bytes(k for _, k in at), sum(d for d, _ in at)))
        by_label[g] = by_label.get(g, 0) + out[-1][3]
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def rows(n, width=16, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.gauss(0, 1), rng.gauss(0, 0.01), 0.5]) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]


ODD = [
    (5, None, 1), (6, [], 1), (7, [float("nan")] * 16, 1), (8, [float("inf")] * 16, 2), (9, [None] * 16, 2), (10, [1e300] * 16, 2), (11, [0.5] * 24, 2), (12, [0.5] * 3, 2),
    (None, [0.25] * 16, None), (13, [0.25] * 16, 1), (13, [0.25] * 16, 1), (13, [-0.25] * 16, 1), (14, [-65000.0] * 16, 3),
]


@pytest.mark.parametrize("made", [rows(200), rows(60) + ODD, rows(5), ODD, [(1, [1.0] * 8, 1)] * 4, []])
def test_equals_plain(spark, made):
    df = spark.createDataFrame(made, SCHEMA).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1)).repartition(3)
    found, books = vectorcodes.compress_vectors(df)
    want, digest = plain(made) if made else ([], hashlib.sha256(b"").hexdigest())
    assert found.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted(((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in found.collect()), key=str) == want and books.digest() == digest


def test_names_like_outputs_other_sizes_and_ties(spark):
    made = [(i % 9, v, g) for i, v, g in rows(80, width=12, seed=8)]
    df = spark.createDataFrame(made, "error long, embedding array<double>, code int")
    found, books = vectorcodes.compress_vectors(df, id_col="error", label_col="code", parts=3, entries=5, rounds=40, scale=10)
    want, digest = plain(made, 3, 5, 40, 10)
    assert found.columns == ["error_id", "code_label", "code", "error", "label_error"]
    assert sorted(((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in found.collect()), key=str) == want and books.digest() == digest


def test_only_changed_parts_are_shuffled(spark, monkeypatch):
    """Later rounds bring few changes, and a round without any ends the training."""
    seen, apply = [], vectorcodes.Codebooks.apply
    monkeypatch.setattr(vectorcodes.Codebooks, "apply", lambda self, changes: seen.append(sum(abs(c) for _, _, c, _ in changes)) or apply(self, changes))
    df = spark.createDataFrame(rows(40, width=8), SCHEMA)
    vectorcodes.compress_vectors(df, parts=2, entries=4, rounds=100)
    assert seen[0] == 80 and len(seen) < 40 and max(seen[1:]) < 80


def test_decompress(spark):
    made = rows(50)
    df = spark.createDataFrame(made, SCHEMA)
    coded, books = vectorcodes.compress_vectors(df)
    got = {r.vec_id: r.vector for r in vectorcodes.decompress_vectors(coded, books).collect()}
    for r in coded.collect():
        assert np.allclose(got[r.vec_id], np.concatenate([books.entries[p, c] for p, c in enumerate(bytes(r.code))]) / 4096)
        assert sum((round(x * 4096) - math.floor(y * 4096)) ** 2 for x, y in zip(got[r.vec_id], made[r.vec_id][1])) == r.error


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(4)
    x, e = rng.integers(-(1 << 28), 1 << 28, (50, 2, 8)), rng.integers(-(1 << 28), 1 << 28, (2, 7, 8))
    code, far = vectorcodes.nearest(x, e)
    for i in range(50):
        for p in range(2):
            want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, p], entry)), k) for k, entry in enumerate(e[p]))
            assert (far[i, p], code[i, p]) == want
